"""Queries of sources and sinks. Game texts are written out from the order tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillog.operators import checks
from quillog.session import shared_folder, table
from quillog.sources import ingest
from quillog.sources.bindings import LOG_SQL, decisions

from .registry import query

_K = "o_orderkey"


def texts(spark, sf_dir):
    """One game text per order, with tags missing or malformed on some."""
    k = F.col(_K)
    line = lambda name, value: F.concat(F.lit(f'[{name} "'), value, F.lit('"]\n'))
    say = lambda x: F.lit(x)
    parts = [
        line("Event", F.when(k % 3 == 0, say("Rated Blitz game")).when(k % 3 == 1, say("Casual game")).otherwise(say("Hourly Rapid Arena"))),
        line("Site", F.when(k % 4 == 0, say("?")).otherwise(F.concat(say("https://games.example/x"), k.cast("string"), say("#7")))),
        line("UTCDate", F.when(k % 10 == 0, say("2020.??.??")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))),
        F.when(k % 2 == 0, line("UTCTime", say("12:34:56"))).otherwise(say("")),
        line("White", F.concat(say("Player"), F.col("o_custkey").cast("string"))),
        line("Black", F.when(k % 8 == 0, say("?")).otherwise(say("Other"))),
        line("WhiteElo", F.when(k % 6 == 0, say("?")).otherwise((k % 2000 + 500).cast("string"))),
        F.when(k % 5 == 0, line("WhiteRatingDiff", say("+4"))).otherwise(say("")),
        line("Result", F.when(k % 2 == 0, say("1-0")).otherwise(say("0-1"))),
        line("TimeControl", F.when(k % 7 == 0, say("-")).otherwise(F.concat(((k % 5) * 150 + 15).cast("string"), say("+"), (k % 4).cast("string")))),
        F.when(k % 9 == 0, line("Variant", say("Atomic"))).otherwise(say("")),
        say("\n1. e4 { [%clk 0:05:00] } e5 { [%clk 0:04:"), F.lpad((k % 60).cast("string"), 2, "0"), say("] } 2. Nf3 (2. d4 exd4) Nc6 3. O-O { quiet } "), F.when(k % 2 == 0, say("1-0")).otherwise(say("0-1")),
    ]
    return table(spark, sf_dir, "orders").select(_K, F.concat(*parts).alias("pgn"))


_STD = "o_orderkey % 9 <> 0"
_CONTROL = "CASE WHEN o_orderkey % 7 <> 0 THEN ((o_orderkey % 5) * 150 + 15) || '+' || (o_orderkey % 4) END"
_SECONDS = "CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 5) * 150 + 15 + 40 * (o_orderkey % 4) END"
_ID = "CASE WHEN o_orderkey % 4 <> 0 THEN 'x' || o_orderkey END"


def _text_sql() -> str:
    line = lambda name, value: f"'[{name} \"' || {value} || '\"]' || chr(10)"
    k = "o_orderkey"
    return " || ".join([
        line("Event", f"CASE {k} % 3 WHEN 0 THEN 'Rated Blitz game' WHEN 1 THEN 'Casual game' ELSE 'Hourly Rapid Arena' END"), line("Site", f"CASE WHEN {k} % 4 = 0 THEN '?' ELSE 'https://games.example/x' || {k} || '#7' END"),
        line("UTCDate", f"CASE WHEN {k} % 10 = 0 THEN '2020.??.??' ELSE strftime(o_orderdate, '%Y.%m.%d') END"), f"CASE WHEN {k} % 2 = 0 THEN {line('UTCTime', chr(39) + '12:34:56' + chr(39))} ELSE '' END",
        line("White", "'Player' || o_custkey"), line("Black", f"CASE WHEN {k} % 8 = 0 THEN '?' ELSE 'Other' END"), line("WhiteElo", f"CASE WHEN {k} % 6 = 0 THEN '?' ELSE ({k} % 2000 + 500)::varchar END"),
        f"CASE WHEN {k} % 5 = 0 THEN {line('WhiteRatingDiff', chr(39) + '+4' + chr(39))} ELSE '' END", line("Result", f"CASE WHEN {k} % 2 = 0 THEN '1-0' ELSE '0-1' END"),
        line("TimeControl", f"CASE WHEN {k} % 7 = 0 THEN '-' ELSE (({k} % 5) * 150 + 15) || '+' || ({k} % 4) END"), f"CASE WHEN {k} % 9 = 0 THEN {line('Variant', chr(39) + 'Atomic' + chr(39))} ELSE '' END",
        f"chr(10) || '1. e4 {{ [%clk 0:05:00] }} e5 {{ [%clk 0:04:' || lpad(({k} % 60)::varchar, 2, '0') || '] }} 2. Nf3 (2. d4 exd4) Nc6 3. O-O {{ quiet }} ' || CASE WHEN {k} % 2 = 0 THEN '1-0' ELSE '0-1' END",
    ])


_PLAYED = "CASE WHEN o_orderkey % 10 <> 0 THEN date_trunc('day', o_orderdate)::timestamp + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '12:34:56' ELSE INTERVAL 0 SECOND END END"
_SPEED = f"CASE o_orderkey % 3 WHEN 0 THEN 'blitz' WHEN 2 THEN 'rapid' ELSE CASE WHEN {_SECONDS} <= 29 THEN 'ultrabullet' WHEN {_SECONDS} <= 179 THEN 'bullet' WHEN {_SECONDS} <= 479 THEN 'blitz' WHEN {_SECONDS} <= 1499 THEN 'rapid' WHEN {_SECONDS} IS NOT NULL THEN 'classical' END END"
_ANY_ID = f"CASE WHEN o_orderkey % 4 <> 0 THEN 'x' || o_orderkey ELSE substr(sha256({_text_sql()}), 1, 16) END"


@query("src_pgn_headers", f"""SELECT o_orderkey, {_ANY_ID} AS game_id, 'files' AS provider, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://games.example/x' || o_orderkey || '#7' END AS game_url, {_PLAYED} AS played_at, 'Player' || o_custkey AS white_username, 'Other' AS black_username,
   CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 2000 + 500 END AS white_rating, NULL::bigint AS black_rating, CASE WHEN o_orderkey % 2 = 0 THEN '1-0' ELSE '0-1' END AS result, o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS rated, 'Standard' AS variant, {_SPEED} AS speed, {_CONTROL} AS time_control,
   NULL::varchar AS eco, NULL::varchar AS opening_name, NULL::varchar AS opening_variation, NULL::varchar AS termination, 5 AS total_plies, (SELECT count_if(NOT ({_STD} AND o_orderkey % 8 <> 0)) FROM orders) AS skipped FROM orders WHERE {_STD} AND o_orderkey % 8 <> 0""")
def src_pgn_headers(spark, sf_dir):
    """Typed headers of the standard games of one player, in whatever case, and how many games were skipped."""
    own = texts(spark, sf_dir)
    left = own.agg(F.count_if(ingest.skipped(F.col("pgn"), "oTHER")).alias("skipped"))
    return ingest.headers(own, target="oTHER", provider="files", keep=(_K,)).crossJoin(left)  # one row


@query("src_games_table", f"SELECT count(*) AS games, count(DISTINCT white_rating) AS ratings, count_if(rated) AS rated FROM (SELECT CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 2000 + 500 END AS white_rating, o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS rated FROM orders WHERE {_STD})")
def src_games_table(spark, sf_dir):
    g = ingest.headers(texts(spark, sf_dir))
    return g.agg(F.count("*").alias("games"), F.count_distinct("white_rating").alias("ratings"), F.count_if("rated").alias("rated"))


@query("src_played_at", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN date_trunc('day', o_orderdate)::timestamp + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '12:34:56' ELSE INTERVAL 0 SECOND END END AS played_at FROM orders")
def src_played_at(spark, sf_dir):
    return texts(spark, sf_dir).select(_K, ingest.played_at(F.col("pgn")).alias("played_at"))


@query("src_speed_class", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'blitz' WHEN 2 THEN 'rapid' ELSE CASE WHEN {_SECONDS} <= 29 THEN 'ultrabullet' WHEN {_SECONDS} <= 179 THEN 'bullet' WHEN {_SECONDS} <= 479 THEN 'blitz' WHEN {_SECONDS} <= 1499 THEN 'rapid' WHEN {_SECONDS} IS NOT NULL THEN 'classical' END END AS speed FROM orders")
def src_speed_class(spark, sf_dir):
    return texts(spark, sf_dir).select(_K, ingest.speed_class(F.col("pgn")).alias("speed"))


@query("src_rated_flag", "SELECT o_orderkey, o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS rated FROM orders")
def src_rated_flag(spark, sf_dir):
    return texts(spark, sf_dir).select(_K, ingest.is_rated(F.col("pgn")).alias("rated"))


@query("src_game_id", f"SELECT o_orderkey, {_ANY_ID} AS game_id FROM orders")
def src_game_id(spark, sf_dir):
    """Ids from the site, or 16 hex digits of the text's hash where there is none."""
    return texts(spark, sf_dir).select(_K, ingest.game_id(F.col("pgn")).alias("game_id"))


@query("src_game_files", "SELECT 'Player' || o_custkey AS white, CASE WHEN o_orderkey % 2 = 0 THEN '1-0' ELSE '0-1' END AS result, 5 AS plies, count(*) AS games FROM orders GROUP BY ALL")
def src_game_files(spark, sf_dir):
    """Games written to text files, many to a file, and split again while they are read."""
    back, path = _round_trip(spark, texts(spark, sf_dir).select(F.concat("pgn", F.lit("\n"))), lambda df, p: df.write.text(p), lambda p: ingest.read_games(spark, p))
    p = F.col("pgn")
    key = F.regexp_extract(p, r"%clk 0:04:\d\d", 0)
    games = back.where(key != "").select(ingest.tag(p, "White").alias("white"), ingest.tag(p, "Result").alias("result"), F.size(ingest.mainline(p)).alias("plies"))
    return games.groupBy("white", "result", "plies").agg(F.count("*").alias("games"))


@query("src_epoch_millis", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN epoch_ms(o_orderdate) WHEN 2 THEN epoch_ms(date_trunc('day', o_orderdate)::timestamp) END AS millis FROM orders")
def src_epoch_millis(spark, sf_dir):
    k = F.col(_K)
    at = F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 4 == 0, (k * 1000).cast("string")).when(k % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 2, F.date_format(at, "yyyy-MM-dd")).otherwise(F.lit("-5"))
    return table(spark, sf_dir, "orders").select(_K, ingest.epoch_millis(text).alias("millis"))


@query("src_movetext_plies", "SELECT o_orderkey, ply::int AS ply, CASE WHEN ply % 2 = 1 THEN 'white' ELSE 'black' END AS color, ['e4', 'e5', 'Nf3', 'Nc6', 'O-O'][ply] AS san, (CASE ply WHEN 1 THEN 300 WHEN 2 THEN 240 + o_orderkey % 60 END)::double AS clock FROM orders, range(1, 6) t(ply)")
def src_movetext_plies(spark, sf_dir):
    own = texts(spark, sf_dir).withColumn("pgn", F.concat(F.lit('[GameId "'), F.col(_K).cast("string"), F.lit('"]\n'), F.col("pgn")))
    return ingest.plies(own).select(F.col("game_id").cast("bigint").alias(_K), "ply", "color", "san", "clock")


@query("src_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def src_parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select("l_orderkey", "l_quantity")


@query("src_parquet_pushdown", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000)")
def src_parquet_pushdown(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(ids, "l_orderkey", "left_semi")


@query("src_snapshot_union", "SELECT t AS player_file, n FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region)")
def src_snapshot_union(spark, sf_dir):
    """Several files by one glob, with the key from each file's name."""
    name = r"^(.*)\.parquet$"
    nation = ingest.read_snapshots(spark, f"{sf_dir}/natio*.parquet", name).select("player_file")
    region = ingest.read_snapshots(spark, f"{sf_dir}/regio*.parquet", name).select("player_file")
    return nation.unionByName(region).groupBy("player_file").agg(F.count("*").alias("n"))


@query("sink_sharded_by_player", LOG_SQL + """, n AS (SELECT decision_id, count(*) AS n FROM cand GROUP BY 1), s AS (SELECT dec.*, (coalesce(sum(n) OVER (PARTITION BY player ORDER BY played_at, game_id, ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 512)::int AS shard FROM dec JOIN n USING (decision_id))
  SELECT player, shard, count(*) AS decisions, count(DISTINCT game_id) AS games FROM s GROUP BY ALL""")
def sink_sharded_by_player(spark, sf_dir):
    """Shards of about 512 candidate rows, written by player and shard and read back for their manifest."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("decision_id")).agg(F.count("*").alias("n"))
    sharded = ingest.shards(decisions(spark, sf_dir).join(per, "decision_id"), 512, rows="n")
    back, _ = _round_trip(spark, sharded, ingest.write_shards)
    return ingest.manifest(back).withColumn("shard", F.col("shard").cast("int"))


def _round_trip(spark, df, write, read=None):
    """Write below the shared checkpoint folder and read back."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    write(df, path)
    return (read or spark.read.parquet)(path), path


@query("sink_tables", LOG_SQL + "SELECT player, count(*) AS n, sum(ply)::bigint AS plies FROM dec GROUP BY 1")
def sink_tables(spark, sf_dir):
    back, _ = _round_trip(spark, decisions(spark, sf_dir), lambda df, p: ingest.publish(df, p, partition_by=("phase",)))
    return back.groupBy("player").agg(F.count("*").alias("n"), F.sum("ply").alias("plies"))


@query("sink_atomic_publish", LOG_SQL + "SELECT count(*) AS n, true AS refused FROM dec")
def sink_atomic_publish(spark, sf_dir):
    """A second publication to the same path is refused and leaves the first as it was."""
    from pyspark.errors import AnalysisException

    dec = decisions(spark, sf_dir)
    back, path = _round_trip(spark, dec, lambda df, p: ingest.publish_frozen(df, p, checks.fingerprint(df)))
    try:
        ingest.publish(dec.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return back.agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))
