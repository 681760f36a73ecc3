"""Queries of splitting, sampling and selecting games."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.functions.scalars import hash_uniform  # noqa: F401
from quillog.operators import splits
from quillog.session import durable
from quillog.sources.bindings import candidates, decisions

from .check_queries import GAMES_SQL, games
from .registry import query

SPLIT_SQL = GAMES_SQL + """, sp AS (SELECT *, CASE WHEN n >= 3 AND floor(n * 0.70::double) >= 1 AND floor(n * 0.85::double) > floor(n * 0.70::double) AND n > floor(n * 0.85::double) THEN
    CASE WHEN i <= floor(n * 0.70::double) THEN 'train' WHEN i <= floor(n * 0.85::double) THEN 'validation' ELSE 'test' END END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY played_at, game_id) AS i, count(*) OVER (PARTITION BY player) AS n FROM games))"""


@query("split_chrono_70_15_15", SPLIT_SQL + "SELECT player, game_id, split FROM sp")
def split_chrono(spark, sf_dir):
    return splits.chronological(games(spark, sf_dir)).select("player", "game_id", "split")


@query("split_newest_counts", GAMES_SQL + """, q AS (SELECT player, game_id, CASE WHEN substr(player, 7)::int % 2 = 0 THEN played_at ELSE date_trunc('quarter', played_at)::timestamp END AS qt FROM games), r AS (SELECT *, row_number() OVER w AS i, lead(qt) OVER w AS later FROM q WINDOW w AS (PARTITION BY player ORDER BY qt DESC, game_id DESC)),
  t AS (SELECT *, bool_or(i = 30 AND coalesce(later = qt, false)) OVER (PARTITION BY player) AS tied FROM r)
  SELECT player, game_id, CASE WHEN i <= 5 THEN 'evaluation' WHEN i <= 10 THEN 'validation' ELSE 'history' END AS block FROM t WHERE i <= 30 AND NOT tied""")
def split_newest_counts(spark, sf_dir):
    """Times of odd players are quarters, so that boundaries are tied for some, who are left out."""
    even = F.substring("player", 7, 9).cast("int") % 2 == 0
    quarters = games(spark, sf_dir).withColumn("played_at", F.when(even, F.col("played_at")).otherwise(F.date_trunc("quarter", "played_at")))
    return splits.newest_blocks(quarters, [("history", 20), ("validation", 5), ("evaluation", 5)]).select("player", "game_id", "block")


@query("split_half_ties_late", GAMES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY played_at, game_id) AS i, count(*) OVER (PARTITION BY player) AS n FROM games),
  c AS (SELECT *, max(CASE WHEN i = n // 2 + 1 THEN played_at END) OVER (PARTITION BY player) AS cut FROM r)
  SELECT player, game_id, CASE WHEN played_at < cut THEN 'history' ELSE 'evaluation' END AS half FROM c WHERE n >= 10""")
def split_half_ties_late(spark, sf_dir):
    return splits.half_split(games(spark, sf_dir)).select("player", "game_id", "half")


@query("split_metadata", SPLIT_SQL + """SELECT split, count(DISTINCT s.game_id) AS games, min(s.played_at) AS first_at, max(s.played_at) AS last_at, count(DISTINCT c.decision_id) AS decisions, count(*) AS candidates
  FROM sp s JOIN cand c USING (game_id) GROUP BY 1""")
def split_metadata(spark, sf_dir):
    split = splits.chronological(games(spark, sf_dir)).select("game_id", "split", "played_at")
    per_decision = candidates(spark, sf_dir).groupBy("decision_id", "game_id").agg(F.count("*").alias("n"))
    per_game = per_decision.groupBy("game_id").agg(F.count("*").alias("d"), F.sum("n").alias("c"))
    joined = split.join(per_game, "game_id")
    return joined.groupBy("split").agg(F.count("*").alias("games"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"), F.sum("d").alias("decisions"), F.sum("c").alias("candidates"))


@query("smp_whole_game_prefix", GAMES_SQL + """, r AS (SELECT *, sum(n_decisions) OVER (PARTITION BY player ORDER BY sha256('42:' || player || ':' || game_id), game_id ROWS UNBOUNDED PRECEDING) AS total FROM games)
  SELECT player, game_id FROM r WHERE total <= 100""")
def smp_whole_game_prefix(spark, sf_dir):
    return splits.whole_game_prefix(games(spark, sf_dir), 100, "n_decisions", [splits.seeded_order(42, "player", "game_id"), F.col("game_id")]).select("player", "game_id")


@query("smp_greedy_pack", SPLIT_SQL.replace("WITH dec AS", "WITH RECURSIVE dec AS") + """, o AS (SELECT player, split, game_id, n_decisions, row_number() OVER (PARTITION BY player, split ORDER BY played_at DESC, game_id DESC) AS k FROM sp),
  walk AS (SELECT player, split, k, n_decisions AS total, true AS kept FROM o WHERE k = 1 UNION ALL
    SELECT o.player, o.split, o.k, CASE WHEN w.total + o.n_decisions <= 60 THEN w.total + o.n_decisions ELSE w.total END, w.total + o.n_decisions <= 60 FROM walk w JOIN o ON o.player = w.player AND o.split = w.split AND o.k = w.k + 1)
  SELECT o.player, o.split, o.game_id FROM o JOIN walk w ON o.player = w.player AND o.split = w.split AND o.k = w.k WHERE w.kept""")
def smp_greedy_pack(spark, sf_dir):
    return splits.greedy_pack(splits.chronological(games(spark, sf_dir)), F.lit(60), groups=["player", "split"], size="n_decisions")


@query("smp_hash_topn_games", GAMES_SQL + """SELECT player, game_id FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY sha256('7:' || game_id), game_id) AS i FROM games) WHERE i <= 8""")
def smp_hash_topn_games(spark, sf_dir):
    return splits.top_n(games(spark, sf_dir), 8, [splits.seeded_order(7, "game_id"), F.col("game_id")], per="player").select("player", "game_id")


@query("smp_hash_blocks", GAMES_SQL + """SELECT player, game_id, ((row_number() OVER (PARTITION BY player ORDER BY sha256('9:' || game_id), game_id) - 1) // 25)::int AS block FROM games""")
def smp_hash_blocks(spark, sf_dir):
    return splits.blocks_of(games(spark, sf_dir), 25, [splits.seeded_order(9, "game_id"), F.col("game_id")], per="player").select("player", "game_id", "block")


@query("smp_sampling_report", GAMES_SQL + """, r AS (SELECT *, sum(n_decisions) OVER (PARTITION BY player ORDER BY sha256('42:' || player || ':' || game_id), game_id ROWS UNBOUNDED PRECEDING) <= 100 AS taken FROM games)
  SELECT player, count(*) AS available_games, count_if(taken) AS selected_games, count_if(NOT taken) AS omitted_games, sum(n_decisions)::bigint AS available_decisions, coalesce(sum(n_decisions) FILTER (taken), 0)::bigint AS selected_decisions FROM r GROUP BY 1""")
def smp_sampling_report(spark, sf_dir):
    own = Window.partitionBy("player").orderBy(splits.seeded_order(42, "player", "game_id"), "game_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = games(spark, sf_dir).withColumn("taken", F.sum("n_decisions").over(own) <= 100)
    return r.groupBy("player").agg(
        F.count("*").alias("available_games"), F.count_if("taken").alias("selected_games"), F.count_if(~F.col("taken")).alias("omitted_games"),
        F.sum("n_decisions").alias("available_decisions"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("n_decisions"))), F.lit(0)).alias("selected_decisions"),
    )


@query("sel_recent_n", GAMES_SQL + "SELECT player, game_id FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY played_at DESC, game_id DESC) AS i FROM games WHERE n_decisions >= 4) WHERE i <= 10")
def sel_recent_n(spark, sf_dir):
    eligible = games(spark, sf_dir).where("n_decisions >= 4")
    return splits.top_n(eligible, 10, [F.desc("played_at"), F.desc("game_id")], per="player").select("player", "game_id")


@query("sel_discover_players", GAMES_SQL + """, names AS (SELECT game_id, player AS name, rating FROM games UNION ALL SELECT game_id, 'Player' || (substr(player, 7)::int + 1) % 25, rating FROM games)
  SELECT name, count(DISTINCT game_id) AS appearances FROM names WHERE name NOT IN ('Player0', 'Player1') AND rating BETWEEN 1000 AND 9000 GROUP BY 1 ORDER BY 2 DESC, sha256(name) LIMIT 12""")
def sel_discover_players(spark, sf_dir):
    """Both names of each game, without known players, by appearances."""
    g = games(spark, sf_dir)
    other = F.concat(F.lit("Player"), ((F.substring("player", 7, 9).cast("int") + 1) % 25).cast("string"))
    names = g.select("game_id", F.explode(F.array("player", other)).alias("name"), "rating")
    known = spark.createDataFrame([("Player0",), ("Player1",)], "name string")
    own = names.where(F.col("rating").between(1000, 9000)).join(F.broadcast(known), "name", "left_anti")
    return own.groupBy("name").agg(F.count_distinct("game_id").alias("appearances")).orderBy(F.desc("appearances"), F.sha2("name", 256)).limit(12)


CASES = [("strict", 8), ("medium", 5), ("open", 1)]


@query("sel_capacity_audit", GAMES_SQL + """, sc AS (SELECT player, s.scenario, s.i, count_if(s.minimum <= n_decisions) AS games, coalesce(sum(n_decisions) FILTER (s.minimum <= n_decisions), 0)::bigint AS decisions
    FROM games CROSS JOIN (VALUES ('strict', 1, 8), ('medium', 2, 5), ('open', 3, 1)) s(scenario, i, minimum) GROUP BY ALL),
  pl AS (SELECT sc.*, t.threshold, games >= t.threshold AS ok, row_number() OVER (PARTITION BY scenario, t.threshold ORDER BY games < t.threshold, sha256(player)) AS place FROM sc CROSS JOIN (VALUES (20), (40), (60)) t(threshold)),
  ag AS (SELECT scenario, i, threshold, count_if(ok) AS supported, sum(decisions)::bigint AS decisions, count_if(ok) >= 20 AS meets, string_agg(player, ',' ORDER BY place) FILTER (ok AND place <= 8) AS development, string_agg(player, ',' ORDER BY place) FILTER (ok AND place BETWEEN 9 AND 16) AS evaluation FROM pl GROUP BY ALL)
  SELECT scenario, threshold, supported, decisions, meets, meets AND i = min(CASE WHEN meets THEN i END) OVER (PARTITION BY threshold) AS first, coalesce(development, '') AS development, coalesce(evaluation, '') AS evaluation FROM ag""")
def sel_capacity_audit(spark, sf_dir):
    """Per scenario and threshold: the players with enough games, whether they are enough, whether this is the
    first scenario that meets the threshold, and the roles of the supported players in hash order."""
    eligible = lambda m: F.col("n_decisions") >= m
    aggs = [f for name, m in CASES for f in (F.count_if(eligible(m)).alias(f"g_{name}"), F.coalesce(F.sum(F.when(eligible(m), F.col("n_decisions"))), F.lit(0)).alias(f"d_{name}"))]
    wide = games(spark, sf_dir).groupBy("player").agg(*aggs)
    long = wide.select("player", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(i).alias("i"), F.col(f"g_{n}").alias("games"), F.col(f"d_{n}").alias("decisions")) for i, (n, _) in enumerate(CASES)])).alias("x"))
    long = long.select("player", "x.*", F.explode(F.array(*[F.lit(t) for t in (20, 40, 60)])).alias("threshold")).withColumn("ok", F.col("games") >= F.col("threshold"))
    long = durable(long)
    w = Window.partitionBy("scenario", "threshold").orderBy(F.sha2("player", 256))
    first = long.where("ok").withColumn("place", F.row_number().over(w)).where("place <= 16")  # each task keeps sixteen before the shuffle
    role = lambda low, high, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").between(low, high), F.struct("place", "player")))), lambda x: x["player"]), ",").alias(name)
    roles = first.groupBy("scenario", "threshold").agg(role(1, 8, "development"), role(9, 16, "evaluation"))
    audit = long.groupBy("scenario", "i", "threshold").agg(F.count_if("ok").alias("supported"), F.sum("decisions").alias("decisions"), (F.count_if("ok") >= 20).alias("meets")).join(roles, ["scenario", "threshold"], "left")
    audit = audit.withColumns({c: F.coalesce(c, F.lit("")) for c in ("development", "evaluation")})
    earliest = F.min(F.when(F.col("meets"), F.col("i"))).over(Window.partitionBy("threshold"))  # over the audit's few rows
    return audit.select("scenario", "threshold", "supported", "decisions", "meets", (F.col("meets") & (F.col("i") == earliest)).alias("first"), "development", "evaluation")


@query("sel_sequential_acceptance", GAMES_SQL.replace("WITH dec AS", "WITH RECURSIVE dec AS") + """, op AS (SELECT game_id, player, split_part(game_id, '-', 2) || '-' || max(opening) FILTER (ply = 1) AS shared FROM dec GROUP BY 1, 2),
  pl AS (SELECT player, row_number() OVER (ORDER BY sha256(player)) AS i, list(DISTINCT shared) AS ks FROM op GROUP BY 1),
  walk AS (SELECT 0::bigint AS i, []::varchar[] AS taken, NULL::varchar AS player, false AS ok UNION ALL
    SELECT p.i, CASE WHEN len(list_filter(p.ks, lambda x: NOT list_contains(w.taken, x))) >= 50 THEN list_concat(w.taken, p.ks) ELSE w.taken END, p.player, len(list_filter(p.ks, lambda x: NOT list_contains(w.taken, x))) >= 50 FROM walk w JOIN pl p ON p.i = w.i + 1),
  ac AS (SELECT player, row_number() OVER (ORDER BY i) AS n FROM walk WHERE ok) SELECT player, sha256(player) AS place, CASE WHEN n <= 5 THEN 'development' ELSE 'evaluation' END AS role FROM ac WHERE n <= 10""")
def sel_sequential_acceptance(spark, sf_dir):
    """Players in hash order need 50 games of their own: a game that several share (a month and the opening it
    began with) belongs to the first player accepted. Of ten, the first five are for development."""
    dec = decisions(spark, sf_dir)
    first = F.max(F.when(F.col("ply") == 1, F.col("opening")))
    played = dec.groupBy("player", "game_id").agg(first.alias("_o")).select("player", F.concat_ws("-", F.split_part("game_id", F.lit("-"), F.lit(2)), "_o").alias("game_id"))
    place = dec.select("player").distinct().withColumn("place", F.sha2("player", 256))
    accepted = splits.accept_in_order(place, played, minimum=50, target=10)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place"))  # ten rows
    return accepted.withColumn("role", F.when(number <= 5, "development").otherwise("evaluation"))
