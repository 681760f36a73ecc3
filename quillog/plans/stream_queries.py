"""Queries that run a stream over the event files to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillog.session import durable, shared_folder, table
from quillog.sources.bindings import TENDENCIES, LOG_SQL, candidates
from quillog.streaming import streams

from .history_queries import _HOT, PIECES, PRE, SEQ, WINGS, _case, _match
from .registry import query


#: Files of a part arrive at once, however many they are: a file read later would find the watermark moved on.
WHOLE = 1_000_000


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    own = streams.file_stream(spark, f"{sf_dir}/event*.parquet", table(spark, sf_dir, "events").schema)
    return own.withColumn("ts", F.col("ts").cast("timestamp"))


def _to_end(df, folder: str, schema):
    """Run an append-mode stream over all files there are; its rows as a table."""
    df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


@query("st_incremental_ingest", """WITH r AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), c AS (SELECT e.*, ((epoch_us(ts) - lo) * 3 // (hi - lo + 1) + 1)::int AS part, event_id % 50 = 0 AND (epoch_us(ts) - lo) * 3 // (hi - lo + 1) < 2 AS delayed FROM events e, r),
  k AS (SELECT *, delayed AND ts < (SELECT max(ts) FROM c WHERE part <= 2 AND NOT delayed) - INTERVAL 1 HOUR AS late FROM c)
  SELECT event_type, count_if(NOT late) AS n, round(sum(value) FILTER (NOT late), 6) AS total, (SELECT count_if(late) FROM k) AS late FROM k GROUP BY 1""")
def st_incremental_ingest(spark, sf_dir):
    """Files arrive in three parts by time, every event twice; one of each is kept. A fiftieth of the first two
    parts arrives with the third: what is then behind the watermark is dropped and counted."""
    folder = _folder(spark)
    source = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    at = F.unix_micros("ts")
    low, high = source.agg(F.min(at), F.max(at)).first()
    part = F.expr(f"int((unix_micros(ts) - {low}L) * 3 div {high - low + 1}L) + 1")
    arrives = F.when((F.col("event_id") % 50 == 0) & (part < 3), 3).otherwise(part)
    sink = lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    late = 0
    for step in (1, 2, 3):
        source.where(arrives == step).write.mode("append").parquet(f"{folder}/in")
        stream = streams.file_stream(spark, f"{folder}/in", source.schema, files_per_trigger=WHOLE)
        twice = stream.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
        run = streams.ingest(twice, "event_id", "ts", "1 hour", sink, f"{folder}/state")
        run.awaitTermination()
        late += streams.late_rows(run)
    kept = spark.read.parquet(f"{folder}/rows")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).withColumn("late", F.lit(late // 2).cast("bigint"))


@query("st_behavior_rates", """WITH d AS (SELECT date_trunc('day', ts)::timestamp AS start, user_id, event_type FROM events)
  SELECT start, user_id, count(*) AS n, round(avg((event_type = 'purchase')::int), 9) AS purchase FROM d
  WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY start, user_id""")
def st_behavior_rates(spark, sf_dir):
    """Daily rates of the windows that the watermark has closed."""
    rates = streams.behavior_rates(events(spark, sf_dir), "ts", "user_id", {"purchase": F.col("event_type") == "purchase"})
    closed = _to_end(rates, _folder(spark), rates.schema)
    return closed.select("start", "user_id", "n", F.round("purchase", 9).alias("purchase"))


@query("st_player_profile", """SELECT event_id, row_number() OVER w - 1 AS observations, round((coalesce(sum((event_type = 'purchase')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10) / (row_number() OVER w - 1 + 20), 9) AS rate
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def st_player_profile(spark, sf_dir):
    """The running profile; on ordered input it equals the batch encoder."""
    source = events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("hit"))
    profile = streams.player_profile(source, player="user_id", at="ts", row_id="event_id", flag="hit")
    return _to_end(profile, _folder(spark), profile.schema).select("event_id", "observations", F.round("rate", 9).alias("rate"))


def _deliver(parts, k: int, folder: str) -> None:
    """Part ``k`` as files of a folder, written by as many tasks as hold rows of it."""
    parts.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(folder)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ARRIVED = "(decision_id % 97 <> 0 OR played_at >= (SELECT min(played_at) + INTERVAL 10 MONTH FROM dec))"


@query("st_player_tendencies", LOG_SQL + f""", st AS (SELECT decision_id, count(*) OVER w AS n, {_HOT} FROM cand WHERE chosen AND {_ARRIVED} WINDOW w AS (PARTITION BY player {SEQ} {PRE}))
  SELECT c.decision_id, n AS observations, round(({_case('c.piece', PIECES, 'pc')} + 20.0 / 6) / (n + 20), 9) AS piece_probability, round(({_case('c.wing', WINGS, 'wg')} + 20.0 / 3) / (n + 20), 9) AS wing_probability, {', '.join(_match(f) for f in TENDENCIES)},
   (SELECT count(*) FROM dec WHERE NOT {_ARRIVED}) AS late FROM cand c JOIN st USING (decision_id) WHERE chosen AND played_at < (SELECT max(played_at) - INTERVAL 100 DAY FROM dec)""")
def st_player_tendencies(spark, sf_dir):
    """The log's choices arrive in six parts, shuffled within three months; some of the first months come with
    the last part and are late. What the watermark has passed equals the batch encoder in all columns."""
    folder = _folder(spark)
    chosen = durable(candidates(spark, sf_dir).where("chosen").select("decision_id", "player", "played_at", "game_id", "ply", "piece", "wing", *TENDENCIES))
    first, last = chosen.agg(F.min("played_at"), F.max("played_at")).first()
    month = F.floor(F.months_between("played_at", F.lit(first))).cast("int")
    span = (last.year - first.year) * 12 + last.month - first.month + 3
    part = F.floor((month + F.pmod(F.xxhash64("decision_id"), F.lit(3))) * 6 / span).cast("int")
    late = (F.col("decision_id") % 97 == 0) & (month < 10)
    parts = chosen.withColumn("_part", F.when(late, F.lit(5)).otherwise(part))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    dropped = 0
    try:
        for k in range(6):
            _deliver(parts, k, f"{folder}/in")
            stream = streams.file_stream(spark, f"{folder}/in", chosen.schema, files_per_trigger=WHOLE)
            rows = streams.player_tendencies(stream, player="player", at="played_at", row_id="decision_id", order=("game_id", "ply"), values={"piece": PIECES, "wing": WINGS}, flags=TENDENCIES, delay="100 days")
            run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            run.awaitTermination()
            dropped += streams.late_rows(run)
    finally:
        if store:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    back = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    return back.select("decision_id", "observations", *[F.round(c, 9).alias(c) for c in ("piece_probability", "wing_probability", *[f"{f}_match" for f in TENDENCIES])], F.lit(dropped).cast("bigint").alias("late"))
