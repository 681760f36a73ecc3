"""A decision log read from the given order tables.

A player is a customer's nation, a game a player's month, a decision an order, and the candidates of
a decision are its lines; the one of the largest quantity was chosen. Lines are ranked by price.
All candidate-grain work is keyed by ``decision_id`` (the order key), so the join of lines with
orders, the ranks and whatever a query windows by decision share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import table

FLAGS = ("capture", "check", "trade", "castle")
TENDENCIES = (*FLAGS, "pawn_push", "king_zone")
BEHAVIORS = (*TENDENCIES, "promotion", "development", "hanging")
RESIDUALS = (*BEHAVIORS, "toward", "queen_move", "enters_half")
ATTRIBUTES = (*BEHAVIORS, "piece", "wing")
#: What makes the flags beyond the first four, in words that both engines read alike.
MORE_FLAGS = {
    "pawn_push": "l_discount < 0.02", "king_zone": "l_tax >= 0.06", "promotion": "l_quantity >= 45", "development": "l_linenumber <= 2",
    "hanging": "l_partkey % 5 = 0", "toward": "l_suppkey % 3 = 0", "queen_move": "l_extendedprice >= 60000", "enters_half": "l_quantity % 2 = 0",
}
RANK_ORDER = "l_extendedprice DESC, l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_shipdate"


def decisions(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per order that has lines: who decided what, in which game, at which ply; and the order's columns ``keep``."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    having = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()  # most go before the shuffle, as an order's lines lie together
    own = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(having, orders["o_orderkey"] == having["l_orderkey"], "left_semi")
    player = F.concat(F.lit("Player"), F.col("c_nationkey").cast("string"))
    game = Window.partitionBy("game_id").orderBy("o_orderdate", "o_orderkey")
    return (
        own.withColumns(
            {
                "player": player,
                "played_at": F.date_trunc("month", F.col("o_orderdate").cast("timestamp")),
                "game_id": F.concat(player, F.lit("-"), F.date_format("o_orderdate", "yyyyMM")),
            }
        )
        .withColumn("ply", F.row_number().over(game))
        .select(
            F.col("o_orderkey").alias("decision_id"),
            "player",
            "game_id",
            "played_at",
            "ply",
            F.col("o_orderstatus").alias("phase"),
            F.col("o_orderpriority").alias("time_control"),
            F.col("c_acctbal").alias("rating"),
            F.concat(F.lit("A"), (F.col("o_custkey") % 7).cast("string")).alias("opening"),
            F.col("o_orderdate").cast("timestamp").alias("moved_at"),
            *keep,
        )
    )


def _ranked(rows: DataFrame) -> DataFrame:
    """Lines with their rank and whether they were chosen. The choice is a greatest value, so one sort serves both."""
    by_rank = Window.partitionBy("decision_id").orderBy(*[F.expr(x) if not x.endswith(" DESC") else F.desc(x.split()[0]) for x in RANK_ORDER.split(", ")])
    best = F.max(F.struct("l_quantity", "l_extendedprice", (-F.col("engine_rank")).alias("_rank"))).over(Window.partitionBy("decision_id"))
    return rows.withColumn("engine_rank", F.row_number().over(by_rank)).withColumn("chosen", best["_rank"] == -F.col("engine_rank"))


def _attributes() -> list[Column]:
    return [
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("r"), F.col("engine_rank").cast("string")).alias("move"),
        F.concat("l_returnflag", "l_linestatus").alias("piece"),
        F.when(F.col("l_quantity") <= 17, "queenside").when(F.col("l_quantity") <= 34, "center").otherwise("kingside").alias("wing"),
        (F.col("l_returnflag") == "R").alias("capture"),
        (F.col("l_linestatus") == "O").alias("check"),
        (F.col("l_discount") >= 0.05).alias("trade"),
        (F.col("l_tax") >= 0.04).alias("castle"),
        *[F.expr(text).alias(name) for name, text in MORE_FLAGS.items()],
    ]


def _scores() -> list[Column]:
    return [F.round(F.col("l_extendedprice") / 100).cast("bigint").alias("score_cp"), (F.col("l_extendedprice") / 20000).alias("base_logit"), F.col("l_quantity").alias("quantity")]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidates`` without the columns of their decision, for queries that join those themselves."""
    return _ranked(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "decision_id")).select("decision_id", "engine_rank", "chosen", *_attributes(), *_scores())


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: the candidate's rank, whether it was chosen, its attributes and scores."""
    own = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "decision_id")
    joined = own.join(decisions(spark, sf_dir), "decision_id")
    return _ranked(joined).select(
        "decision_id", "player", "game_id", "played_at", "ply", "phase", "time_control", "rating", "opening", "engine_rank", "chosen",
        *_attributes(),
        (F.col("l_shipdate").cast("timestamp") < F.col("moved_at") + F.expr("INTERVAL 60 DAYS")).alias("pressure"),
        *_scores(),
    ).withColumn("position_key", F.concat("piece", F.lit(":"), "wing"))


#: The same two tables in SQL, to be put before a query that reads ``dec`` or ``cand``.
LOG_SQL = f"""
WITH dec AS (
  SELECT o_orderkey AS decision_id, 'Player' || c_nationkey AS player,
         'Player' || c_nationkey || '-' || strftime(o_orderdate, '%Y%m') AS game_id,
         date_trunc('month', o_orderdate)::timestamp AS played_at,
         row_number() OVER (PARTITION BY c_nationkey, strftime(o_orderdate, '%Y%m') ORDER BY o_orderdate, o_orderkey)::int AS ply,
         o_orderstatus AS phase, o_orderpriority AS time_control, c_acctbal AS rating,
         'A' || (o_custkey % 7) AS opening, o_orderdate AS moved_at
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {RANK_ORDER})::int AS engine_rank FROM lineitem),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, engine_rank) = 1 AS chosen FROM ranked),
cand AS (
  SELECT decision_id, player, game_id, played_at, ply, phase, time_control, rating, opening, engine_rank, chosen,
         'p' || l_partkey || 'r' || engine_rank AS move, l_returnflag || l_linestatus AS piece,
         CASE WHEN l_quantity <= 17 THEN 'queenside' WHEN l_quantity <= 34 THEN 'center' ELSE 'kingside' END AS wing,
         l_returnflag = 'R' AS capture, l_linestatus = 'O' AS "check", l_discount >= 0.05 AS trade, l_tax >= 0.04 AS castle,
         {", ".join(f"{text} AS {name}" for name, text in MORE_FLAGS.items())},
         l_shipdate < moved_at + INTERVAL 60 DAY AS pressure,
         round(l_extendedprice / 100)::bigint AS score_cp, l_extendedprice / 20000 AS base_logit, l_quantity AS quantity,
         piece || ':' || wing AS position_key
  FROM picked JOIN dec ON l_orderkey = decision_id)
"""


def clock_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as clocked moves: a user's day is a game, a value the clock after the move."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    game = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    own = events.withColumn("game_id", game)
    return own.select(
        "event_id", F.col("user_id").cast("string").alias("player"), "game_id", "ts", "event_type", F.col("value").alias("clock"),
        F.row_number().over(Window.partitionBy("game_id").orderBy("ts", "event_id")).alias("ply"),
    )


CLOCK_SQL = """
WITH clk AS (
  SELECT event_id, user_id::varchar AS player, user_id || '-' || strftime(ts, '%Y%m%d') AS game_id, ts, event_type, value AS clock,
         row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id)::int AS ply
  FROM events)
"""
