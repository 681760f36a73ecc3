"""Steps whose work or written bytes would outgrow their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillog.functions import scalars as s
from quillog.operators import order_stats
from quillog.operators.ordering import segmented, segmented_all
from quillog.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_feature_table_reads_lines_twice_and_writes_nothing(spark, sf_dir):
    text = plan(registry.queries()["join_feature_table"](spark, sf_dir))
    assert "LogicalRDD" not in text  # no checkpoint
    assert text.count("l_orderkey#") and text.count("Relation [l_orderkey#") == 2 and text.count("Relation [o_orderkey#") == 1


def test_numbers_of_men_give_the_columns_of_the_board(spark):
    boards = spark.createDataFrame([("rnbqkbnrpppppppp" + "." * 32 + "PPPPPPPPRNBQKBNR", "w"), ("Qq.R" + "." * 60, "b"), ("." * 64, "w")], "board string, mover string")
    b, mover = F.col("board"), F.col("mover")
    count = s.men_counter(F.col("men"), s.count_of(b, "A-Za-z"))
    got = boards.withColumn("men", s.men_of(b)).select(s.men_balance(F.col("men"), mover), s.game_phase(b, count), s.count_of(b, "NnBb"), s.count_of(b, "A-Za-z"))
    want = boards.select(s.material_balance(b, mover), s.game_phase(b), F.length(F.regexp_replace(b, "[^NnBb]", "")), F.length(F.regexp_replace(b, "[^A-Za-z]", "")))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] == [(0, "opening", 8, 32), (-5, "middlegame", 0, 3), (0, "endgame", 0, 0)]


def test_the_history_encoder_makes_candidates_once(spark, sf_dir):
    text = plan(registry.queries()["win_history_encoder"](spark, sf_dir))
    assert "l_orderkey" not in text  # all that is left to do reads the written decisions and offsets


def test_sets_of_running_sums_equal_one_after_another(spark):
    one = F.lit(1).cast("bigint")
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 5 > 0, "hot").alias("k"), (F.col("id") % 3).alias("c"), F.floor(F.col("id") / 400).alias("_bucket"))
    first, second = {"a": one, "s": F.col("id")}, {"b": F.when(F.col("id") % 7 > 0, one)}
    want = segmented(segmented(rows, ["k"], ["id"], first), ["k", "c"], ["id"], second)
    got = segmented_all(rows.repartition("k", "_bucket"), [(["k"], first), (["k", "c"], second)], ["id"])
    columns = ["id", "k", "c", "a", "s", "b"]
    assert sorted(got.select(columns).collect(), key=lambda r: r.id) == sorted(want.select(columns).collect(), key=lambda r: r.id)


def test_counted_quantiles_read_the_rows_once_and_are_the_same(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.pmod(F.hash("id"), F.lit(5_000)) - 1_000).cast("double").alias("x")).mapInPandas(seen, "k bigint, x double")
    wanted = {"low": ("x", 0.0), "mid": ("x", 0.5), "p95": ("x", 0.95)}
    want = sorted(order_stats.quantiles(rows, ["k"], wanted, buckets=8, few=100).collect())
    reads.value = 0
    got = sorted(order_stats.quantiles(rows, ["k"], wanted, buckets=8, few=100, counted=True).collect())
    assert got == want and len(got) == 3 and reads.value == 30_000
