"""Exact quantiles by distributed selection against whole groups in numpy, whatever the partitioning."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillog.operators import compare, learn, metrics, order_stats


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def exact(values, p):
    return float(np.quantile(np.array(values, dtype=float), p)) if values else None


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_quantiles_of_large_groups(spark, partitions):
    draw = random.Random(5)
    rows = []
    for i in range(30_000):
        key = ["hot", "hot", "hot", "cold", None][i % 5]
        rows.append((key, draw.lognormvariate(0, 3), draw.choice([1, 1, 2, 5, 1_000_000_007]) if key != "cold" else None))
    rows += [("one", 4.25, 3), ("none", None, None), ("odd", float("nan"), 1), ("odd", float("inf"), 2), ("odd", -1.0, 9)]
    df = spark.createDataFrame(rows, "k string, x double, n long").repartition(partitions)
    wanted = {"low": ("x", 0.0), "mid": ("x", 0.5), "p95": ("x", 0.95), "high": ("x", 1.0), "whole": ("n", 0.5)}
    got = {r.k: r for r in order_stats.quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {"hot", "cold", None, "one", "odd"}
    for key in ("hot", "cold", None, "one"):
        xs, ns = [x for k, x, _ in rows if k == key], [n for k, _, n in rows if k == key and n is not None]
        for name, p in (("low", 0.0), ("mid", 0.5), ("p95", 0.95), ("high", 1.0)):
            assert got[key][name] == pytest.approx(exact(xs, p), rel=1e-14), (key, name)
        assert got[key].whole == exact(ns, 0.5)
    assert got["odd"].low == -1.0 and got["odd"].high == pytest.approx(1.7976931348623157e308) and got["odd"].whole == 2.0


def test_few_buckets_and_no_broadcast_give_the_same(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("k"), (F.hash("id") / 7).alias("x"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("x", 0.5).alias("m")).collect()}
    got = {r.k: r.m for r in order_stats.quantiles(df, ["k"], {"m": ("x", 0.5)}, buckets=3, broadcast_rows=0).collect()}
    assert got == pytest.approx(want)


def test_wide_ranges_end(spark):
    values = [10.0**k for k in range(-300, 301, 3)] * 3
    got = order_stats.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), [], {"m": ("x", 0.5), "q": ("x", 0.25)}).first()
    assert (got.m, got.q) == (exact(values, 0.5), exact(values, 0.25))


def test_empty_tables_and_missing_groups(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert order_stats.quantiles(none, ["k"], {"m": ("x", 0.5)}).count() == 0
    alone = order_stats.with_quantiles(none.agg(F.count("*").alias("n")), none, [], {"m": ("x", 0.5)}).collect()
    assert [tuple(r) for r in alone] == [(0, None)]
    rows = spark.createDataFrame([("a", 1.0), (None, 3.0), ("b", None)], "k string, x double")
    summary = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert {(r.k, r.m) for r in order_stats.with_quantiles(summary, rows, ["k"], {"m": ("x", 0.5)}).collect()} == {("a", 1.0), (None, 3.0), ("b", None)}


def test_summaries_hold_no_percentile_buffer(spark):
    df = spark.range(10_000).select((F.col("id") % 2).cast("string").alias("phase"), F.col("id").alias("loss"))
    out = metrics.summary(df, ["phase"], [F.count("*").alias("n")], {"median_loss": ("loss", 0.5)})
    assert "percentile" not in plan(out) and "median(" not in plan(out)
    assert {(r.dimension, r.value, r.n, r.median_loss) for r in out.collect()} == {("all", "all", 10_000, 4999.5), ("phase", "0", 5_000, 4999.0), ("phase", "1", 5_000, 5000.0)}
    timed = compare.timing(df, "loss")
    assert "percentile" not in plan(timed)
    r = timed.first()
    assert (r.n, r["mean"], r.p50, r.p95, r.total) == (10_000, 4999.5, 4999.5, pytest.approx(9499.05), 49_995_000.0)


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_preprocessing_is_the_same_in_any_partitioning(spark, partitions):
    draw = random.Random(2)
    train = [(draw.random() * 1e4, None, draw.choice(["b", "a", None]), "x") for _ in range(10_001)]
    seen = spark.createDataFrame(train, "rating double, never double, wing string, kind string").repartition(partitions)
    fitted = learn.Preprocessor(["rating", "never"], ["wing", "kind"]).fit(seen)
    assert fitted.medians == {"rating": statistics.median(r[0] for r in train), "never": 0.0}
    assert fitted.levels == {"wing": [learn.MISSING, "a", "b"], "kind": ["x"]}
    new = spark.createDataFrame([(None, 2.0, "a", "x"), (1.0, None, None, None), (2.0, None, "zz", "y")], "rating double, never double, wing string, kind string")
    got = fitted.transform(new).collect()
    assert [(r.rating_filled, r.never_filled, r.wing_index, r.kind_index) for r in got] == [(fitted.medians["rating"], 2.0, 1.0, 0.0), (1.0, 0.0, 0.0, 1.0), (2.0, 0.0, 3.0, 1.0)]
    assert [list(r.features.toArray()) for r in got][1] == [1.0, 0.0, 1, 0, 0, 0, 0, 1]  # missing is a category of wing, and unknown to kind


def test_preprocessing_needs_rows_and_takes_no_categories(spark):
    empty = spark.createDataFrame([], "rating double")
    with pytest.raises(ValueError):
        learn.Preprocessor(["rating"], []).fit(empty)
    one = spark.createDataFrame([(3.0,), (None,)], "rating double")
    assert [list(r.features.toArray()) for r in learn.Preprocessor(["rating"], []).fit(one).transform(one).collect()] == [[3.0], [3.0]]
