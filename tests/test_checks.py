"""Checks over sets of keys and candidates, and how often they read their sides."""

from __future__ import annotations

from quillog.operators import checks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_complement_meets_both_sides_once(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (3,), (3,), (None,)], "k int")
    out = checks.exact_complement(left, right, ["k"])
    assert sorted((r.k, r.side) for r in out.collect()) == [(1, "left"), (3, "right")]
    assert "Join" not in plan(out)


def test_candidate_sets_are_counted_without_making_rows_three(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a"), (3, 1, "a"), (3, 1, "b"), (4, 2, "a"), (4, 3, None)]
    bad = checks.bad_candidate_sets(spark.createDataFrame(rows, "decision_id int, engine_rank int, move string"), 2)
    assert "Expand" not in plan(bad)
    assert sorted((r.decision_id, r.ranks, r.moves) for r in bad.collect()) == [(2, 2, 1), (3, 1, 2), (4, 2, 1)]
