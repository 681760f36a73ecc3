"""Tree scorers over cells of equal binned rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillog.operators import learn, trees

SCHEMA = "decision_id int, chosen boolean, signal double, noise double, kind string, is_validation boolean"


@pytest.fixture(scope="module")
def planted(spark):
    draw, rows = random.Random(6), []
    for d in range(300):
        signal = [draw.randrange(20) / 20 for _ in range(4)]
        first = signal.index(max(signal))
        rows += [(d, k == first, signal[k], draw.randrange(8) / 8, draw.choice(["a", "b"]), d % 5 == 0) for k in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def prepared(rows):
    rows = learn.balanced(rows)
    prep = learn.Preprocessor(["signal", "noise"], ["kind"]).fit(rows)
    frame = prep.transform(rows)
    return prep, frame, trees.Bins(prep).fit(frame)


def test_best_split_of_each_node_is_that_of_brute_force():
    draw = np.random.default_rng(3)
    widths, weights, least = np.array([[3, 2], [4, 3]]), np.array([0.7, 2.0]), 2
    parts = [[draw.integers(0, 9, (w, 2)) for w in row] for row in widths]
    got = trees.best_splits(np.concatenate([h for row in parts for h in row]), widths, weights, least)

    def impurity(c):
        w = c * weights
        return w.sum() - (w * w).sum() / w.sum() if w.sum() else 0.0

    for node, row in enumerate(parts):
        ways = [(impurity(h.sum(axis=0)) - impurity(h[: b + 1].sum(axis=0)) - impurity(h[b + 1 :].sum(axis=0)), j, b) for j, h in enumerate(row) for b in range(len(h)) if min(h[: b + 1].sum(), h[b + 1 :].sum()) >= least]
        best = max(ways, key=lambda x: x[0])
        assert got["gain"][node] == pytest.approx(best[0]) and (got["drawn"][node], got["cut"][node]) == best[1:]
        assert got["left"][node].tolist() == row[best[1]][: best[2] + 1].sum(axis=0).tolist()


def test_the_forest_finds_a_planted_signal(planted):
    _, frame, bins = prepared(planted)
    model = trees.BinnedForest(learn.forest(trees=12, depth=5), bins, cells_a_part=50).fit(frame)
    share = {r.root: r.fraction for r in learn.importance(model, frame).collect()}
    assert set(share) == {"signal", "noise", "kind"} and sum(share.values()) == pytest.approx(1) and share["signal"] > 0.6
    hits = model.transform(frame).groupBy("decision_id").agg(F.max_by("signal", "score").alias("s"), F.max("signal").alias("m"), F.count("*").alias("n"))
    assert hits.agg(F.min("n"), F.max("n"), F.avg((F.col("s") == F.col("m")).cast("int"))).first()[:2] == (4, 4)
    assert hits.agg(F.avg((F.col("s") == F.col("m")).cast("int"))).first()[0] > 0.8
    grown = model.grown
    split = np.argwhere(grown.feature >= 0)
    assert all((grown.counts[t, 2 * n] + grown.counts[t, 2 * n + 1] == grown.counts[t, n]).all() and min(grown.counts[t, 2 * n].sum(), grown.counts[t, 2 * n + 1].sum()) >= 6 for t, n in split)
    assert (abs(grown.counts[:, 1].sum(axis=1) - 1200) < 250).all()  # a bag has about as many rows as the table


def test_what_is_fitted_does_not_grow_with_the_rows(spark, planted):
    _, frame, bins = prepared(planted)
    forest = trees.BinnedForest(learn.forest(trees=4, depth=3), bins)
    once, often = forest._packed(frame)[0], forest._packed(frame.crossJoin(spark.range(20)))[0]
    cells = lambda packed: packed.select(F.explode("cells").alias("c")).agg(F.count("*").alias("k"), F.sum("c.n").alias("n")).first()
    assert cells(once).k == cells(often).k and (cells(once).n, cells(often).n) == (1200, 24000)
    forest.fit(frame.crossJoin(spark.range(20)))
    assert (abs(forest.grown.counts[:, 1].sum(axis=1) - 24000) < 1000).all()


def test_boosting_over_cells_scores_as_boosting_over_their_rows(planted):
    # Shallow trees, as splits of nodes of a few rows are often tied.
    _, frame, bins = prepared(planted)
    by_cell = trees.BinnedBoosted(learn.boosted(rounds=6).setMaxDepth(2), bins).fit(frame).transform(frame).select("decision_id", "signal", "noise", "kind", "score")
    rows = bins.vectors(bins.transform(frame).drop("features"))
    by_row = learn.boosted(rounds=6).setMaxDepth(2).fit(rows).transform(rows).select("decision_id", "signal", "noise", "kind", vector_to_array("probability")[1].alias("other"))
    both = by_cell.join(by_row, ["decision_id", "signal", "noise", "kind"])
    assert both.agg(F.max(F.abs(F.col("score") - F.col("other")))).first()[0] < 1e-9
