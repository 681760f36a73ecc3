"""Listwise fits and temperatures against independent optimisers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillog.operators import learn
from quillog.operators import policy as pol


def choices(seed, players, decisions, width):
    """Rows (player, decision_id, engine_rank, chosen, base_logit, idx, val) of made-up choices."""
    draw, rows = random.Random(seed), []
    for p in range(players):
        taste = [draw.gauss(0, 1) for _ in range(width)]
        for d in range(decisions):
            cands = [(draw.gauss(0, 1), {i: draw.choice([1.0, 0.5, -2.0]) for i in range(width) if draw.random() < 0.5}) for _ in range(draw.randrange(1, 5))]
            utility = [b + sum(taste[i] * v for i, v in x.items()) + draw.gauss(0, 1) for b, x in cands]
            best = utility.index(max(utility))
            for k, (b, x) in enumerate(cands):
                rows += [(f"p{p}", d, k + 1, k == best, b, 10 * i, v) for i, v in (x or {0: 0.0}).items()]
    return rows


def newton(rows, penalty):
    """Coefficients of one player by dense Newton steps."""
    groups: dict = {}
    for _, d, k, chosen, base, i, v in rows:
        groups.setdefault(d, {}).setdefault(k, (chosen, base, {}))[2][i] = v
    places = sorted({r[5] for r in rows})
    beta = np.zeros(len(places))
    for _ in range(60):
        g, hess, n = penalty * beta, penalty * np.eye(len(places)), len(groups)
        for cands in groups.values():
            x = np.array([[c[2].get(i, 0.0) for i in places] for c in cands.values()])
            y = np.array([float(c[0]) for c in cands.values()])
            z = np.array([c[1] for c in cands.values()]) + x @ beta
            p = np.exp(z - z.max())
            p /= p.sum()
            g = g + x.T @ (p - y) / n
            hess = hess + (x.T @ np.diag(p) @ x - np.outer(x.T @ p, x.T @ p)) / n
        beta = beta - np.linalg.solve(hess, g)
    return dict(zip(places, beta, strict=True))


SCHEMA = "player string, decision_id int, engine_rank int, chosen boolean, base_logit double, idx int, val double"


@pytest.mark.parametrize("broadcast", [0, 100])
def test_fit_equals_an_independent_fit(spark, broadcast):
    rows = choices(1, 3, 60, 6)
    feats = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = learn.fit(feats, tolerance=1e-8, broadcast_players=broadcast).collect()
    for player in ("p0", "p1", "p2"):
        want = newton([r for r in rows if r[0] == player], 0.01)
        have = {r.idx: r.beta for r in got if r.player == player}
        assert have == {i: pytest.approx(b, abs=1e-6) for i, b in want.items()}
    assert max(abs(r.gradient) for r in got) <= 1e-8


def test_fitted_objective_is_that_of_the_batch_operators(spark):
    feats = spark.createDataFrame(choices(2, 2, 40, 4), SCHEMA)
    fitted = learn.fit(feats, tolerance=1e-7)
    beta = fitted.select("player", "idx", "beta")
    want = {r.player: r.objective for r in learn.objective(feats, beta, 0.01).collect()}
    slopes = {(r.player, r.idx): r.gradient for r in learn.gradient(feats, beta, 0.01).collect()}
    for r in fitted.collect():
        assert r.objective == pytest.approx(want[r.player], rel=1e-10) and r.gradient == pytest.approx(slopes[r.player, r.idx], abs=1e-10)


def test_passes_are_few_and_counted(spark):
    feats = spark.createDataFrame(choices(3, 4, 50, 8), SCHEMA)
    ended = learn.fit_state(feats, tolerance=1e-6).collect()
    assert all(r.done for r in ended) and 3 < max(r.looks for r in ended) < 60


def test_one_player_in_many_chunks(spark):
    rows = choices(4, 1, 300, 3)
    assert learn.chunks(spark.createDataFrame(rows, SCHEMA), size=20).count() > 10
    got = {r.idx: r.beta for r in learn.fit(spark.createDataFrame(rows, SCHEMA), tolerance=1e-8).collect()}
    assert got == {i: pytest.approx(b, abs=1e-6) for i, b in newton(rows, 0.01).items()}


def test_fits_of_nothing(spark):
    assert learn.fit(spark.createDataFrame([], SCHEMA), tolerance=1e-6).count() == 0
    undecided = spark.createDataFrame([("p", 1, 1, False, 0.0, 3, 1.0), ("p", 1, 2, False, 0.0, 4, 1.0)], SCHEMA)
    assert [(r.idx, r.beta) for r in learn.fit(undecided, tolerance=1e-6).orderBy("idx").collect()] == [(3, 0.0), (4, 0.0)]


# --- temperature -----------------------------------------------------------------------------


def losses(rows, t):
    groups: dict = {}
    for d, chosen, z in rows:
        groups.setdefault(d, []).append((chosen, z))
    out = []
    for cands in groups.values():
        top = max(z for _, z in cands)
        picked = [z for chosen, z in cands if chosen]
        if picked:
            out.append(min(math.log(sum(math.exp((z - top) / t) for _, z in cands)) - (max(picked) - top) / t, 34.538776394910684))
    return sum(out) / len(out)


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 8.0), (3, 0.3)])
def test_temperature_is_the_minimum(spark, seed, scale):
    draw, rows = random.Random(seed), []
    for d in range(200):
        z = [draw.gauss(0, scale) for _ in range(draw.randrange(1, 6))]
        noisy = [x / scale + draw.gauss(0, 1) for x in z]
        rows += [(d, noisy[k] == max(noisy), x) for k, x in enumerate(z)]
    t, nll = pol.fit_temperature(spark.createDataFrame(rows, "decision_id int, chosen boolean, z double"), "z")
    assert nll == pytest.approx(losses(rows, t), abs=1e-9)
    slope = (losses(rows, t * math.exp(1e-5)) - losses(rows, t * math.exp(-1e-5))) / 2e-5
    assert abs(slope) < 1e-7  # T to about 1e-6
    assert all(losses(rows, t) <= losses(rows, x) + 1e-12 for x in (0.05, 0.5, 1.0, 2.0, 20.0, t * 1.01, t / 1.01))


def test_temperature_at_its_bounds(spark):
    schema = "decision_id int, chosen boolean, z double"
    sure = spark.createDataFrame([(d, k == 0, float(-k)) for d in range(5) for k in range(2)], schema)
    assert pol.fit_temperature(sure, "z")[0] == pytest.approx(0.05)
    wrong = spark.createDataFrame([(d, k == 1, float(-k)) for d in range(5) for k in range(2)], schema)
    assert pol.fit_temperature(wrong, "z")[0] == pytest.approx(20.0)
    assert pol.fit_temperature(spark.createDataFrame([], schema), "z") == (1.0, 0.0)


def test_two_of_three_choose_the_better_one(spark):
    rows = [(1, True, 1.0), (1, False, 0.0), (2, True, 1.0), (2, False, 0.0), (3, False, 1.0), (3, True, 0.0)]
    t, _ = pol.fit_temperature(spark.createDataFrame(rows, "decision_id int, chosen boolean, z double"), "z")
    assert t == pytest.approx(1 / math.log(2), abs=1e-8)


# --- tree scorers ----------------------------------------------------------------------------


def test_trainers_have_full_size_by_default(spark):
    forest, boosted = learn.forest(), learn.boosted()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getFeatureSubsetStrategy()) == (160, 10, 6, "sqrt")
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (50, 6, 0.05)


@pytest.fixture(scope="module")
def planted(spark):
    draw, rows = random.Random(6), []
    for d in range(400):
        signal = [draw.random() for _ in range(4)]
        for k in range(4):
            rows.append((d, k, signal[k] == max(signal), signal[k], draw.random(), draw.choice(["a", "b"]), d % 5 == 0))
    return spark.createDataFrame(rows, "decision_id int, engine_rank int, chosen boolean, signal double, noise double, kind string, is_validation boolean")


@pytest.mark.parametrize("trainer", [lambda: learn.forest(trees=12, depth=5), lambda: learn.boosted(rounds=8)])
def test_a_planted_signal_is_found(planted, trainer):
    rows = learn.balanced(planted)
    prep = learn.Preprocessor(["signal", "noise"], ["kind"]).fit(rows)
    frame = prep.transform(rows)
    model = trainer().fit(frame)
    share = {r.root: r.fraction for r in learn.importance(model, frame).collect()}
    assert set(share) == {"signal", "noise", "kind"} and sum(share.values()) == pytest.approx(1) and share["signal"] > 0.6
    scored = model.transform(frame).withColumn("score", vector_to_array("probability")[1]).withColumn("p", pol.normalized(F.col("score")))
    sums = scored.groupBy("decision_id").agg(F.sum("p").alias("s"), F.max_by("chosen", "p").alias("hit"))
    worst, hits = sums.agg(F.max(F.abs(1 - F.col("s"))), F.avg(F.col("hit").cast("int"))).first()
    assert worst < 1e-9 and hits > 0.8


def test_weights_balance_the_training_labels(planted):
    train = planted.where("decision_id < 100")
    rows = learn.balanced(planted, train).where("decision_id < 100")
    totals = {r.chosen: r.w for r in rows.groupBy("chosen").agg(F.sum("weight").alias("w")).collect()}
    assert totals[True] == pytest.approx(totals[False])


# --- chunks ----------------------------------------------------------------------------------


def unpacked(rows):
    """(player, decision's candidates as (chosen, base_logit, entries)) of chunks."""
    for row in rows:
        sizes, chosen, base, widths, idx, val = (np.frombuffer(row[c], dtype=kind).tolist() for c, kind in learn.PACKED.items())
        at, cands = 0, []
        for c, b, w in zip(chosen, base, widths, strict=True):
            cands.append((bool(c), b, tuple(sorted(zip(idx[at : at + w], val[at : at + w], strict=True)))))
            at += w
        assert at == len(idx) and sum(sizes) == len(cands)
        at = 0
        for n in sizes:
            yield row["player"], tuple(sorted(cands[at : at + n]))
            at += n


@pytest.mark.parametrize("rows_at_once", [1, 7, 65_536])
def test_chunks_made_from_values_hold_what_the_packed_features_hold(spark, rows_at_once):
    draw, rows = random.Random(9), []
    for d in range(120):
        for k in range(draw.randrange(1, 6)):
            rows.append((f"p{d % 5}", d, k + 1, k == 0, draw.random(), draw.choice(["F", "O", "X", None]), draw.random() < 0.5, draw.choice([None, 0.0, 0.5, -2.0]), draw.choice(["a", "b", None]), f"k{k}", f"m{d}"))
    cand = spark.createDataFrame(rows, "player string, decision_id int, engine_rank int, chosen boolean, base_logit double, phase string, flag boolean, size double, kind string, position_key string, move string")
    args = (("flag",), {"size": F.col("size")}, ["F", "O"], {"kind": ["a", "b"]})
    want = sorted(unpacked(learn.chunks(learn.packed_features(cand, *args), size=10).collect()))
    assert want == sorted(unpacked(learn.chunked_features(cand, *args, rows_at_once=rows_at_once).collect()))
    assert len(want) == 120
    dealt = learn.chunks(learn.packed_features(cand, *args), size=10, undealt_players=2).collect()
    assert want == sorted(unpacked(dealt))


def test_a_fit_of_given_chunks_and_its_start(spark):
    rows = choices(5, 2, 80, 3)
    feats = spark.createDataFrame(rows, SCHEMA)
    stored = learn.written(learn.chunks(feats))
    for player in ("p0", "p1"):
        got = {r.idx: r.beta for r in learn.fit(stored, tolerance=1e-8).where(F.col("player") == player).collect()}
        assert got == {i: pytest.approx(b, abs=1e-6) for i, b in newton([r for r in rows if r[0] == player], 0.01).items()}
    zero = feats.select("player", "idx").distinct().withColumn("beta", F.lit(0.0))
    want = {r.player: pytest.approx(r.objective, rel=1e-12) for r in learn.objective(feats, zero, 0.01).collect()}
    assert {r.player: r.objective for r in learn.base_objective(stored).collect()} == want
