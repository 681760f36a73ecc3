"""Positions, ranks, ordered searches and the nearest centroids against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillog.operators import compare, metrics, ordering


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_running_totals(spark, ranges):
    draw = random.Random(1)
    rows = [(f"k{i:03}", draw.randrange(9) if i % 7 else None) for i in range(200)]
    got = ordering.running(spark.createDataFrame(rows, "k string, n long").repartition(5), ["k"], "n", ranges=ranges).collect()
    total = 0
    for row, (k, n) in zip(sorted(got), rows, strict=True):
        total += n or 0
        assert (row.k, row.upto) == (k, total)
    down = ordering.positions(spark.createDataFrame(rows, "k string, n long"), [F.desc("k")], ranges=ranges).collect()
    assert {r.k: r.position for r in down} == {k: 199 - i for i, (k, _) in enumerate(rows)}
    assert ordering.positions(spark.createDataFrame([], "k string"), ["k"]).count() == 0


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_average_ranks_share_ties(spark, broadcast):
    draw = random.Random(2)
    rows = [(i, draw.choice([3.0, 3.0, 3.0, 1.5, draw.random()]), draw.choice([None, 1, 2])) for i in range(500)]
    got = ordering.average_ranks(spark.createDataFrame(rows, "i int, x double, n int").repartition(7), {"x": "rx", "n": "rn"}, broadcast_rows=broadcast).collect()
    for column, name in ((1, "rx"), (2, "rn")):
        values = sorted(r[column] for r in rows if r[column] is not None)
        for r in got:
            v = rows[r.i][column]
            assert r[name] == (None if v is None else statistics.mean(k + 1 for k, x in enumerate(values) if x == v))


def test_spearman_with_many_ties(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(5), draw.randrange(4)) for _ in range(2_000)]
    rank = lambda xs: [(sorted(xs).index(x) + 1) + (xs.count(x) - 1) / 2 for x in xs]
    out = metrics.correlations(spark.createDataFrame(rows, "x int, y int"), "x", "y")
    a, b = (dict(zip(xs, rank(list(xs)), strict=True)) for xs in zip(*rows, strict=True))
    want = np.corrcoef([a[x] for x, _ in rows], [b[y] for _, y in rows])[0, 1]
    assert out.first().spearman == pytest.approx(want)
    same = metrics.correlations(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "x int, y int"), "x", "y").first()
    assert (same.n, same.pearson, same.spearman) == (3, None, None)


def test_next_cyclic(spark):
    names = [f"n{i}" for i in range(40)]
    got = {r.k: r.other for r in ordering.next_cyclic(spark.createDataFrame([(n,) for n in names * 3], "k string"), "k").collect()}
    ordered = sorted(names)
    assert got == {n: ordered[(i + 1) % 40] for i, n in enumerate(ordered)}
    assert [tuple(r) for r in ordering.next_cyclic(spark.createDataFrame([("a",)], "k string"), "k").collect()] == [("a", "a")]
    assert ordering.next_cyclic(spark.createDataFrame([], "k string"), "k").count() == 0


@pytest.mark.parametrize("n,fanout", [(1, 2), (2, 2), (37, 2), (150, 3), (300, 256)])
def test_next_below_is_the_first_in_cyclic_order(spark, n, fanout):
    draw = random.Random(n)
    rows = [(f"p{i:04}", draw.choice([None, *range(10)]), draw.choice([None, 4, 5, 9, 9, 9])) for i in range(n)]
    out = ordering.next_below(spark.createDataFrame(rows, "k string, cutoff int, last int").repartition(3), "k", "cutoff", "last", fanout=fanout)
    names = plan(out)
    assert "NestedLoop" not in names and "Cartesian" not in names
    want = {}
    for i, (k, cutoff, _) in enumerate(rows):
        after = [*rows[i + 1 :], *rows[:i]]
        want[k] = next((o for o, _, last in after if cutoff is not None and last is not None and last < cutoff), None)
    assert {r.k: r.other for r in out.collect()} == want


def test_next_below_without_values(spark):
    schema = "k string, cutoff int, last int"
    assert ordering.next_below(spark.createDataFrame([], schema), "k", "cutoff", "last").count() == 0
    assert [r.other for r in ordering.next_below(spark.createDataFrame([("a", 3, None), ("b", 3, None)], schema), "k", "cutoff", "last").collect()] == [None, None]


FIELDS = [("behaviour", "a"), ("behaviour", "b"), ("piece", "x"), ("piece", "y"), ("piece", "z"), ("sequence", "s")]


def distance(u, c, scale):
    families = []
    for family in dict.fromkeys(f for f, _ in FIELDS):
        own = [((u[f] - c[f]) / scale[f]) ** 2 for f in FIELDS if f[0] == family and f in u and f in c]
        if own:
            families.append(statistics.mean(own))
    return round(statistics.mean(families), 9) if families else None


@pytest.mark.parametrize("players,missing", [(60, 0.0), (60, 0.3), (3, 0.2), (1, 0.0)])
def test_nearest_centroids_match_all_pairs(spark, players, missing):
    draw = random.Random(players + int(10 * missing))
    vector = lambda: {f: draw.choice([0.0, 0.5, round(draw.gauss(0, 1), 2)]) for f in FIELDS if draw.random() >= missing}
    centres = {f"p{i}": vector() for i in range(players)}
    if players > 3:
        centres["p1"] = dict(centres["p0"])  # ties by name
    units = {f"u{i}": (f"p{draw.randrange(players)}", vector()) for i in range(80)}
    units = {u: (p, v) for u, (p, v) in units.items() if v}
    centres = {p: v for p, v in centres.items() if v}
    scale = {f: 0.5 + i / 10 for i, f in enumerate(FIELDS)}
    vectors = spark.createDataFrame([(u, p, *f, x) for u, (p, v) in units.items() for f, x in v.items()], "unit string, player string, family string, field string, value double")
    centroids = spark.createDataFrame([(p, *f, x) for p, v in centres.items() for f, x in v.items()], "player string, family string, field string, centre double")
    scales = spark.createDataFrame([(*f, x) for f, x in scale.items()], "family string, field string, scale double")
    out = metrics.style_identity(vectors, scales, centroids, "unit", broadcast_players=0)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = {r.unit: r for r in out.collect()}
    assert set(got) == set(units)
    for u, (true, v) in units.items():
        every = sorted((d, p) for p, c in centres.items() if (d := distance(v, c, scale)) is not None)
        place = next((i + 1 for i, (_, p) in enumerate(every) if p == true), None)
        r = got[u]
        assert (r.true_player, r.true_place) == (true, place)
        assert (r.best, r.best_distance) == ((every[0][1], pytest.approx(every[0][0], abs=2e-9)) if every else (None, None))


# --- bootstrap -------------------------------------------------------------------------------


def plain_bootstrap(units, resamples, seed):
    sums = np.zeros((2, resamples))
    for unit, n, x in units:
        for block in range(-(-resamples // 8)):
            digest = hashlib.sha256(f"{seed}:{block}:{unit}".encode()).hexdigest()
            for j in range(8):
                if block * 8 + j < resamples:
                    u = int(digest[8 * j : 8 * j + 8], 16) / 2**32
                    total, times = math.exp(-1), 0
                    while u >= total and times < 9:
                        times += 1
                        total += math.exp(-1) / math.factorial(times)
                    sums[:, block * 8 + j] += (times * n, times * (x or 0))
    return np.quantile(sums[1] / sums[0], (0.025, 0.975))


def test_bootstrap_matches_plain_draws(spark):
    draw = random.Random(4)
    units = [(f"g{i}", draw.randrange(1, 5), draw.gauss(0.1, 1) if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(units, "g string, _n long, x double")
    rows = [compare.bootstrap(df.repartition(k), "g", ["x"], resamples=100, seed=5, block=7).first() for k in (1, 5)]
    low, high = plain_bootstrap(units, 100, 5)
    for r in rows:
        assert (r.units, r.x_estimate) == (60, pytest.approx(sum(x or 0 for *_, x in units) / sum(n for _, n, _ in units)))
        assert (r.x_low, r.x_high) == (pytest.approx(low), pytest.approx(high))


def test_bootstrap_of_more_than_a_hundred_thousand_units(spark):
    totals = spark.range(120_000).select("id", F.lit(1).alias("_n"), ((F.hash("id") % 1000) / 1000).alias("x"))
    r = compare.bootstrap(totals, "id", ["x"], resamples=80).first()
    assert r.units == 120_000
    deviation = totals.agg(F.stddev_pop("x")).first()[0] / math.sqrt(120_000)
    assert r.x_low < r.x_estimate < r.x_high and 2 < (r.x_high - r.x_low) / deviation < 6  # no unit is merged with another


def test_bootstrap_without_units(spark):
    r = compare.bootstrap(spark.createDataFrame([], "g string, _n long, x double"), "g", ["x"], resamples=16).first()
    assert tuple(r) == (0, None, None, None)
