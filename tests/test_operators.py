"""Small frames for rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from quillog.functions import scalars as s
from quillog.operators import checks, compare, learn, splits
from quillog.operators import policy as pol


def test_mate_scale_and_chance(spark):
    df = spark.createDataFrame([(30, None), (None, 3), (None, -2), (None, 0)], "cp long, mate long")
    assert [r[0] for r in df.select(s.eval_to_cp(F.col("cp"), F.col("mate"))).collect()] == [30, 99_997, -99_998, 100_000]
    assert df.select(s.win_chance(F.lit(1e9))).first()[0] == 1.0


def test_rank_flags_are_three_valued(spark):
    df = spark.createDataFrame([(2, 5, 5), (None, 5, 5), (None, 2, 5), (None, 5, 2)], "r int, req int, n int")
    assert [x[0] for x in df.select(s.rank_flag(F.col("r"), 3, F.col("req"), F.col("n"))).collect()] == [True, False, None, None]


def test_time_control(spark):
    df = spark.createDataFrame([("300+3",), ("-",), (None,), ("5+",)], "t string")
    assert [(r[0].initial, r[0].increment) for r in df.select(s.time_control(F.col("t"))).collect()] == [(300, 3), (None, None), (None, None), (None, None)]


def test_leakage_guard():
    with pytest.raises(ValueError):
        checks.require_no_leakage(["phase", "chosen"])


def test_conflicts_collapse_equal_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, v string")
    assert [r.k for r in checks.conflicting_keys(df, ["k"]).collect()] == [2]


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    assert checks.fingerprint(df).first() == checks.fingerprint(df.repartition(7)).first()
    assert checks.fingerprint(df).first() != checks.fingerprint(df.where("id < 99")).first()


def test_prefix_stops_where_packing_skips(spark):
    rows = [("p", f"g{i}", n, 10 - i) for i, n in enumerate([4, 9, 2])]
    games = spark.createDataFrame(rows, "player string, game_id string, n long, t int").withColumn("played_at", F.timestamp_seconds("t"))
    order = [F.desc("played_at")]
    assert [r.game_id for r in splits.whole_game_prefix(games, 8, "n", order).collect()] == ["g0"]
    assert sorted(r.game_id for r in splits.greedy_pack(games, F.lit(8), groups=["player"], size="n").collect()) == ["g0", "g2"]


def test_sequential_acceptance_gives_games_back(spark):
    # b would share g1 with a, but a has too few games, so b keeps it.
    games = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("b", "g2"), ("c", "g2"), ("c", "g3")], "player string, game_id string")
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "player string, place int")
    assert [r.player for r in splits.accept_in_order(order, games, minimum=2, target=5).orderBy("place").collect()] == ["b"]


def test_softmax_and_temperature(spark):
    rows = [(1, True, 1.0), (1, False, 0.0), (2, True, 1.0), (2, False, 0.0), (3, False, 1.0), (3, True, 0.0)]
    df = spark.createDataFrame(rows, "decision_id int, chosen boolean, z double")
    assert all(abs(r[0] - 1) < 1e-12 for r in df.withColumn("p", pol.softmax(F.col("z"))).groupBy("decision_id").agg(F.sum("p")).select("sum(p)").collect())
    t, _ = pol.fit_temperature(df, "z")
    assert abs(t - 1 / math.log(2)) < 0.1  # two of three choose the better one


def test_unequal_pairs_are_marked(spark):
    a = spark.createDataFrame([(1, 0.0, "g"), (2, 1.0, "g")], "decision_id int, m double, game_id string")
    b = spark.createDataFrame([(1, 1.0, "g")], "decision_id int, m double, game_id string")
    got = {r.decision_id: (r.unmatched, r.m) for r in compare.paired(a, b, ["m"], ["game_id"]).collect()}
    assert got == {1: (False, 1.0), 2: (True, None)}


def test_bootstrap_of_a_constant(spark):
    totals = spark.createDataFrame([(f"g{i}", 2, 2.0) for i in range(30)], "game_id string, _n long, m double")
    r = compare.bootstrap(totals, "game_id", ["m"], resamples=50).first()
    assert (r.m_estimate, r.m_low, r.m_high) == (1.0, 1.0, 1.0)


def test_fit_lowers_the_objective(spark):
    rows = [("p", d, k, k == 1, 0.0, int(k == 1), 1.0) for d in range(20) for k in (1, 2)]
    feats = spark.createDataFrame(rows, "player string, decision_id int, engine_rank int, chosen boolean, base_logit double, idx int, val double")
    beta = learn.fit(feats, iterations=6).select("player", "idx", "beta")
    zero = beta.withColumn("beta", F.lit(0.0))
    assert learn.objective(feats, beta, 0.01).first().objective < learn.objective(feats, zero, 0.01).first().objective


def test_fit_converges_or_fails(spark):
    rows = [(p, d, k, k == 1 + d % 3 // 2, 0.0, int(k == 1), 1.0) for p in ("p", "q") for d in range(20) for k in (1, 2)]
    feats = spark.createDataFrame(rows, "player string, decision_id int, engine_rank int, chosen boolean, base_logit double, idx int, val double")
    assert max(abs(r.gradient) for r in learn.fit(feats, tolerance=1e-3).collect()) <= 1e-3
    with pytest.raises(learn.NotConverged):
        learn.fit(feats, tolerance=1e-9, iterations=2)


def test_pawn_structure_reads_the_board_without_lambdas(spark):
    """Interpreted lambdas that named the board made it anew for every square, far beyond the time of the query."""
    boards = {"P" + "." * 7 + "P.P....P" + "." * 40 + "...PP...": (6, 1, 3, 3), "P" * 64: (64, 56, 0, 1), "p" * 64: (0, 0, 0, 0), "": (0, 0, 0, 0), "." * 7 + "P": (1, 0, 1, 1), None: (None, 0, 0, 0)}
    df = spark.createDataFrame([(b,) for b in boards], "b string").select("b", s.pawn_structure(F.col("b"), "P").alias("w"))
    assert {r["b"]: tuple(r["w"]) for r in df.collect()} == boards
    assert "lambda" not in df._jdf.queryExecution().toString()


def test_packed_features_are_made_once(spark):
    """Neither the filter that Spark infers for an explode nor the phase's copy makes the features again."""
    rows = [("a", 1, 1, True, 0.5, "O", True, 2.0, "k", "m1"), ("a", 1, 2, False, 0.1, "X", False, 0.0, "k", "m2"), ("b", 2, 1, True, 0.2, None, None, None, "l", "m3"), ("b", 3, 1, True, 0.2, "F", True, float("nan"), "l", "m4")]
    cand = spark.createDataFrame(rows, "player string, decision_id long, engine_rank int, chosen boolean, base_logit double, phase string, flag boolean, n double, position_key string, move string")
    long = learn.sparse_features(cand, ("flag",), {"n": F.col("n")}, ["F", "O"], {"position_key": ["l"]})
    got = {}
    for r in long.collect():
        got.setdefault((r["decision_id"], r["engine_rank"]), []).append((r["idx"], str(r["val"])))
    own = {k: [x for x in v if x[0] < 9] for k, v in got.items()}
    assert own == {(1, 1): [(0, "1.0"), (1, "2.0"), (6, "1.0"), (7, "2.0")], (1, 2): [], (2, 1): [(2, "1.0")], (3, 1): [(0, "1.0"), (1, "nan"), (2, "1.0"), (3, "1.0"), (4, "nan"), (5, "1.0")]}
    assert all(sum(x[0] >= 9 for x in v) == 1 for v in got.values())
    assert long._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1


def test_coefficients_are_a_stored_table(spark):
    """Of a stored table Spark knows the size, so it broadcasts them and leaves the features where they are."""
    from quillog.plans.learn_queries import some_beta

    feats = spark.createDataFrame([("a", [(0, 1.0), (3, 2.0)])], "player string, x array<struct<idx:int,val:double>>")
    beta = some_beta(feats)
    assert beta.inputFiles() and {(r["idx"], round(r["beta"], 3)) for r in beta.collect()} == {(0, -0.15), (3, 0.0)}
