"""Queries of quality, thresholds, paired comparison and gates, for two policies on the test split."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.operators import compare as c
from quillog.operators import metrics as m
from quillog.operators import policy as pol
from quillog.session import durable
from quillog.sources.bindings import FLAGS, LOG_SQL, candidates

from .history_queries import with_split
from .metric_queries import POLICY_SQL, PRED_SQL, rounded, test_predictions
from .registry import query

Q_SQL = LOG_SQL + """, two AS (SELECT *, count(*) OVER (PARTITION BY decision_id) AS n FROM cand),
  base AS (SELECT decision_id, max(player) AS player, max(game_id) AS game_id, max(phase) AS phase, CASE WHEN month(max(played_at)) % 2 = 0 THEN 'white' ELSE 'black' END AS color, (floor(max(rating) / 1000) * 1000)::bigint::varchar AS band, max(time_control) AS time_control, max(n) AS n, max(score_cp) FILTER (chosen) AS a, max(score_cp) FILTER (engine_rank = least(2, n)) AS p2, max(score_cp) FILTER (engine_rank = n) AS p9, max(score_cp) FILTER (engine_rank = 1) AS r,
    max(move) FILTER (chosen) AS am, max(move) FILTER (engine_rank = least(2, n)) AS m2, max(move) FILTER (engine_rank = n) AS m9 FROM two GROUP BY 1),
  ql AS (SELECT decision_id, player, game_id, phase, color, band, time_control, method, CASE WHEN decision_id % 19 = 0 THEN NULL ELSE a END AS actual_cp, CASE WHEN decision_id % 23 = 0 THEN NULL WHEN method = 'second' THEN p2 ELSE p9 END AS predicted_cp, r AS reference_cp,
    CASE WHEN decision_id % 19 = 0 THEN 'winning_mate' ELSE 'finite' END AS actual_outcome, CASE WHEN decision_id % 23 = 0 THEN CASE WHEN decision_id % 2 = 0 THEN 'missing' ELSE 'winning_mate' END ELSE 'finite' END AS predicted_outcome,
    am = CASE WHEN method = 'second' THEN m2 ELSE m9 END AS exact FROM base CROSS JOIN (VALUES ('second'), ('last')) t(method)),
  qc AS (SELECT *, predicted_cp - actual_cp AS delta, abs(predicted_cp - actual_cp) AS gap, CASE WHEN predicted_cp IS NOT NULL THEN greatest(reference_cp - predicted_cp, 0) END AS predicted_regret, CASE WHEN actual_cp IS NOT NULL THEN greatest(reference_cp - actual_cp, 0) END AS actual_regret, predicted_cp > reference_cp AS exceeds FROM ql),
  wp AS (SELECT *, 100 / (1 + exp(-0.00368208 * actual_cp)) AS wa, 100 / (1 + exp(-0.00368208 * predicted_cp)) AS wpr, 100 / (1 + exp(-0.00368208 * reference_cp)) AS wr FROM qc),
  pp AS (SELECT *, abs(wpr - wa) AS human_gap, wpr - wa AS signed_gap, CASE WHEN wpr IS NOT NULL THEN greatest(0.0, wr - wpr) END AS predicted_loss, CASE WHEN wa IS NOT NULL THEN greatest(0.0, wr - wa) END AS actual_loss FROM wp)"""


def quality(spark, sf_dir):
    """One row per decision and method: the second candidate and the last one as predictions."""
    rank, chosen = F.col("engine_rank"), F.col("chosen")
    base = candidates(spark, sf_dir).groupBy("decision_id").agg(
        F.max("player").alias("player"), F.max("game_id").alias("game_id"), F.max("phase").alias("phase"), F.when(F.month(F.max("played_at")) % 2 == 0, "white").otherwise("black").alias("color"), (F.floor(F.max("rating") / 1000) * 1000).cast("bigint").cast("string").alias("band"), F.max("time_control").alias("time_control"), F.max(F.when(chosen, F.col("score_cp"))).alias("a"), F.max(F.when(chosen, F.col("move"))).alias("am"),
        F.max(F.when(rank == 1, F.col("score_cp"))).alias("reference_cp"), F.max(F.when(rank <= 2, F.struct("engine_rank", "score_cp", "move"))).alias("second"), F.max(F.struct("engine_rank", "score_cp", "move")).alias("last"),
    )
    k = F.col("decision_id")
    long = base.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("pick")) for n in ("second", "last")])).alias("x"))
    gone, lost = k % 19 == 0, k % 23 == 0
    return long.select(
        "decision_id", "player", "game_id", "phase", "color", "band", "time_control", "x.method", F.when(~gone, F.col("a")).alias("actual_cp"), F.when(~lost, F.col("x.pick.score_cp")).alias("predicted_cp"), "reference_cp",
        F.when(gone, "winning_mate").otherwise("finite").alias("actual_outcome"), F.when(lost, F.when(k % 2 == 0, "missing").otherwise("winning_mate")).otherwise("finite").alias("predicted_outcome"), (F.col("am") == F.col("x.pick.move")).alias("exact"),
    )


@query("qual_compare", Q_SQL + "SELECT decision_id, method, gap, delta, predicted_regret, actual_regret, exceeds AS exceeds_reference, " + ", ".join(f"gap <= {t} AS within_{t}" for t in c.WITHIN) + " FROM qc")
def qual_compare(spark, sf_dir):
    return c.compare_scores(quality(spark, sf_dir)).select("decision_id", "method", "gap", "delta", "predicted_regret", "actual_regret", "exceeds_reference", *[f"within_{t}" for t in c.WITHIN])


_MATE = "(contains(actual_outcome, 'mate') OR contains(predicted_outcome, 'mate'))"
_QS = "count(*) AS decisions, count(gap) AS finite_pairs, count_if(gap IS NULL) AS excluded_pairs, count_if(gap IS NOT NULL AND NOT exact) AS different_finite, round(avg(exact::int), 9) AS exact_accuracy, " + ", ".join(
    f"round(avg({x}), 9) AS mean_{x}, median({x})::double AS median_{x}" for x in ("gap", "delta", "predicted_regret", "actual_regret")) + ", " + ", ".join(f"round(avg((gap <= {t})::int), 9) AS within_{t}, round(avg((gap <= {t})::int) FILTER (NOT exact), 9) AS different_within_{t}" for t in c.WITHIN) + f""",
  count_if({_MATE}) AS mate_pairs, round(avg((actual_outcome = predicted_outcome)::int) FILTER ({_MATE}), 9) AS mate_agreement, count_if(predicted_outcome = 'missing') AS missing_pairs, count_if(exceeds) AS exceeds_count"""


_DIMENSIONS = ("player", "phase", "color", "band", "time_control")
_MACRO = ("exact_accuracy", "mean_gap", "mean_predicted_regret", "within_50")


@query("qual_summary", Q_SQL + f""", sm AS (SELECT method, CASE {' '.join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in _DIMENSIONS)} ELSE 'all' END AS dimension, coalesce({', '.join(_DIMENSIONS)}, 'all') AS value, {_QS} FROM qc GROUP BY GROUPING SETS ({', '.join(f'(method, {d})' for d in _DIMENSIONS)}, (method))),
  ma AS (SELECT method, {', '.join(f'round(avg({c}), 7) AS macro_{c}' for c in _MACRO)} FROM sm WHERE dimension = 'player' GROUP BY 1) SELECT sm.*, {', '.join(f"CASE WHEN dimension = 'all' THEN macro_{c} END AS macro_{c}" for c in _MACRO)} FROM sm JOIN ma USING (method)""")
def qual_summary(spark, sf_dir):
    """Per method for all decisions and by five dimensions; the row of all also has means over players."""
    rows = c.compare_scores(quality(spark, sf_dir))
    each = rounded(c.quality_summary(rows, list(_DIMENSIONS), ["method"]))
    over = F.col("dimension") == "player"
    everyone = Window.partitionBy("method")  # over the few rows of the summary
    return each.select("*", *[F.when(F.col("dimension") == "all", F.round(F.avg(F.when(over, F.col(x))).over(everyone), 7)).alias(f"macro_{x}") for x in _MACRO])


@query("qual_convert_pp", Q_SQL + "SELECT decision_id, method, " + ", ".join(f"round({x}, 7) AS {x}" for x in ("human_gap", "signed_gap", "predicted_loss", "actual_loss")) + " FROM pp")
def qual_convert_pp(spark, sf_dir):
    return c.to_points(quality(spark, sf_dir)).select("decision_id", "method", *[F.round(x, 7).alias(x) for x in ("human_gap", "signed_gap", "predicted_loss", "actual_loss")])


@query("qual_threshold_select", Q_SQL + ", u AS (SELECT DISTINCT decision_id, actual_loss FROM pp), g AS (SELECT t, avg((actual_loss <= t)::int) AS c FROM u CROSS JOIN (VALUES (0.5::double), (1.0), (2.0), (3.0), (5.0), (10.0)) v(t) GROUP BY 1) SELECT min(t) FILTER (c >= 0.75) AS tolerance, (SELECT count(actual_loss) FROM u) AS pairs, 0 AS inconsistent FROM g")
def qual_threshold_select(spark, sf_dir):
    return c.select_threshold(c.to_points(quality(spark, sf_dir))).select("tolerance", "pairs", "inconsistent")


_WS = "count(*) AS decisions, " + ", ".join(
    f"round(avg((human_gap <= 3)::int) FILTER ({w}), 9) AS {n}_similar, round(avg((predicted_loss <= 3)::int) FILTER ({w}), 9) AS {n}_sound, round(avg((human_gap <= 3 AND predicted_loss <= 3)::int) FILTER ({w} AND human_gap IS NOT NULL AND predicted_loss IS NOT NULL), 9) AS {n}_joint, "
    + ", ".join(f"round(avg((human_gap <= {t})::int) FILTER ({w}), 9) AS {n}_similar_{str(t).replace('.', '_')}" for t in c.GRID) for n, w in (("all", "true"), ("different", "NOT exact")))


@query("qual_wc_summary", Q_SQL + f"SELECT method, {_WS} FROM pp GROUP BY 1")
def qual_wc_summary(spark, sf_dir):
    return rounded(c.to_points(quality(spark, sf_dir)).groupBy("method").agg(*c.winning_chance_columns(3.0, 3.0)))


@query("qual_severity_hist", Q_SQL + ", b AS (SELECT CASE WHEN predicted_loss < 1 THEN '<1' WHEN predicted_loss < 3 THEN '<3' WHEN predicted_loss < 5 THEN '<5' WHEN predicted_loss < 10 THEN '<10' ELSE '>=10' END AS bucket FROM pp WHERE method = 'last' AND predicted_loss IS NOT NULL) SELECT v.bucket, count(b.bucket) AS n, round(count(b.bucket) / (SELECT count(*) FROM b), 9) AS rate FROM (VALUES ('<1'), ('<3'), ('<5'), ('<10'), ('>=10')) v(bucket) LEFT JOIN b USING (bucket) GROUP BY 1")
def qual_severity_hist(spark, sf_dir):
    return rounded(c.severity(c.to_points(quality(spark, sf_dir).where("method = 'last'"))))


# --- paired comparison -----------------------------------------------------------------------


def two_methods(spark, sf_dir):
    """Per-decision results of the softmax policy and of always naming the first rank."""
    model = test_predictions(spark, sf_dir)
    cs = with_split(spark, sf_dir).where("split = 'test'").withColumn("p", (F.col("engine_rank") == 1).cast("double"))
    return m.predictions(cs, "p", FLAGS), model


PAIR_SQL = PRED_SQL + ", blp AS (SELECT *, (engine_rank = 1)::int::double AS bp FROM cs WHERE split = 'test'), blr AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY bp DESC, move) AS bi FROM blp), bl AS (SELECT decision_id, (max(bi) FILTER (chosen))::int AS r, sum((bp - chosen::int) ** 2) AS brier FROM blr GROUP BY 1), df AS (SELECT pred.*, (exact::int - (bl.r = 1)::int)::double AS d_exact, pred.brier - bl.brier AS d_brier, bl.r AS base_rank FROM pred JOIN bl USING (decision_id))"


@query("join_paired_methods", PAIR_SQL + "SELECT decision_id, false AS unmatched, d_exact AS exact, round(d_brier, 9) AS brier FROM df")
def join_paired_methods(spark, sf_dir):
    base, model = two_methods(spark, sf_dir)
    return c.paired(base, model, ["exact", "brier"], ["game_id"]).select("decision_id", "unmatched", "exact", F.round("brier", 9).alias("brier"))


@query("boot_unit_totals", PAIR_SQL + "SELECT game_id, count(*) AS n, sum(d_exact) AS exact, round(sum(d_brier), 9) AS brier FROM df GROUP BY 1")
def boot_unit_totals(spark, sf_dir):
    """What is resampled: one row per game."""
    base, model = two_methods(spark, sf_dir)
    totals = c.unit_totals(c.paired(base, model, ["exact", "brier"], ["game_id"]), "game_id", ["exact", "brier"])
    return totals.select("game_id", F.col("_n").alias("n"), "exact", F.round("brier", 9).alias("brier"))


def _boot(spark, sf_dir, unit, metrics, where=None):
    base, model = two_methods(spark, sf_dir)
    diff = c.paired(base, model, metrics, ["game_id", "player"])
    if where is not None:
        diff = diff.where(where)
    return rounded(c.bootstrap(durable(c.unit_totals(diff, unit, metrics)), unit, metrics))


def boot_sql(totals: str, metrics: list[str], resamples: int = 2_000, seed: int = 42) -> str:
    """The bootstrap of ``totals``, a select of (unit, n, metrics), in SQL: CTEs and the final select."""
    own = ", ".join(f'"{m}"' for m in metrics)
    weight = " + ".join(f"(u >= {x!r})::int" for x in c.POISSON)
    return f""", tot AS ({totals}), blk AS (SELECT tot.*, b, sha256('{seed}:' || b || ':' || unit) AS h FROM tot, range(0, {resamples // c.PER_HASH}) r(b)),
  dr AS (SELECT n, {own}, b * {c.PER_HASH} + j AS replicate, ('0x' || substr(h, (j * 8 + 1)::int, 8))::bigint / 4294967296.0::double AS u FROM blk, range(0, {c.PER_HASH}) s(j)),
  wt AS (SELECT *, {weight} AS w FROM dr), rs AS (SELECT replicate, sum(w * n) AS n, {', '.join(f'sum(w * "{m}") AS "{m}"' for m in metrics)} FROM wt WHERE w > 0 GROUP BY 1)
  SELECT (SELECT count(*) FROM tot) AS units, {', '.join(f'(SELECT round(sum("{m}") / sum(n), 9) FROM tot) AS {m}_estimate, round(quantile_cont("{m}" / n, 0.025), 9) AS {m}_low, round(quantile_cont("{m}" / n, 0.975), 9) AS {m}_high' for m in metrics)} FROM rs"""


_DIFFS = {"exact": "exact::int - (r = 1)::int", "top_3": "top_3::int - (r <= 3)::int", "top_5": "top_5::int - (r <= 5)::int", "rank_score": "rank_score - rs", "nll": "nll - bnll", "brier": "brier - bbrier", "similarity": "similarity - bsim"}
_FULL_SQL = PRED_SQL + f""", bc AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY bp DESC, move) AS bi, count(*) OVER (PARTITION BY decision_id) AS bn FROM (SELECT *, (engine_rank = 1)::int::double AS bp FROM cs WHERE split = 'test')),
  bl AS (SELECT decision_id, (max(bi) FILTER (chosen))::int AS r, sum((bp - chosen::int) ** 2) AS bbrier, -ln(greatest(max(bp) FILTER (chosen), 1e-15)) AS bnll, CASE WHEN max(bn) = 1 THEN 1.0 ELSE 1 - (max(bi) FILTER (chosen) - 1) / (max(bn) - 1) END AS rs,
    ({' + '.join(f'(bool_or("{f}") FILTER (chosen) = bool_or("{f}") FILTER (bi = 1))::int' for f in FLAGS)}) / {len(FLAGS)} AS bsim FROM bc GROUP BY 1), dd AS (SELECT pred.*, bl.* EXCLUDE (decision_id) FROM pred JOIN bl USING (decision_id))"""


def _totals(unit: str, metrics: list[str], source: str = "dd") -> str:
    return f"SELECT {unit} AS unit, count(*) AS n, " + ", ".join(f'sum(({_DIFFS[m]})::double) AS "{m}"' for m in metrics) + f" FROM {source} GROUP BY 1"


@query("boot_paired_game", _FULL_SQL + boot_sql(_totals("game_id", ["exact", "brier"]), ["exact", "brier"]))
def boot_paired_game(spark, sf_dir):
    return _boot(spark, sf_dir, "game_id", ["exact", "brier"])


_ALL = ["exact", "top_3", "top_5", "rank_score", "nll", "brier", "similarity"]


@query("boot_paired_unit", _FULL_SQL + boot_sql(_totals("player", _ALL), _ALL))
def boot_paired_unit(spark, sf_dir):
    return _boot(spark, sf_dir, "player", _ALL)


@query("boot_paired_masked", Q_SQL + """, mk AS (SELECT a.game_id, b.human_gap - a.human_gap AS human_gap, (b.human_gap <= 3.0)::int - (a.human_gap <= 3.0)::int AS ok FROM pp a JOIN pp b USING (decision_id) WHERE a.method = 'last' AND b.method = 'second' AND a.human_gap IS NOT NULL AND b.human_gap IS NOT NULL)"""
       + boot_sql("SELECT game_id AS unit, count(*) AS n, sum(human_gap) AS human_gap, sum(ok::double) AS ok FROM mk GROUP BY 1", ["human_gap", "ok"]))
def boot_paired_masked(spark, sf_dir):
    """Both-finite decisions only, over winning-chance gaps of two predictions."""
    q = durable(c.to_points(quality(spark, sf_dir)).withColumn("ok", (F.col("human_gap") <= 3.0).cast("double")))
    diff = c.paired(q.where("method = 'last'"), q.where("method = 'second'"), ["human_gap", "ok"], ["game_id"]).where("human_gap IS NOT NULL")
    return rounded(c.bootstrap(durable(c.unit_totals(diff, "game_id", ["human_gap", "ok"])), "game_id", ["human_gap", "ok"]))


@query("boot_player_mean", _FULL_SQL + boot_sql("SELECT player AS unit, 1 AS n, avg(exact::int - (r = 1)::int) AS exact FROM dd GROUP BY 1", ["exact"]))
def boot_player_mean(spark, sf_dir):
    """Every player counts once: the mean of players' mean differences."""
    base, model = two_methods(spark, sf_dir)
    diff = c.paired(base, model, ["exact"], ["player"]).groupBy("player").agg(F.avg("exact").alias("exact"))
    return rounded(c.bootstrap(durable(diff.withColumn("_n", F.lit(1))), "player", ["exact"]))


@query("cmp_coverage_transition", LOG_SQL + """, d AS (SELECT decision_id, min(engine_rank) FILTER (chosen) AS r, max(place) FILTER (chosen) AS q FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY quantity, engine_rank DESC) AS place FROM cand) GROUP BY 1),
  f AS (SELECT r <= 2 AS lc, r = 1 AS lk, q <= 4 AS rc, q = 1 AS rk FROM d) SELECT count_if(rc AND NOT lc) AS newly_covered, count_if(lc AND NOT rc) AS lost, count_if(lc AND rc) AS "both", count_if(rc AND NOT lc AND rk) AS newly_covered_correct, count_if(rk) - count_if(lk) AS net_correct FROM f""")
def cmp_coverage_transition(spark, sf_dir):
    """From the engine's first two to the four of the smallest quantity: some choices are lost on the way."""
    w = Window.partitionBy("decision_id").orderBy("quantity", F.desc("engine_rank"))
    d = candidates(spark, sf_dir).withColumn("q", F.row_number().over(w)).where("chosen").select("decision_id", "engine_rank", "q")
    left = d.select("decision_id", (F.col("engine_rank") <= 2).alias("c"), (F.col("engine_rank") == 1).alias("hit"))
    right = d.select("decision_id", (F.col("q") <= 4).alias("c"), (F.col("q") == 1).alias("hit"))
    return c.transitions(left, right, "c", "hit")


@query("cmp_identity_preference", POLICY_SQL + """, t AS (SELECT decision_id, chosen, p, exp(base_logit + 0.5 * capture::int) / sum(exp(base_logit + 0.5 * capture::int)) OVER (PARTITION BY decision_id) AS own, exp(base_logit - 0.5 * capture::int) / sum(exp(base_logit - 0.5 * capture::int)) OVER (PARTITION BY decision_id) AS wrong FROM pl)
  SELECT count(*) AS decisions, round(avg(-ln(own)), 9) AS own_nll, round(avg(-ln(wrong)), 9) AS wrong_nll, round(avg(-ln(p)), 9) AS none_nll, round(avg((own > wrong + 1e-12)::int), 9) AS own_preferred FROM t WHERE chosen""")
def cmp_identity_preference(spark, sf_dir):
    from .metric_queries import test_policy

    shift = 0.5 * F.col("capture").cast("int")
    t = test_policy(spark, sf_dir).withColumns({"own": pol.softmax(F.col("base_logit") + shift), "wrong": pol.softmax(F.col("base_logit") - shift)}).where("chosen")
    loss = lambda x: F.avg(-F.log(F.greatest(x, F.lit(pol.FLOOR))))
    return rounded(t.agg(F.count("*").alias("decisions"), loss("own").alias("own_nll"), loss("wrong").alias("wrong_nll"), loss("p").alias("none_nll"), F.avg((F.col("own") > F.col("wrong") + 1e-12).cast("double")).alias("own_preferred")))


@query("cmp_timing_summary", "SELECT count(value) AS n, round(avg(value), 9) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, round(sum(value), 6) AS total FROM events")
def cmp_timing_summary(spark, sf_dir):
    from quillog.session import table

    return c.timing(table(spark, sf_dir, "events"), "value").withColumns({"mean": F.round("mean", 9), "total": F.round("total", 6)})


_RES = LOG_SQL + """, res AS (SELECT CASE k WHEN 0 THEN NULL ELSE k::double END AS penalty, avg(CASE WHEN chosen THEN score_cp END) * (1 - k / 100) AS nll, avg((chosen AND engine_rank <= 1)::int) + k / 1000 AS accuracy, abs(3 - k)::double AS style FROM cand CROSS JOIN range(0, 6) t(k) GROUP BY k)"""


def penalty_results(spark, sf_dir):
    own = candidates(spark, sf_dir).agg(F.avg(F.when(F.col("chosen"), F.col("score_cp"))).alias("n"), F.avg((F.col("chosen") & (F.col("engine_rank") <= 1)).cast("int")).alias("a"))
    k = F.explode(F.sequence(F.lit(0), F.lit(5)))
    grid = own.select("*", k.alias("k"))
    return grid.select(F.when(F.col("k") > 0, F.col("k").cast("double")).alias("penalty"), (F.col("n") * (1 - F.col("k") / 100)).alias("nll"), (F.col("a") + F.col("k") / 1000).alias("accuracy"), F.abs(3 - F.col("k")).cast("double").alias("style"))


@query("gate_select_penalty", _RES + " SELECT arg_min(penalty, (style, nll, -penalty)) AS penalty, count(*) AS eligible FROM res WHERE penalty IS NOT NULL AND nll <= (SELECT nll FROM res WHERE penalty IS NULL) AND accuracy >= (SELECT accuracy FROM res WHERE penalty IS NULL)")
def gate_select_penalty(spark, sf_dir):
    return c.select_penalty(penalty_results(spark, sf_dir))


@query("gate_noninferiority", PAIR_SQL + "SELECT player, CASE WHEN avg(d_brier) <= 0 AND count(*) >= 80 AND avg(d_exact) > 0 THEN 'candidate' ELSE 'baseline' END AS selected FROM df GROUP BY 1")
def gate_noninferiority(spark, sf_dir):
    base, model = two_methods(spark, sf_dir)
    mine = c.paired(base, model, ["exact", "brier"], ["player"]).groupBy("player").agg(F.avg("exact").alias("e"), F.avg("brier").alias("b"), F.count("*").alias("n"))
    return c.noninferior(mine, [F.col("b") <= 0, F.col("n") >= 80], [F.col("e") > 0]).select("player", "selected")


_WIDTHS = [1, 2, 3, 5]
_STEPS = [(a, b) for a in _WIDTHS for b in _WIDTHS if a < b]
_GAINS = [f"g{a}_{b}" for a, b in _STEPS]
_GAIN_SQL = boot_sql("SELECT game_id AS unit, count(*) AS n, " + ", ".join(f"sum((engine_rank <= {b})::int - (engine_rank <= {a})::int)::double AS g{a}_{b}" for a, b in _STEPS) + " FROM cand WHERE chosen GROUP BY 1", _GAINS, 200)


@query("gate_width_sequential", LOG_SQL + _GAIN_SQL.replace("SELECT (SELECT count(*) FROM tot) AS units", ", bt AS (SELECT (SELECT count(*) FROM tot) AS units", 1) + "), pr AS (" + " UNION ALL ".join(f"SELECT {a} AS low, {b} AS high, g{a}_{b}_estimate AS gain, g{a}_{b}_low AS lower, {(b - a) * 4.0} AS ms FROM bt" for a, b in _STEPS) + """),
   ok AS (SELECT low, high FROM pr WHERE gain > 0.01 AND lower > 0 AND ms <= 10 * gain * 100), s2 AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM ok WHERE low = 1 AND high = 2) THEN 2 ELSE 1 END AS w), s3 AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM ok WHERE low = w AND high = 3) THEN 3 ELSE w END AS w FROM s2)
  SELECT CASE WHEN EXISTS (SELECT 1 FROM ok WHERE low = w AND high = 5) THEN 5 ELSE w END AS width FROM s3""")
def gate_width_sequential(spark, sf_dir):
    """Gains of coverage between widths with bootstrapped bounds over games, folded from the smallest width."""
    gain = lambda a, b: (F.col("engine_rank") <= b).cast("double") - (F.col("engine_rank") <= a).cast("double")
    chosen = candidates(spark, sf_dir).where("chosen").select("game_id", *[gain(a, b).alias(f"g{a}_{b}") for a, b in _STEPS])
    bounds = c.bootstrap(durable(c.unit_totals(chosen, "game_id", _GAINS)), "game_id", _GAINS, resamples=200)
    pairs = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"g{a}_{b}_estimate").alias("gain"), F.col(f"g{a}_{b}_low").alias("lower"), F.lit((b - a) * 4.0).alias("ms")) for a, b in _STEPS]
    return c.sequential_width(bounds.select(F.explode(F.array(*pairs)).alias("x")).select("x.*"), _WIDTHS)


@query("gate_history_k", LOG_SQL + ", cv AS (SELECT k::int AS k, avg((engine_rank <= k)::int) AS c FROM (SELECT engine_rank FROM cand WHERE chosen AND year(played_at) < 2000) CROSS JOIN range(1, 21) t(k) GROUP BY 1) SELECT 0.7::double AS threshold, coalesce((min(k) FILTER (c >= 0.7))::varchar, 'unresolved') AS k FROM cv")
def gate_history_k(spark, sf_dir):
    train = candidates(spark, sf_dir).where(F.col("chosen") & (F.year("played_at") < 2000))
    return m.smallest_k(m.coverage_at(train, "engine_rank", 20), [0.7])
