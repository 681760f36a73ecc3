"""Queries of the evaluation metrics, for a softmax policy on the test split."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.operators import metrics as m
from quillog.operators import policy as pol
from quillog.operators.order_stats import quantiles, with_quantiles
from quillog.functions import scalars as s
from quillog.session import durable, table
from quillog.sources.bindings import ATTRIBUTES, BEHAVIORS, CLOCK_SQL, FLAGS, LOG_SQL, candidates, clock_log

from .history_queries import TRAIN_SQL, with_split
from .policy_queries import TEST_SQL, frequencies
from .registry import query

D = "(PARTITION BY decision_id)"
FLAG_LIST = ", ".join(f'"{f}"' for f in FLAGS)
POLICY_SQL = TRAIN_SQL + f""", sm AS (SELECT *, exp(base_logit) / sum(exp(base_logit)) OVER {D} AS raw FROM cs WHERE split = 'test'), pl AS (SELECT *, round(raw, 12) AS p FROM sm)"""


def prediction_sql(order: str = "move", flags: tuple[str, ...] = FLAGS) -> str:
    own = lambda c: f'max("{c}") FILTER (chosen)'
    top = lambda c: f'max("{c}") FILTER (i = 1)'
    same = " + ".join(f"({own(f)} = {top(f)})::int" for f in flags)
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY p DESC, {order}) AS i FROM pl),
  pd AS (SELECT decision_id, max(player) AS player, max(game_id) AS game_id, max(phase) AS phase, max(time_control) AS time_control, {own('move')} AS actual_move, {top('move')} AS predicted_move, ({own('i')})::int AS actual_rank, count(*) AS candidates,
    {own('p')} AS actual_p, {top('p')} AS top_p, sum((p - chosen::int) ** 2) AS brier, {own('piece')} = {top('piece')} AS piece_match, {own('wing')} = {top('wing')} AS wing_match, ({same}) / {len(flags)} AS similarity,
    {', '.join(f'{own(f)} AS actual_{f}, {top(f)} AS predicted_{f}' for f in flags)} FROM rk GROUP BY 1),
  pred AS (SELECT *, actual_rank = 1 AS exact, actual_rank <= 3 AS top_3, actual_rank <= 5 AS top_5, CASE WHEN candidates = 1 THEN 1.0 ELSE 1 - (actual_rank - 1) / (candidates - 1) END AS rank_score, -ln(greatest(actual_p, 1e-15)) AS nll FROM pd)"""


PRED_SQL = POLICY_SQL + prediction_sql()
WIDE_SQL = POLICY_SQL + prediction_sql(flags=BEHAVIORS)
_AVG = ", ".join(f"round(avg({c}::double), 9) AS {c}" for c in m.MEANS)
PANEL_SQL = f"count(*) AS decisions, {_AVG}, round(avg(1.0 / actual_rank), 9) AS mrr, round(avg(actual_rank), 9) AS mean_rank, median(actual_rank) AS median_rank"


def test_policy(spark, sf_dir):
    """Test candidates with the softmax of their base score, rounded so that ties are ties everywhere."""
    return with_split(spark, sf_dir).where("split = 'test'").withColumn("p", F.round(pol.softmax(F.col("base_logit")), 12))


def test_predictions(spark, sf_dir, flags=FLAGS):
    return m.predictions(test_policy(spark, sf_dir), "p", flags)


def rounded(df, keep=("decisions", "dimension", "value", "player", "players", "median_rank"), digits=9):
    return df.select(*[F.col(c) if c in keep or dict(df.dtypes)[c] != "double" else F.round(c, digits).alias(c) for c in df.columns])


@query("rank_metrics_policy", WIDE_SQL + f"SELECT {PANEL_SQL} FROM pred")
def rank_metrics_policy(spark, sf_dir):
    return rounded(test_predictions(spark, sf_dir, BEHAVIORS).agg(*m.panel_columns()))


@query("rank_predictions", PRED_SQL + "SELECT decision_id, actual_move, predicted_move, actual_rank, round(nll, 9) AS nll, round(brier, 9) AS brier, round(rank_score, 9) AS rank_score, similarity FROM pred")
def rank_predictions(spark, sf_dir):
    return rounded(test_predictions(spark, sf_dir).select("decision_id", "actual_move", "predicted_move", "actual_rank", "nll", "brier", "rank_score", "similarity"))


@query("rank_panel", PRED_SQL + f"""SELECT CASE WHEN grouping(player) = 0 THEN 'player' WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(time_control) = 0 THEN 'time_control' ELSE 'all' END AS dimension,
  coalesce(player, phase, time_control, 'all') AS value, {PANEL_SQL} FROM pred GROUP BY GROUPING SETS ((player), (phase), (time_control), ())""")
def rank_panel(spark, sf_dir):
    return rounded(m.panel(test_predictions(spark, sf_dir), ["player", "phase", "time_control"]))


@query("rank_panel_macro", PRED_SQL + f", mine AS (SELECT player, {', '.join(f'avg({c}::double) AS {c}' for c in m.MEANS)} FROM pred GROUP BY 1) SELECT count(*) AS players, {', '.join(f'round(avg({c}), 9) AS {c}' for c in m.MEANS)} FROM mine")
def rank_panel_macro(spark, sf_dir):
    return rounded(m.macro(test_predictions(spark, sf_dir)))


_REPORT = """count(*) AS decisions, round(avg((actual_rank = 1)::int), 9) AS accuracy, round(avg((actual_rank <= 2)::int), 9) AS top_2, round(avg((actual_rank <= 3)::int), 9) AS top_3, round(avg(1.0 / actual_rank), 9) AS mrr, round(avg(nll), 9) AS nll,
  round(max(abs(1 - p_sum)), 9) AS max_sum_error, count_if(actual_engine_rank > 1) AS non_first_decisions, round(avg((actual_rank = 1)::int) FILTER (actual_engine_rank > 1), 9) AS non_first_accuracy, round(avg(1.0 / actual_rank) FILTER (actual_engine_rank > 1), 9) AS non_first_mrr"""
_SLICES = ("actual_engine_rank", "phase", "pressure", "color", "time_control")


@query("rank_metrics_topk", POLICY_SQL + prediction_sql("engine_rank, move") + f""", ex AS (SELECT p.*, x.* EXCLUDE (decision_id) FROM pred p JOIN (SELECT decision_id, max(engine_rank) FILTER (chosen) AS actual_engine_rank, sum(p) AS p_sum, bool_or(pressure) FILTER (chosen) AS pressure, CASE WHEN month(max(played_at)) % 2 = 0 THEN 'white' ELSE 'black' END AS color FROM rk GROUP BY 1) x USING (decision_id))
  SELECT CASE {' '.join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in _SLICES)} ELSE 'all' END AS dimension, coalesce({', '.join(f'{d}::varchar' for d in _SLICES)}, 'all') AS value, {_REPORT} FROM ex GROUP BY GROUPING SETS ({', '.join(f'({d})' for d in _SLICES)}, ())""")
def rank_metrics_topk(spark, sf_dir):
    """The ranking report: all decisions, and by the engine's rank of the choice, phase, pressure, colour and control."""
    color = F.when(F.month("played_at") % 2 == 0, "white").otherwise("black")
    seen = F.max(F.when(F.col("chosen"), F.col("pressure"))).over(Window.partitionBy("decision_id"))
    own = test_policy(spark, sf_dir).withColumns({"color": color, "pressure": seen})
    pred = m.predictions(own, "p", FLAGS, ties=("engine_rank", "move"), context=("phase", "pressure", "color", "time_control"))
    return rounded(m.by_dimension(pred, list(_SLICES), m.ranking_columns()))


@query("rank_confusion", POLICY_SQL + prediction_sql() + ", rr AS (SELECT decision_id, max(engine_rank) FILTER (chosen) AS actual, max(engine_rank) FILTER (i = 1) AS predicted FROM rk GROUP BY 1) SELECT actual, predicted, count(*) AS n FROM rr GROUP BY ALL")
def rank_confusion(spark, sf_dir):
    w = Window.partitionBy("decision_id").orderBy(F.desc("p"), "move")
    own = test_policy(spark, sf_dir).withColumn("i", F.row_number().over(w))
    ranks = own.groupBy("decision_id").agg(F.max(F.when(F.col("chosen"), F.col("engine_rank"))).alias("actual"), F.max(F.when(F.col("i") == 1, F.col("engine_rank"))).alias("predicted"))
    return m.confusion(ranks, "actual", "predicted")


@query("rank_metrics_all_decisions", POLICY_SQL.replace("WHERE split = 'test'", "WHERE split = 'test' AND engine_rank <= 3") + """, rk AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY p DESC, move) AS i FROM pl),
  pr AS (SELECT decision_id, (max(i) FILTER (chosen))::int AS r FROM rk GROUP BY 1), al AS (SELECT DISTINCT decision_id FROM cs WHERE split = 'test')
  SELECT count(*) AS decisions, count(r) AS usable, round(avg((coalesce(r, 99) = 1)::int), 9) AS exact, round(avg((coalesce(r, 99) <= 3)::int), 9) AS top_3, round(avg((r = 1)::int), 9) AS conditional_exact FROM al LEFT JOIN pr USING (decision_id)""")
def rank_metrics_all_decisions(spark, sf_dir):
    """Choices outside the first three candidates are misses."""
    cs = with_split(spark, sf_dir).where("split = 'test'")
    kept = cs.where("engine_rank <= 3").withColumn("p", F.round(pol.softmax(F.col("base_logit")), 12))
    w = Window.partitionBy("decision_id").orderBy(F.desc("p"), "move")
    ranks = kept.withColumn("i", F.row_number().over(w)).groupBy("decision_id").agg(F.max(F.when(F.col("chosen"), F.col("i"))).alias("r"))
    every = cs.select("decision_id").distinct().join(ranks, "decision_id", "left")
    miss = F.coalesce("r", F.lit(99))
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return every.agg(F.count("*").alias("decisions"), F.count("r").alias("usable"), rate(miss == 1).alias("exact"), rate(miss <= 3).alias("top_3"), rate(F.col("r") == 1).alias("conditional_exact"))


@query("cal_ece_top1", PRED_SQL + ", b AS (SELECT least(floor(top_p * 10), 9) AS b, count(*) AS n, avg(top_p) AS c, avg(exact::int) AS a FROM pred GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b")
def cal_ece_top1(spark, sf_dir):
    return rounded(m.ece(test_predictions(spark, sf_dir)))


@query("cal_report", POLICY_SQL + "SELECT least(floor(p * 10), 9)::int AS bin, round(least(floor(p * 10), 9) / 10, 9) AS low, round((least(floor(p * 10), 9) + 1) / 10, 9) AS high, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(chosen::int), 9) AS chosen_rate, round(avg((p - chosen::int) ** 2), 9) AS brier FROM pl GROUP BY ALL")
def cal_report(spark, sf_dir):
    return rounded(m.calibration(test_policy(spark, sf_dir), "p"))


@query("slice_temporal", PRED_SQL + ", y AS (SELECT p.*, year(played_at) AS y FROM pred p JOIN dec USING (decision_id)) SELECT y::int AS year, count(*) AS decisions, round(avg(exact::int), 9) AS exact, round(avg(nll), 9) AS nll FROM y GROUP BY 1 HAVING count(*) >= 100")
def slice_temporal(spark, sf_dir):
    pred = m.predictions(test_policy(spark, sf_dir), "p", FLAGS, context=("player", "game_id", "phase", "time_control", "played_at"))
    per = pred.groupBy(F.year("played_at").alias("year")).agg(F.count("*").alias("decisions"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg("nll").alias("nll"))
    return rounded(per.where("decisions >= 100"))


@query("agg_rate_errors", WIDE_SQL + "SELECT " + ", ".join(f"round(abs(avg(predicted_{f}::int) - avg(actual_{f}::int)), 9) AS {f}" for f in BEHAVIORS) + " FROM pred")
def agg_rate_errors(spark, sf_dir):
    return rounded(m.rate_errors(test_predictions(spark, sf_dir, BEHAVIORS), BEHAVIORS))


@query("flagship_policy_panel", TEST_SQL.replace("p FROM te)", "raw FROM te), pl AS (SELECT *, round(raw, 12) AS p FROM rf)") + prediction_sql() + f"SELECT player, {PANEL_SQL} FROM pred GROUP BY 1")
def flagship_policy_panel(spark, sf_dir):
    """Chronological split, rank-frequency baseline fitted on training games, evaluated per player on test games."""
    cand = frequencies(spark, sf_dir).withColumn("p", F.round(pol.normalized(F.col("frequency")), 12))
    return rounded(m.predictions(cand, "p", FLAGS).groupBy("player").agg(*m.panel_columns()))


# --- plain aggregates ------------------------------------------------------------------------


_BEHAVIOR_SETS = ("phase", "piece", "opening")
MOVED_SQL = LOG_SQL + """, tm AS (SELECT decision_id, datediff('day', lag(moved_at) OVER (PARTITION BY game_id ORDER BY ply), moved_at) AS days FROM dec),
  d AS (SELECT decision_id, max(player) AS player, max(game_id) AS game_id, max(phase) AS phase, max(opening) AS opening, max(rating) AS rating, max(score_cp) FILTER (engine_rank = 1) AS best, greatest(max(score_cp) FILTER (engine_rank = 1) - max(score_cp) FILTER (chosen), 0) AS loss, max(engine_rank) FILTER (chosen) AS r, max(piece) FILTER (chosen) AS piece,
    bool_or(capture) FILTER (chosen) AS capture, bool_or("check") FILTER (chosen) AS "check", bool_or(castle) FILTER (chosen) AS castle, bool_or(trade) FILTER (chosen) AS trade, bool_or(trade) AS offers, bool_or(pressure) FILTER (chosen) AS pressure, max(quantity) FILTER (chosen) AS material FROM cand GROUP BY 1),
  mv AS (SELECT d.*, days FROM d JOIN tm USING (decision_id))"""


def moves_made(spark, sf_dir):
    """One row per decision: its context, the move made, what it cost and the days since the one before."""
    from quillog.sources.bindings import decisions

    own = lambda c: F.max(F.when(F.col("chosen"), F.col(c)))
    best = F.max(F.when(F.col("engine_rank") == 1, F.col("score_cp")))
    d = candidates(spark, sf_dir).groupBy("decision_id").agg(
        *[F.max(c).alias(c) for c in ("player", "game_id", "phase", "opening", "rating")], best.alias("best"), F.greatest(best - own("score_cp"), F.lit(0)).alias("loss"), own("engine_rank").alias("r"), own("quantity").alias("material"),
        F.bool_or("trade").alias("offers"), *[own(c).alias(c) for c in ("piece", "capture", "check", "castle", "trade", "pressure")],
    )
    before = F.lag("moved_at").over(Window.partitionBy("game_id").orderBy("ply"))
    return d.join(decisions(spark, sf_dir).select("decision_id", F.datediff("moved_at", before).alias("days")), "decision_id")


@query("agg_behavior_summary", MOVED_SQL + f"""SELECT CASE {' '.join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in _BEHAVIOR_SETS)} ELSE 'all' END AS dimension, coalesce({', '.join(_BEHAVIOR_SETS)}, 'all') AS value, count(*) AS decisions, round(avg(loss), 9) AS mean_loss, median(loss)::double AS median_loss,
   round(avg((r <= 1)::int) * 100, 9) AS top_1, round(avg((r <= 3)::int) * 100, 9) AS top_3, round(avg((r <= 5)::int) * 100, 9) AS top_5, round(avg(days), 9) AS mean_days, round(avg(material), 9) AS mean_material, round(avg(1 / (1 + exp(-0.00368208 * (best - 300)))), 9) AS mean_chance,
   {', '.join(f'round(avg("{c}"::int) * 100, 9) AS "{c}"' for c in ("capture", "check", "castle", "trade", "pressure"))} FROM mv GROUP BY GROUPING SETS ({', '.join(f'({d})' for d in _BEHAVIOR_SETS)}, ())""")
def agg_behavior_summary(spark, sf_dir):
    """Everything at once and by phase, piece moved and opening: counts, losses, ranks, time, material, chances and flags."""
    percent = lambda c: F.avg(c.cast("double")) * 100
    columns = [
        F.count("*").alias("decisions"), F.avg("loss").alias("mean_loss"), *[percent(F.col("r") <= k).alias(f"top_{k}") for k in (1, 3, 5)],
        F.avg("days").alias("mean_days"), F.avg("material").alias("mean_material"), F.avg(s.win_chance(F.col("best") - 300)).alias("mean_chance"), *[percent(F.col(c)).alias(c) for c in ("capture", "check", "castle", "trade", "pressure")],
    ]
    return rounded(m.summary(moves_made(spark, sf_dir), list(_BEHAVIOR_SETS), columns, {"median_loss": ("loss", 0.5)}))


COV_SQL = LOG_SQL + ", cv AS (SELECT player, k::int AS k, avg((engine_rank <= k)::int) AS coverage FROM (SELECT player, engine_rank FROM cand WHERE chosen) CROSS JOIN range(1, 21) t(k) GROUP BY ALL)"


def player_coverage(spark, sf_dir):
    return m.coverage_at(candidates(spark, sf_dir).where("chosen"), "engine_rank", 20, ["player"])


@query("agg_coverage_k", COV_SQL + "SELECT player, k, round(coverage, 9) AS coverage FROM cv")
def agg_coverage_k(spark, sf_dir):
    return rounded(player_coverage(spark, sf_dir))


@query("agg_smallest_k", COV_SQL + "SELECT player, t AS threshold, coalesce((min(k) FILTER (coverage >= t))::varchar, 'unresolved') AS k FROM cv CROSS JOIN (VALUES (0.7::double), (0.9::double), (0.95::double)) g(t) GROUP BY ALL")
def agg_smallest_k(spark, sf_dir):
    return m.smallest_k(player_coverage(spark, sf_dir), [0.7, 0.9, 0.95], ["player"])


PL_SQL = LOG_SQL + ", pl AS (SELECT player, median(rating)::double AS med, avg(rating) AS mean_rating, avg((engine_rank <= 3)::int) AS top3, avg((engine_rank <= 5)::int) AS top5, count(*) AS n FROM cand WHERE chosen GROUP BY 1)"


def players(spark, sf_dir):
    own = durable(candidates(spark, sf_dir).where("chosen").select("player", "rating", "engine_rank"))
    means = own.groupBy("player").agg(F.avg("rating").alias("mean_rating"), *[F.avg((F.col("engine_rank") <= k).cast("double")).alias(f"top{k}") for k in (3, 5)], F.count("*").alias("n"))
    return with_quantiles(means, own, ["player"], {"med": ("rating", 0.5)})


@query("agg_rating_bands", PL_SQL + "SELECT (floor(med / 500) * 500)::bigint AS band, count(*) AS players, round(avg(top3), 9) AS mean_top3, round(stddev_samp(top3), 9) AS sd_top3, round(max(top3) - min(top3), 9) AS range_top3, round(median(med), 6) AS median_rating, sum(n)::bigint AS decisions FROM pl GROUP BY 1")
def agg_rating_bands(spark, sf_dir):
    own = durable(players(spark, sf_dir).withColumn("band", (F.floor(F.col("med") / 500) * 500).cast("bigint")))
    per = own.groupBy("band").agg(
        F.count("*").alias("players"), F.round(F.avg("top3"), 9).alias("mean_top3"), F.round(F.stddev_samp("top3"), 9).alias("sd_top3"), F.round(F.max("top3") - F.min("top3"), 9).alias("range_top3"), F.sum("n").alias("decisions"))
    return with_quantiles(per, own, ["band"], {"median_rating": ("med", 0.5)}).withColumn("median_rating", F.round("median_rating", 6))


@query("agg_correlations", PL_SQL + """, r AS (SELECT med AS x, top3 AS y, rank() OVER (ORDER BY med) + (count(*) OVER (PARTITION BY med) - 1) / 2 AS rx, rank() OVER (ORDER BY top3) + (count(*) OVER (PARTITION BY top3) - 1) / 2 AS ry FROM pl)
  SELECT count(*) AS n, round(corr(x, y), 7) AS pearson, round(corr(rx, ry), 7) AS spearman FROM r""")
def agg_correlations(spark, sf_dir):
    return rounded(m.correlations(players(spark, sf_dir), "med", "top3"), digits=7)


@query("agg_distribution", LOG_SQL + ", v AS (SELECT player, coalesce(CASE WHEN phase <> 'P' THEN time_control END, 'unknown') AS value, count(*) AS n FROM dec GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY player), 9) AS share FROM v")
def agg_distribution(spark, sf_dir):
    from quillog.sources.bindings import decisions

    dec = decisions(spark, sf_dir).withColumn("tc", F.when(F.col("phase") != "P", F.col("time_control")))
    return rounded(m.distribution(dec, "tc", ["player"]))


@query("agg_stratified_quality", LOG_SQL + """, d AS (SELECT decision_id, max(phase) AS phase, greatest(max(score_cp) FILTER (engine_rank = 1) - max(score_cp) FILTER (chosen), 0) AS loss, max(engine_rank) FILTER (chosen) AS r FROM cand GROUP BY 1)
  SELECT s.phase AS stratum, count(r) AS decisions, round(avg((r <= 5)::int), 9) AS top_5, round(avg(loss), 9) AS mean_loss, median(loss)::double AS median_loss FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(phase) LEFT JOIN d USING (phase) GROUP BY 1""")
def agg_stratified_quality(spark, sf_dir):
    """Expected strata appear with zero decisions when nothing falls into them."""
    own = lambda c: F.max(F.when(F.col("chosen"), F.col(c)))
    d = durable(candidates(spark, sf_dir).groupBy("decision_id").agg(F.max("phase").alias("stratum"), F.greatest(F.max(F.when(F.col("engine_rank") == 1, F.col("score_cp"))) - own("score_cp"), F.lit(0)).alias("loss"), own("engine_rank").alias("r")))
    per = d.groupBy("stratum").agg(F.count("*").alias("decisions"), F.round(F.avg((F.col("r") <= 5).cast("double")), 9).alias("top_5"), F.round(F.avg("loss"), 9).alias("mean_loss"))
    per = with_quantiles(per, d, ["stratum"], {"median_loss": ("loss", 0.5)})
    expected = spark.createDataFrame([(x,) for x in "FOPX"], "stratum string")
    return F.broadcast(expected).join(per, "stratum", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)))


@query("agg_strength_profile", MOVED_SQL + """SELECT player, CASE WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(pressure) = 0 THEN 'pressure' ELSE 'all' END AS dimension, coalesce(phase, pressure::varchar, 'all') AS value, count(*) AS decisions, round(avg(rating), 6) AS mean_rating, round(median(rating), 6) AS median_rating,
   round(avg(loss), 9) AS mean_loss, median(loss)::double AS median_loss, round(avg((r <= 5)::int), 9) AS top_5, count_if(loss < 50) AS under_50, count_if(loss >= 50 AND loss < 100) AS under_100, count_if(loss >= 100 AND loss < 300) AS under_300, count_if(loss >= 300) AS from_300, count_if(loss > 1000) AS over_1000 FROM mv GROUP BY GROUPING SETS ((player, phase), (player, pressure), (player))""")
def agg_strength_profile(spark, sf_dir):
    x = F.col("loss")
    columns = [
        F.count("*").alias("decisions"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.avg("loss").alias("mean_loss"), F.avg((F.col("r") <= 5).cast("double")).alias("top_5"),
        F.count_if(x < 50).alias("under_50"), F.count_if((x >= 50) & (x < 100)).alias("under_100"), F.count_if((x >= 100) & (x < 300)).alias("under_300"), F.count_if(x >= 300).alias("from_300"), F.count_if(x > 1000).alias("over_1000"),
    ]
    out = m.summary(moves_made(spark, sf_dir), ["phase", "pressure"], columns, {"median_rating": ("rating", 0.5), "median_loss": ("loss", 0.5)}, keys=["player"])
    return rounded(out.withColumn("median_rating", F.round("median_rating", 6)))


_SHARES = {"openings": "opening", "pieces": "piece", "phases": "phase"}
_PRESSED = ", ".join(f"round(avg({v}) FILTER (pressure) - avg({v}) FILTER (NOT pressure), 9) AS pressure_{n}" for n, v in (("capture", "capture::int"), ("top_5", "(r <= 5)::int"), ("loss", "loss")))


@query("agg_style_profile", MOVED_SQL + ", ".join(["", *[f"{n} AS (SELECT player, string_agg(k || '=' || n, ',' ORDER BY k) AS {n} FROM (SELECT player, {c} AS k, count(*) AS n FROM mv GROUP BY ALL) GROUP BY 1)" for n, c in _SHARES.items()]]) + f""",
  one AS (SELECT player, count(*) AS decisions, round(avg(capture::int), 9) AS capture, round(avg("check"::int), 9) AS "check", count_if(trade) AS trades, count_if(offers) AS trade_offers, round(avg(CASE WHEN offers THEN trade::int END), 9) AS trade_when_offered, count(DISTINCT game_id) AS games,
    round(count(DISTINCT CASE WHEN castle THEN game_id END) / count(DISTINCT game_id), 9) AS games_castled, round(avg(days), 9) AS mean_days, count(days) AS timed, round(avg(pressure::int), 9) AS pressure, {_PRESSED} FROM mv GROUP BY 1)
  SELECT * FROM one JOIN openings USING (player) JOIN pieces USING (player) JOIN phases USING (player)""")
def agg_style_profile(spark, sf_dir):
    own = durable(moves_made(spark, sf_dir))
    num = lambda c: F.col(c).cast("double")
    gap = lambda c: F.avg(F.when(F.col("pressure"), c)) - F.avg(F.when(~F.col("pressure"), c))
    one = own.groupBy("player").agg(
        F.count("*").alias("decisions"), F.avg(num("capture")).alias("capture"), F.avg(num("check")).alias("check"), F.count_if("trade").alias("trades"), F.count_if("offers").alias("trade_offers"), F.avg(F.when(F.col("offers"), num("trade"))).alias("trade_when_offered"),
        F.count_distinct("game_id").alias("games"), (F.count_distinct(F.when(F.col("castle"), F.col("game_id"))) / F.count_distinct("game_id")).alias("games_castled"), F.avg("days").alias("mean_days"), F.count("days").alias("timed"), F.avg(num("pressure")).alias("pressure"),
        gap(num("capture")).alias("pressure_capture"), gap((F.col("r") <= 5).cast("double")).alias("pressure_top_5"), gap(F.col("loss")).alias("pressure_loss"),
    )
    kinds = own.select("player", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("k")) for n, c in _SHARES.items()])).alias("x")).groupBy("player", "x.n", "x.k").count()
    listed = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == n, F.struct("k", "count")))), lambda x: F.concat_ws("=", x["k"], x["count"])), ",").alias(n)
    return rounded(one.join(kinds.groupBy("player").agg(*[listed(n) for n in _SHARES]), "player"))


@query("agg_player_metadata", LOG_SQL + """SELECT player, count(DISTINCT game_id) AS games, count(DISTINCT CASE WHEN month(played_at) % 2 = 0 THEN game_id END) AS white_games, min(played_at) AS first_at, max(played_at) AS last_at, count(played_at) AS dated, count(rating) AS rated, round(avg(rating), 6) AS mean_rating,
  min(rating) AS min_rating, max(rating) AS max_rating, count(DISTINCT time_control) AS controls, count_if(phase = 'F') AS finished FROM dec GROUP BY 1""")
def agg_player_metadata(spark, sf_dir):
    from quillog.sources.bindings import decisions

    return decisions(spark, sf_dir).groupBy("player").agg(
        F.count_distinct("game_id").alias("games"), F.count_distinct(F.when(F.month("played_at") % 2 == 0, F.col("game_id"))).alias("white_games"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"),
        F.count("played_at").alias("dated"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
        F.count_distinct("time_control").alias("controls"), F.count_if(F.col("phase") == "F").alias("finished"),
    )


@query("agg_player_context", LOG_SQL + "SELECT player, round_even(median(rating), 0)::bigint AS own_rating, round_even(median(floor(o_totalprice / 100)), 0)::bigint AS opponent_rating FROM dec JOIN orders ON o_orderkey = decision_id GROUP BY 1")
def agg_player_context(spark, sf_dir):
    """Rounded medians of the player's own rating and of the opponents'."""
    from quillog.sources.bindings import decisions

    other = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), F.floor(F.col("o_totalprice") / 100).alias("opponent"))
    own = durable(decisions(spark, sf_dir).join(other, "decision_id").select("player", "rating", "opponent"))
    middle = quantiles(own, ["player"], {"own_rating": ("rating", 0.5), "opponent_rating": ("opponent", 0.5)})
    return middle.select("player", *[F.bround(c, 0).cast("bigint").alias(c) for c in ("own_rating", "opponent_rating")])


# --- style -----------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT decision_id, player, phase, p, chosen, i = 1 AS top, '{a}' AS attribute, \"{a}\"::varchar AS category FROM rk" for a in ATTRIBUTES)
CELL_SQL = POLICY_SQL + prediction_sql() + f""", lg AS ({_LONG}), pc AS (SELECT decision_id, player, phase, attribute, category, sum(p) AS mass, bool_or(chosen) AS human, bool_or(top) AS top FROM lg GROUP BY ALL),
  pk AS (SELECT *, count(*) OVER (PARTITION BY decision_id, attribute) > 1 AS fr FROM pc),
  rt AS (SELECT player, phase, attribute, category, sum(human::int) FILTER (fr) AS h, sum(mass) FILTER (fr) AS m, sum(top::int) FILTER (fr) AS t, sum((mass - human::int) ** 2) FILTER (fr) AS sq, sum(-ln(greatest(mass, 1e-15))) FILTER (fr AND human) AS ll, count_if(fr AND human) AS n, count_if(NOT fr) AS f FROM pk GROUP BY ALL),
  cl AS (SELECT player, phase, attribute, sum(n)::bigint AS opportunities, sum(f)::bigint AS forced, sum(n) >= 20 AS supported, sum(abs(h - m)) / nullif(sum(n), 0) / 2 AS policy_tv, sum(abs(h - t)) / nullif(sum(n), 0) / 2 AS argmax_tv, sum(sq) / nullif(sum(n), 0) AS attribute_brier, sum(ll) / nullif(sum(n), 0) AS attribute_nll FROM rt GROUP BY ALL)"""


def cells(spark, sf_dir):
    return m.style_cells(test_policy(spark, sf_dir), "p", ATTRIBUTES)


@query("style_cells", CELL_SQL + "SELECT player, phase, attribute, opportunities, forced, supported, round(policy_tv, 7) AS policy_tv, round(argmax_tv, 7) AS argmax_tv, round(attribute_brier, 7) AS attribute_brier, round(attribute_nll, 7) AS attribute_nll FROM cl")
def style_cells(spark, sf_dir):
    return rounded(cells(spark, sf_dir), digits=7)


@query("style_macro", CELL_SQL + ", mi AS (SELECT player, avg(policy_tv) AS a, avg(argmax_tv) AS b FROM cl WHERE supported GROUP BY 1) SELECT count(*) AS players, round(avg(a), 7) AS macro_policy_tv, round(avg(b), 7) AS macro_argmax_tv FROM mi")
def style_macro(spark, sf_dir):
    return rounded(m.style_macro(cells(spark, sf_dir)), digits=7)


STRUCTURE, OPENINGS = ("quantity", "score_cp"), {"white": ["A0", "A1", "A2"], "black": ["A3", "A4"]}
_CELLS = [("behaviour", f, f'avg("{f}"::int)') for f in FLAGS]
_CELLS += [("sequence", "repeat_piece", "avg((piece = pp)::int)"), ("sequence", "repeat_wing", "avg((wing = pw)::int)"), ("sequence", "capture_after_capture", "avg(CASE WHEN pp IS NOT NULL THEN (capture AND pc)::int END)")]
_CELLS += [("pawn_structure", c, f"avg({c}) FILTER (last)") for c in STRUCTURE]
_CELLS += [("opening_choice", f"{color}_{o}", f"avg((opening = '{o}')::int) FILTER (first AND color = '{color}')") for color, known in OPENINGS.items() for o in known]
_CELLS += [("opening_choice", f"{color}_other", f"avg((opening NOT IN {tuple(known)})::int) FILTER (first AND color = '{color}')") for color, known in OPENINGS.items()]
_RATES = " UNION ALL ".join([f"SELECT player, block, '{family}' AS family, '{name}' AS field, coalesce({value}, 0)::double AS value FROM sq GROUP BY ALL" for family, name, value in _CELLS] + [f"SELECT player, block, '{k}', {k}, count(*) / max(n) FROM mv GROUP BY player, block, {k}" for k in ("piece", "wing", "phase")])
VEC_SQL = LOG_SQL + f""", gb AS (SELECT game_id, ((row_number() OVER (PARTITION BY player ORDER BY sha256('9:' || game_id), game_id) - 1) // 25)::int AS block FROM (SELECT DISTINCT player, game_id FROM dec)),
  mv AS (SELECT c.*, block, CASE WHEN month(played_at) % 2 = 0 THEN 'white' ELSE 'black' END AS color, count(*) OVER (PARTITION BY player, block) AS n FROM cand c JOIN gb USING (game_id) WHERE chosen),
  sq AS (SELECT *, lag(piece) OVER w AS pp, lag(wing) OVER w AS pw, lag(capture) OVER w AS pc, lag(ply) OVER w IS NULL AS first, lead(ply) OVER w IS NULL AS last FROM mv WINDOW w AS (PARTITION BY game_id ORDER BY ply)), vec AS ({_RATES}),
  sc AS (SELECT family, field, greatest(CASE WHEN family = 'pawn_structure' THEN 0.5 ELSE 0.05 END, sd) AS scale FROM (SELECT family, field, stddev_pop(value) AS sd FROM vec GROUP BY ALL)), ce AS (SELECT player, family, field, avg(value) AS centre FROM vec GROUP BY ALL)"""


def vectors(spark, sf_dir):
    """The style vectors of blocks of 25 games; written once, as what is made of them reads them several times."""
    from quillog.operators import splits

    cand = candidates(spark, sf_dir).where("chosen").withColumn("color", F.when(F.month("played_at") % 2 == 0, "white").otherwise("black"))
    chosen = durable(cand.select("player", "game_id", "ply", *FLAGS, "piece", "wing", "phase", "color", "opening", *STRUCTURE))
    games = chosen.select("player", "game_id").distinct()
    blocks = splits.blocks_of(games, 25, [splits.seeded_order(9, "game_id"), F.col("game_id")], per="player").select("game_id", "block")
    return durable(m.style_vector(chosen.join(blocks, "game_id"), ["player", "block"], FLAGS, structure=STRUCTURE, openings=OPENINGS))


@query("style_vector", VEC_SQL + "SELECT player, block, family, field, round(value, 9) AS value FROM vec")
def style_vector(spark, sf_dir):
    return rounded(vectors(spark, sf_dir), keep=())


@query("style_reference", VEC_SQL + "SELECT player, family, field, round(centre, 9) AS centre, round(scale, 9) AS scale FROM ce JOIN sc USING (family, field)")
def style_reference(spark, sf_dir):
    scale, centre = m.style_reference(vectors(spark, sf_dir))
    return rounded(centre.join(scale, ["family", "field"]))


ID_SQL = VEC_SQL + """, ds AS (SELECT v.player || ':' || block AS unit, v.player AS true_player, ce.player, v.family, avg(((value - centre) / scale) ** 2) AS d FROM vec v JOIN ce USING (family, field) JOIN sc USING (family, field) GROUP BY ALL),
  dt AS (SELECT unit, true_player, player, round(avg(d), 9) AS distance FROM ds GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY distance, player)::int AS place FROM dt)"""


def identities(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    scale, centre = m.style_reference(vec)
    return m.style_identity(vec.withColumn("unit", F.concat_ws(":", "player", "block")).drop("block"), scale, centre, "unit")


@query("style_identity", ID_SQL + "SELECT unit, place AS true_place FROM pl WHERE player = true_player")
def style_identity(spark, sf_dir):
    return identities(spark, sf_dir).select("unit", F.col("true_place").cast("int").alias("true_place"))


@query("style_confusion", ID_SQL + "SELECT true_player AS actual, player AS predicted, count(*) AS n FROM pl WHERE place = 1 GROUP BY ALL")
def style_confusion(spark, sf_dir):
    return m.confusion(identities(spark, sf_dir), "true_player", "best")


@query("style_distance", VEC_SQL + """, k AS (SELECT player, family, field, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM (SELECT * FROM vec WHERE block = 0) a FULL JOIN (SELECT * FROM vec WHERE block = 1) b USING (player, family, field)),
  f AS (SELECT player, family, least(4.0, avg(abs(a - b) / scale)) / 4 AS d FROM k JOIN sc USING (family, field) GROUP BY ALL) SELECT player, round(avg(d), 9) AS distance FROM f GROUP BY 1""")
def style_distance(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    scale, _ = m.style_reference(vec)
    return rounded(m.style_distance(vec.where("block = 0").drop("block"), vec.where("block = 1").drop("block"), scale, ["player"]))


_TRAITS = ("purchase", "error")
_KINDS_SQL = "SELECT DISTINCT event_type FROM clk"


@query("traj_summary", CLOCK_SQL + """, sq AS (SELECT *, lag(event_type) OVER w AS prior, count(*) OVER (PARTITION BY game_id) AS n FROM clk WINDOW w AS (PARTITION BY game_id ORDER BY ply)),
  g AS (SELECT game_id, max(n) AS plies, max(event_type) FILTER (ply = n) AS ending, max(clock) FILTER (ply = n) AS last_clock FROM sq GROUP BY 1), k AS (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS kinds FROM (SELECT event_type, count(*) AS n FROM clk GROUP BY 1)),
  e AS (SELECT string_agg(ending || '=' || n, ',' ORDER BY ending) AS endings FROM (SELECT ending, count(*) AS n FROM g GROUP BY 1))
  SELECT count(*) AS games, sum(plies)::bigint AS moves, round(avg((ending = 'purchase')::int), 9) AS terminal_rate, round(avg((plies >= 4)::int), 9) AS truncated_rate, round(avg(plies), 9) AS mean_plies, round(avg(last_clock), 7) AS mean_last_clock,
   (SELECT round(avg((event_type = 'purchase')::int), 9) FROM clk) AS purchase, (SELECT round(avg((event_type = 'error')::int), 9) FROM clk) AS error, (SELECT round(avg((event_type = prior)::int), 9) FROM sq) AS repeat_rate, (SELECT kinds FROM k) AS kinds, (SELECT endings FROM e) AS endings FROM g""")
def traj_summary(spark, sf_dir):
    """Games and moves of trajectories: endings, lengths, rates of two traits, kinds of moves, repeats, and the clock at the end."""
    w = Window.partitionBy("game_id").orderBy("ply")
    own = clock_log(spark, sf_dir).withColumn("prior", F.lag("event_type").over(w))
    num = lambda c: c.cast("double")
    per = own.groupBy("game_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("prior").isNotNull()).alias("steps"), F.count_if(F.col("event_type") == F.col("prior")).alias("again"), F.max(F.struct("ply", "clock")).alias("last"))
    g = per.groupBy("game_id").agg(F.sum("n").alias("plies"), F.max_by("event_type", "last.ply").alias("ending"), F.max("last").alias("last"), F.sum("steps").alias("steps"), F.sum("again").alias("again"), *[F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("n"))), F.lit(0)).alias(t) for t in _TRAITS])
    one = g.agg(
        F.count("*").alias("games"), F.sum("plies").alias("moves"), F.avg(num(F.col("ending") == "purchase")).alias("terminal_rate"), F.avg(num(F.col("plies") >= 4)).alias("truncated_rate"), F.avg("plies").alias("mean_plies"), F.round(F.avg("last.clock"), 7).alias("mean_last_clock"),
        *[(F.sum(t) / F.sum("plies")).alias(t) for t in _TRAITS], (F.sum("again") / F.sum("steps")).alias("repeat_rate"),
    )
    listed = lambda df, k, name: df.groupBy(k).agg(F.sum("c").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "c"))), lambda x: F.concat_ws("=", x[k], x["c"])), ",").alias(name))
    kinds = listed(per.withColumn("c", F.col("n")), "event_type", "kinds")
    endings = listed(g.withColumn("c", F.lit(1)), "ending", "endings")
    return rounded(one.crossJoin(kinds).crossJoin(endings))  # three single rows


_TV = ", ".join(f"(SELECT player, sum(abs(a - b)) / 2 AS {k}_tv FROM (SELECT player, {k}, count(*) FILTER (chosen) / sum(count(*) FILTER (chosen)) OVER (PARTITION BY player) AS a, count(*) FILTER (i = 1) / sum(count(*) FILTER (i = 1)) OVER (PARTITION BY player) AS b FROM rk GROUP BY player, {k}) GROUP BY 1) {k}s" for k in ("piece", "wing"))


@query("traj_compare", POLICY_SQL + prediction_sql() + f""", sq AS (SELECT *, lag(hp) OVER w AS hprior, lag(tp) OVER w AS tprior FROM (SELECT decision_id, max(player) AS player, max(game_id) AS game_id, max(ply) AS ply, max(piece) FILTER (chosen) AS hp, max(piece) FILTER (i = 1) AS tp, max(quantity) FILTER (chosen) AS hq, max(quantity) FILTER (i = 1) AS tq,
    {', '.join(f'bool_or("{f}") FILTER (chosen) AS h_{f}, bool_or("{f}") FILTER (i = 1) AS t_{f}' for f in FLAGS)} FROM rk GROUP BY 1) WINDOW w AS (PARTITION BY game_id ORDER BY ply)),
  o AS (SELECT player, ({' + '.join(f'abs(avg(h_{f}::int) - avg(t_{f}::int))' for f in FLAGS)}) / {len(FLAGS)} AS rate_error, abs(avg((hp = hprior)::int) - avg((tp = tprior)::int)) AS sequence_error, abs(avg(hq) - avg(tq)) AS structure_error FROM sq GROUP BY 1)
  SELECT o.player, round(piece_tv, 9) AS piece_tv, round(wing_tv, 9) AS wing_tv, round(rate_error, 9) AS rate_error, round(sequence_error, 9) AS sequence_error, round(structure_error, 9) AS structure_error FROM o, {_TV} WHERE o.player = pieces.player AND o.player = wings.player""")
def traj_compare(spark, sf_dir):
    """Per player how the policy's first choices differ from the moves that were made: flags, pieces, wings,
    repeats within a game, and structure."""
    w = Window.partitionBy("decision_id").orderBy(F.desc("p"), "move")
    own = test_policy(spark, sf_dir).withColumn("i", F.row_number().over(w))
    human, top = (lambda c: F.max(F.when(F.col("chosen"), F.col(c)))), (lambda c: F.max(F.when(F.col("i") == 1, F.col(c))))
    fields = ("piece", "wing", "quantity", *FLAGS)
    d = durable(own.groupBy("decision_id").agg(*[F.max(c).alias(c) for c in ("player", "game_id", "ply")], *[human(c).alias(f"h_{c}") for c in fields], *[top(c).alias(f"t_{c}") for c in fields]))
    game = Window.partitionBy("game_id").orderBy("ply")
    sq = d.withColumns({f"{s_}_prior": F.lag(f"{s_}_piece").over(game) for s_ in "ht"})
    gap = lambda a, b: F.abs(F.avg(a.cast("double")) - F.avg(b.cast("double")))
    rates = sum((gap(F.col(f"h_{f}"), F.col(f"t_{f}")) for f in FLAGS), F.lit(0.0)) / len(FLAGS)
    out = sq.groupBy("player").agg(rates.alias("rate_error"), gap(F.col("h_piece") == F.col("h_prior"), F.col("t_piece") == F.col("t_prior")).alias("sequence_error"), gap(F.col("h_quantity"), F.col("t_quantity")).alias("structure_error"))
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s_).alias("s"), F.col(f"{s_}_{k}").alias("v")) for k in ("piece", "wing") for s_ in "ht"])
    n = d.select("player", F.explode(sides).alias("x")).groupBy("player", "x.k", "x.v").agg(F.count_if(F.col("x.s") == "h").alias("a"), F.count_if(F.col("x.s") == "t").alias("b"))
    total = Window.partitionBy("player", "k")
    shares = n.withColumn("gap", F.abs(F.col("a") / F.sum("a").over(total) - F.col("b") / F.sum("b").over(total)))
    tv = shares.groupBy("player").agg(*[(F.sum(F.when(F.col("k") == k, F.col("gap"))) / 2).alias(f"{k}_tv") for k in ("piece", "wing")])
    return rounded(out.join(tv, "player"))
