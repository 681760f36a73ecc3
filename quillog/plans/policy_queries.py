"""Queries of candidate construction, probabilities and draws."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.operators import policy as pol
from quillog.session import durable
from quillog.sources.bindings import LOG_SQL, candidates

from .history_queries import FREQ_SQL, TRAIN_SQL, rank_frequency, with_split
from .registry import query

D = "(PARTITION BY decision_id)"
R9 = lambda c: F.round(c, 9)


@query("cand_topk_prefix", LOG_SQL + """SELECT decision_id, engine_rank, bool_or(chosen) OVER (PARTITION BY decision_id) AS usable, first_value(score_cp) OVER (PARTITION BY decision_id ORDER BY engine_rank) - score_cp AS behind FROM cand WHERE engine_rank <= 3""")
def cand_topk_prefix(spark, sf_dir):
    """The first three candidates, whether the choice is among them, and how far each is behind the best."""
    w = Window.partitionBy("decision_id")
    own = candidates(spark, sf_dir).where("engine_rank <= 3")
    return own.select("decision_id", "engine_rank", F.bool_or("chosen").over(w).alias("usable"), (F.first("score_cp").over(w.orderBy("engine_rank")) - F.col("score_cp")).alias("behind"))


@query("cand_all_legal", LOG_SQL + """SELECT decision_id, move, chosen, phase, time_control, CASE WHEN phase = 'F' THEN opening END AS opening FROM cand WHERE decision_id NOT IN (SELECT decision_id FROM cand GROUP BY 1 HAVING count_if(chosen) <> 1)""")
def cand_all_legal(spark, sf_dir):
    """One row per candidate of decisions with one choice; opening tags only where they are archived."""
    w = Window.partitionBy("decision_id")
    own = candidates(spark, sf_dir).withColumn("_n", F.count_if("chosen").over(w)).where("_n = 1")
    return own.select("decision_id", "move", "chosen", "phase", "time_control", F.when(F.col("phase") == "F", F.col("opening")).alias("opening"))


_S = "greatest(CASE WHEN decision_id % 30 = 0 THEN -1.0 ELSE base_logit - 2 END, 0)"


@query("cand_score_normalize", LOG_SQL + f"SELECT decision_id, engine_rank, round(CASE WHEN sum({_S}) OVER {D} > 0 THEN {_S} / sum({_S}) OVER {D} ELSE 1.0 / count(*) OVER {D} END, 9) AS p FROM cand")
def cand_score_normalize(spark, sf_dir):
    score = F.when(F.col("decision_id") % 30 == 0, -1.0).otherwise(F.col("base_logit") - 2)
    return candidates(spark, sf_dir).select("decision_id", "engine_rank", R9(pol.normalized(score)).alias("p"))


SOFT = LOG_SQL + f", soft AS (SELECT *, exp(base_logit / 0.7 - max(base_logit / 0.7) OVER {D}) AS e FROM cand), pr AS (SELECT *, e / sum(e) OVER {D} AS p FROM soft)"


@query("prob_softmax", SOFT + "SELECT decision_id, engine_rank, round(p, 9) AS p FROM pr")
def prob_softmax(spark, sf_dir):
    return candidates(spark, sf_dir).select("decision_id", "engine_rank", R9(pol.softmax(F.col("base_logit"), 0.7)).alias("p"))


_GRID = pol.temperature_grid(0.05, 20.0, 9)
_VALUES = ", ".join(f"({t!r}::double)" for t in _GRID)


@query("prob_temperature_grid", TRAIN_SQL + f""", v AS (SELECT decision_id, chosen, base_logit - max(base_logit) OVER {D} AS s FROM cs WHERE split = 'validation'),
  per AS (SELECT decision_id, t, ln(sum(exp(s / t))) - max(CASE WHEN chosen THEN s END) / t AS loss FROM v CROSS JOIN (VALUES {_VALUES}) g(t) GROUP BY decision_id, t) SELECT round(t, 9) AS temperature, round(avg(least(loss, 34.538776394910684)), 7) AS nll FROM per GROUP BY t""")
def prob_temperature_grid(spark, sf_dir):
    g = pol.grid_losses(with_split(spark, sf_dir).where("split = 'validation'"), "base_logit", _GRID)
    return g.select(R9("temperature").alias("temperature"), F.round("nll", 7).alias("nll"))


def _bisected(steps: int = 44) -> str:
    """SQL that halves a bracket of log T by the sign of the slope; CTEs t0, t1, ... of (lo, hi)."""
    out = [", t0 AS (SELECT ln(0.05) AS lo, ln(20.0) AS hi)"]
    slope = "avg(CASE WHEN z - c * exp(-m) < 34.538776394910684 THEN -exp(-m) * (ms - c) ELSE 0 END)"
    for k in range(steps):
        out.append(f""", p{k} AS MATERIALIZED (SELECT any_value(lo) AS lo, any_value(hi) AS hi, any_value(m) AS m, max(CASE WHEN chosen THEN s END) AS c, ln(sum(exp(s * exp(-m)))) AS z, sum(s * exp(s * exp(-m))) / sum(exp(s * exp(-m))) AS ms FROM v, (SELECT lo, hi, (lo + hi) / 2 AS m FROM t{k}) GROUP BY decision_id),
  t{k + 1} AS MATERIALIZED (SELECT CASE WHEN {slope} > 0 THEN any_value(lo) ELSE any_value(m) END AS lo, CASE WHEN {slope} > 0 THEN any_value(m) ELSE any_value(hi) END AS hi FROM p{k})""")
    return "".join(out)


@query("prob_temperature_fit", TRAIN_SQL + f""", w AS (SELECT decision_id, chosen, quantity / 16 + base_logit AS raw FROM cs WHERE split = 'validation'), v AS MATERIALIZED (SELECT decision_id, chosen, raw - max(raw) OVER {D} AS s FROM w){_bisected()},
  b AS (SELECT exp((lo + hi) / 2) AS t FROM t44), per AS (SELECT decision_id, ln(sum(exp(s / t))) - max(CASE WHEN chosen THEN s END) / any_value(t) AS loss FROM v, b GROUP BY 1)
  SELECT (SELECT count(*) FROM per) AS decisions, round(t, 6) AS temperature, (SELECT round(avg(least(loss, 34.538776394910684)), 7) FROM per) AS nll FROM b""")
def prob_temperature_fit(spark, sf_dir):
    """The temperature of a score whose optimum lies inside the bounds, to six digits; SQL halves a bracket instead."""
    valid = with_split(spark, sf_dir).where("split = 'validation'").withColumn("score", F.col("quantity") / 16 + F.col("base_logit"))
    t, nll = pol.fit_temperature(valid, "score")
    return valid.agg(F.count_distinct("decision_id").alias("decisions")).select("decisions", F.round(F.lit(t), 6).alias("temperature"), F.round(F.lit(nll), 7).alias("nll"))


@query("prob_baseline_rank1", LOG_SQL + "SELECT decision_id, engine_rank, (engine_rank = 1)::int::double AS p FROM cand")
def prob_baseline_rank1(spark, sf_dir):
    return candidates(spark, sf_dir).select("decision_id", "engine_rank", (F.col("engine_rank") == 1).cast("double").alias("p"))


def frequencies(spark, sf_dir, cs=None):
    """Test candidates with the training share of their rank (a table of 15 rows). The log with its split
    is read for both, so it is written once."""
    cs = durable(with_split(spark, sf_dir)) if cs is None else cs
    freq = rank_frequency(cs.where("split = 'train'"), 15)
    return cs.where("split = 'test'").join(F.broadcast(freq), "engine_rank", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


TEST_SQL = FREQ_SQL + f""", te AS (SELECT cs.*, coalesce(frequency, 0) AS f FROM cs LEFT JOIN freq USING (engine_rank) WHERE split = 'test'),
  rf AS (SELECT *, CASE WHEN sum(f) OVER {D} > 0 THEN f / sum(f) OVER {D} ELSE 1.0 / count(*) OVER {D} END AS p FROM te)"""


@query("prob_baseline_rank_freq", TEST_SQL + "SELECT decision_id, engine_rank, round(p, 9) AS p FROM rf")
def prob_baseline_rank_freq(spark, sf_dir):
    return frequencies(spark, sf_dir).select("decision_id", "engine_rank", R9(pol.normalized(F.col("frequency"))).alias("p"))


HIST_SQL = TEST_SQL + f""", hc AS (SELECT opening, piece, wing, player, count(*) AS n FROM cs WHERE split = 'train' AND chosen GROUP BY ALL),
  hs AS (SELECT rf.*, coalesce(n, 0) AS n FROM rf LEFT JOIN hc USING (opening, piece, wing, player)),
  hp AS (SELECT *, CASE WHEN max(n) OVER {D} > 0 THEN n / sum(n) OVER {D} ELSE p END AS q FROM hs)"""
_KEY = ["opening", "piece", "wing", "player"]


def with_history(spark, sf_dir):
    cs = durable(with_split(spark, sf_dir))
    counts = cs.where("split = 'train' AND chosen").groupBy(*_KEY).agg(F.count("*").alias("n"))
    test = frequencies(spark, sf_dir, cs).withColumn("p", pol.normalized(F.col("frequency")))
    return test.join(counts, _KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("prob_baseline_history", HIST_SQL + "SELECT decision_id, engine_rank, round(q, 9) AS p FROM hp")
def prob_baseline_history(spark, sf_dir):
    return with_history(spark, sf_dir).select("decision_id", "engine_rank", R9(pol.history_or(F.col("n"), F.col("p"))).alias("p"))


@query("prob_uniform", LOG_SQL + f"SELECT decision_id, engine_rank, round(1.0 / count(*) OVER {D}, 9) AS p FROM cand")
def prob_uniform(spark, sf_dir):
    return candidates(spark, sf_dir).select("decision_id", "engine_rank", R9(pol.uniform()).alias("p"))


@query("prob_move_frequency", TRAIN_SQL + f""", mf AS (SELECT position_key, count(*) AS n FROM cs WHERE split = 'train' AND chosen GROUP BY 1), w AS (SELECT decision_id, engine_rank, coalesce(n, 0) + 1 AS w FROM cs LEFT JOIN mf USING (position_key) WHERE split = 'test')
  SELECT decision_id, engine_rank, round(w / sum(w) OVER {D}, 9) AS p FROM w""")
def prob_move_frequency(spark, sf_dir):
    cs = with_split(spark, sf_dir)
    counts = cs.where("split = 'train' AND chosen").groupBy("position_key").agg(F.count("*").alias("n"))
    test = cs.where("split = 'test'").join(counts, "position_key", "left")
    return test.select("decision_id", "engine_rank", R9(pol.normalized((F.coalesce("n", F.lit(0)) + 1).cast("double"))).alias("p"))


@query("prob_hybrid", HIST_SQL + f", m AS (SELECT *, exp(base_logit) / sum(exp(base_logit)) OVER {D} AS model FROM hs) SELECT decision_id, engine_rank, round(CASE WHEN max(n) OVER {D} > 0 THEN n / sum(n) OVER {D} ELSE model END, 9) AS p FROM m")
def prob_hybrid(spark, sf_dir):
    own = with_history(spark, sf_dir).withColumn("model", pol.softmax(F.col("base_logit")))
    return own.select("decision_id", "engine_rank", R9(pol.history_or(F.col("n"), F.col("model"))).alias("p"))


@query("prob_inverse_cdf", SOFT + """, c AS (SELECT decision_id, move, sum(p) OVER (PARTITION BY decision_id ORDER BY move) AS cum, ('0x' || substr(sha256('42:' || decision_id || ':0'), 1, 16))::ubigint::double / 18446744073709551616.0::double AS u FROM pr)
  SELECT decision_id, coalesce(min(move) FILTER (u < cum), max(move)) AS drawn FROM c GROUP BY 1""")
def prob_inverse_cdf(spark, sf_dir):
    return pol.draw(candidates(spark, sf_dir).withColumn("p", pol.softmax(F.col("base_logit"), 0.7)), "p", 42)


@query("rank_topn_predict", SOFT + "SELECT decision_id, move, i::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY round(p, 12) DESC, engine_rank, move) AS i FROM pr) WHERE i <= 3")
def rank_topn_predict(spark, sf_dir):
    own = candidates(spark, sf_dir).withColumn("p", F.round(pol.softmax(F.col("base_logit"), 0.7), 12))
    return pol.top_list(own, "p", 3).select("decision_id", "move", "place")


@query("policy_resolve", LOG_SQL + """, models AS (SELECT player FROM dec GROUP BY 1 HAVING count(*) >= 590)
  SELECT d.decision_id, CASE WHEN d.phase = 'P' THEN 'shared' WHEN m.player IS NOT NULL THEN 'personal' WHEN d.time_control = '1-URGENT' THEN 'error' ELSE 'population' END AS arm FROM dec d LEFT JOIN models m USING (player)""")
def policy_resolve(spark, sf_dir):
    """auto takes the personal model where there is one; explicit personal (urgent) without one is an error."""
    from quillog.sources.bindings import decisions

    dec = decisions(spark, sf_dir)
    models = dec.groupBy("player").agg(F.count("*").alias("n")).where("n >= 590").select("player", F.lit(True).alias("has"))
    arm = F.when(F.col("phase") == "P", "shared").when(F.col("has"), "personal").when(F.col("time_control") == "1-URGENT", "error").otherwise("population")
    return dec.join(models, "player", "left").select("decision_id", arm.alias("arm"))
