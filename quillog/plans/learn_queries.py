"""Queries of model-side data jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillog.operators import learn
from quillog.operators import policy as pol
from quillog.operators import trees
from quillog.session import durable, written
from quillog.sources.bindings import LOG_SQL, RESIDUALS, candidates

from .history_queries import PIECES, TRAIN_SQL, WINGS, with_split
from .metric_queries import rounded
from .registry import query

PHASES = ["F", "O", "P"]
#: The five clipped numbers beside the flags, in words that both engines read alike.
SCALED = {
    "behind": "least(1.0, engine_rank / 10.0)", "price": "least(1.0, base_logit / 5.0)", "material": "quantity / 50.0",
    "gain": "greatest(-1.0, least(1.0, (score_cp - 500) / 500.0))", "depth": "least(1.0, ply / 40.0)",
}
N = len(RESIDUALS) + len(SCALED) + len(PIECES) + len(WINGS)


def features(spark, sf_dir, split="train", form=learn.packed_features):
    cs = with_split(spark, sf_dir).where(F.col("split") == split)
    numeric = {name: F.expr(text).cast("double") for name, text in SCALED.items()}
    return form(cs, RESIDUALS, numeric, PHASES, {"piece": PIECES, "wing": WINGS})


_BASE = [*[f'"{f}"::int::double' for f in RESIDUALS], *[f"({text})::double" for text in SCALED.values()], *[f"(piece = '{p}')::int::double" for p in PIECES], *[f"(wing = '{w}')::int::double" for w in WINGS]]
_LIST = ", ".join(_BASE)
FEAT_SQL = TRAIN_SQL + f""", fv AS (SELECT player, decision_id, engine_rank, chosen, base_logit, [{_LIST}] AS v, CASE phase WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS ph, ('0x' || substr(sha256(position_key || '|' || move), 1, 8))::bigint % 128 AS hb FROM cs WHERE split = 'train'),
  ft AS (SELECT player, decision_id, engine_rank, chosen, base_logit, (i - 1)::int AS idx, v[i] AS val FROM fv, range(1, {N + 1}) t(i) WHERE v[i] <> 0
   UNION ALL SELECT player, decision_id, engine_rank, chosen, base_logit, ({N} * (1 + ph) + i - 1)::int, v[i] FROM fv, range(1, {N + 1}) t(i) WHERE v[i] <> 0
   UNION ALL SELECT player, decision_id, engine_rank, chosen, base_logit, ({N * 4} + hb)::int, 1.0 FROM fv)"""


@query("feat_residual_sparse", FEAT_SQL + "SELECT idx, count(*) AS n, round(sum(val), 6) AS total FROM ft GROUP BY 1")
def feat_residual_sparse(spark, sf_dir):
    long = features(spark, sf_dir).select(learn.entries_of(F.col("x")).alias("x")).select("x.*")
    return long.groupBy("idx").agg(F.count("*").alias("n"), F.round(F.sum("val"), 6).alias("total"))


def some_beta(feats):
    """Coefficients made from their index, to evaluate the objective at a given point; a table of known size, so
    that Spark meets the features with it by a broadcast while it is small and doesn't deal them by player."""
    at = F.flatten(F.transform("c", lambda c: c["x"]["idx"])) if "c" in feats.columns else F.col("x.idx")
    return written(feats.select("player", learn.entries_of(at).alias("idx")).distinct().withColumn("beta", (F.col("idx") % 7 - 3) / 20.0))


BETA_SQL = FEAT_SQL + """, bt AS (SELECT DISTINCT player, idx, (idx % 7 - 3) / 20.0 AS beta FROM ft),
  lg AS (SELECT f.player, decision_id, engine_rank, chosen, max(base_logit) + sum(val * beta) AS logit FROM ft f JOIN bt USING (player, idx) GROUP BY ALL), ps AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY player, decision_id) AS p FROM lg)"""


@query("prob_residual", BETA_SQL + "SELECT decision_id, engine_rank, round(p, 9) AS p FROM ps")
def prob_residual(spark, sf_dir):
    feats = written(features(spark, sf_dir))
    return learn.scored(feats, some_beta(feats)).select("decision_id", "engine_rank", F.round("p", 9).alias("p"))


@query("ml_listwise_objective", BETA_SQL + ", nl AS (SELECT player, count(*) AS decisions, avg(-ln(p)) AS nll FROM ps WHERE chosen GROUP BY 1), nm AS (SELECT player, sum(beta * beta) AS norm FROM bt GROUP BY 1) SELECT player, decisions, round(nll, 9) AS nll, round(nll + 0.005 * norm, 9) AS objective FROM nl JOIN nm USING (player)")
def ml_listwise_objective(spark, sf_dir):
    feats = written(features(spark, sf_dir))
    return rounded(learn.objective(feats, some_beta(feats), 0.01))


@query("ml_listwise_gradient", BETA_SQL + ", n AS (SELECT player, count(DISTINCT decision_id) AS n FROM ft GROUP BY 1) , gr AS (SELECT f.player, f.idx, sum((p - f.chosen::int) * val) / max(n) + 0.01 * max(beta) AS g FROM ft f JOIN ps USING (player, decision_id, engine_rank) JOIN n USING (player) JOIN bt USING (player, idx) GROUP BY ALL) SELECT player, idx, CASE WHEN abs(g) < 5e-10 THEN 0.0 ELSE round(g, 9) END AS gradient FROM gr")
def ml_listwise_gradient(spark, sf_dir):
    feats = written(learn.by_decision(features(spark, sf_dir)))
    return learn.gradient(feats, some_beta(feats), 0.01).select("player", "idx", F.when(F.abs("gradient") < 5e-10, 0.0).otherwise(F.round("gradient", 9)).alias("gradient"))


@query("ml_listwise_fit", FEAT_SQL + """, few AS (SELECT DISTINCT player, idx FROM ft) SELECT player, idx, true AS flat, true AS lower FROM few""")
def ml_listwise_fit(spark, sf_dir):
    """Every coefficient of the converged fits: the gradient is flat there and the objective below that of zero.

    The objective is strictly convex, so a flat gradient marks the only fit; SQL has the same rows.
    """
    feats = written(features(spark, sf_dir, form=learn.chunked_features))
    fitted = learn.fit(feats, tolerance=1e-6)
    zero = learn.base_objective(feats).select("player", F.col("objective").alias("_zero"))
    return fitted.join(zero, "player").select("player", "idx", (F.abs("gradient") <= 1e-6).alias("flat"), (F.col("objective") < F.col("_zero")).alias("lower"))


@query("ml_shared_mean", BETA_SQL + "SELECT idx, round(sum(beta) / (SELECT count(DISTINCT player) FROM bt), 9) AS beta FROM bt GROUP BY 1")
def ml_shared_mean(spark, sf_dir):
    return rounded(learn.shared_mean(some_beta(features(spark, sf_dir))), keep=())


BEHAVIOR, OPPORTUNITY = (0, 1, 2, 3), (0, 2)
_GAPS = ", ".join(f"sum((po - chosen::int) * v{k}) AS g{k}, min(v{k}) <> max(v{k}) AS o{k}" for k in BEHAVIOR)


@query("ml_objective_terms", BETA_SQL + f""", l0 AS (SELECT player, decision_id, engine_rank, chosen, max(base_logit) AS b, max(base_logit) + sum(val * beta) AS o, max(base_logit) + sum(val * -beta) AS d, {', '.join(f'coalesce(sum(val) FILTER (idx = {k}), 0) AS v{k}' for k in BEHAVIOR)} FROM ft JOIN bt USING (player, idx) GROUP BY ALL),
  p3 AS (SELECT *, exp(b) / sum(exp(b)) OVER w AS pb, exp(o) / sum(exp(o)) OVER w AS po, exp(d) / sum(exp(d)) OVER w AS pd FROM l0 WINDOW w AS (PARTITION BY player, decision_id)),
  pr AS (SELECT player, decision_id, sum(CASE WHEN chosen THEN -ln(po) END) AS i, sum(CASE WHEN chosen THEN ln(1 + exp(ln(pd) - ln(po) + 0.1)) END) AS c, sum(po * (ln(po) - ln(pb))) AS k, {_GAPS} FROM p3 GROUP BY ALL)
  SELECT player, round(avg(i), 9) AS imitation, round(avg(c), 9) AS contrast, round(avg(k), 9) AS kl, round(({' + '.join(f'avg(g{k}) ** 2' for k in BEHAVIOR)}) / {len(BEHAVIOR)}, 9) AS behavior_moment,
   round(({' + '.join(f'coalesce(avg(CASE WHEN o{k} THEN g{k} END), 0) ** 2' for k in OPPORTUNITY)}) / {len(OPPORTUNITY)}, 9) AS opportunity_moment FROM pr GROUP BY 1""")
def ml_objective_terms(spark, sf_dir):
    feats = written(features(spark, sf_dir))
    own = some_beta(feats)
    return rounded(learn.objective_terms(feats, own, own.withColumn("beta", -F.col("beta")), behavior=BEHAVIOR, opportunity=OPPORTUNITY))


NUMBERS, CATEGORIES = ["rating_known", "score_cp", "engine_rank"], ["piece", "wing", "phase"]


def labelled(spark, sf_dir):
    known = F.when(F.col("decision_id") % 6 != 0, F.col("rating"))
    return with_split(spark, sf_dir).withColumns({"rating_known": known, "engine_rank": F.col("engine_rank").cast("double"), "score_cp": F.col("score_cp").cast("double")})


@query("ml_preprocess", TRAIN_SQL + """, kc AS (SELECT *, CASE WHEN decision_id % 6 <> 0 THEN rating END AS known, CASE WHEN split = 'test' AND decision_id % 13 = 0 THEN 'late' WHEN decision_id % 11 <> 0 THEN time_control END AS control, CASE WHEN split <> 'train' THEN score_cp END AS later FROM cs),
  m AS (SELECT median(known) AS med FROM kc WHERE split = 'train'), w AS (SELECT control, row_number() OVER (ORDER BY control) - 1 AS i FROM (SELECT DISTINCT coalesce(control, '__MISSING__') AS control FROM kc WHERE split = 'train'))
  SELECT split, count(*) AS n, count_if(known IS NULL) AS filled, round(avg(coalesce(known, med)), 6) AS mean_rating, round(avg(coalesce(later, 0)), 6) AS mean_later, count_if(kc.control IS NULL) AS missing, count_if(i IS NULL) AS unknown, sum(coalesce(i, (SELECT count(*) FROM w)))::bigint AS control_indexes
  FROM kc CROSS JOIN m LEFT JOIN w ON w.control = coalesce(kc.control, '__MISSING__') GROUP BY 1""")
def ml_preprocess(spark, sf_dir):
    """All splits through the preprocessing fitted on the training split alone.

    Ratings lack values everywhere, ``later`` has none in training, ``control`` lacks values and has one
    category that training doesn't know.
    """
    k, split = F.col("decision_id"), F.col("split")
    control = F.when((split == "test") & (k % 13 == 0), "late").otherwise(F.when(k % 11 != 0, F.col("time_control")))
    rows = durable(labelled(spark, sf_dir).withColumns({"control": control, "later": F.when(split != "train", F.col("score_cp"))}).select("split", "rating_known", "later", "control"))
    fitted = learn.Preprocessor(["rating_known", "later"], ["control"]).fit(rows.where("split = 'train'"))
    unknown = len(fitted.levels["control"])
    return fitted.transform(rows).groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("rating_known").isNull()).alias("filled"), F.round(F.avg("rating_known_filled"), 6).alias("mean_rating"), F.round(F.avg("later_filled"), 6).alias("mean_later"),
        F.count_if(F.col("control").isNull()).alias("missing"), F.count_if(F.col("control_index") == unknown).alias("unknown"), F.sum(F.col("control_index").cast("bigint")).alias("control_indexes"),
    )


def _weighted(spark, sf_dir):
    rows = durable(labelled(spark, sf_dir).withColumn("is_validation", F.col("split") == "validation"))
    return learn.balanced(rows, rows.where("split = 'train'"))


def _scored(rows, classifier, columns=(NUMBERS, CATEGORIES)):
    prep = learn.Preprocessor(*columns).fit(rows.where("split = 'train'"))
    train = prep.transform(rows.where("split <> 'test'" if isinstance(classifier, learn.GBTClassifier) else "split = 'train'"))
    trainer = trees.BinnedBoosted if isinstance(classifier, learn.GBTClassifier) else trees.BinnedForest
    model = trainer(classifier, trees.Bins(prep).fit(train)).fit(train)
    test = model.transform(prep.transform(rows.where("split = 'test'")))
    return model, train, test.withColumn("p", pol.normalized(F.col("score")))


def _report(test):
    return test.where("chosen").agg(F.count("*").alias("decisions"), F.avg(-F.log(F.greatest("p", F.lit(pol.FLOOR)))).alias("nll"), F.avg("p").alias("mean_p"))


@query("ml_binary_forest")
def ml_binary_forest(spark, sf_dir):
    """A forest of 160 trees of depth 10 whose scores are normalised by decision."""
    return _report(_scored(_weighted(spark, sf_dir), learn.forest())[2])


@query("ml_binary_boosted")
def ml_binary_boosted(spark, sf_dir):
    return _report(_scored(_weighted(spark, sf_dir), learn.boosted())[2])


@query("ml_feature_ablation")
def ml_feature_ablation(spark, sf_dir):
    """The same trainer on nested feature sets."""
    out, rows = None, _weighted(spark, sf_dir)
    for name, columns in (("rank", (["engine_rank"], ["wing"])), ("rank_piece", (["engine_rank"], ["piece", "wing"])), ("all", (NUMBERS, CATEGORIES))):
        row = _report(_scored(rows, learn.forest(), columns)[2]).withColumn("features", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("ml_importance")
def ml_importance(spark, sf_dir):
    model, train, _ = _scored(_weighted(spark, sf_dir), learn.forest())
    return learn.importance(model, train)
