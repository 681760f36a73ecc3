"""From scores to grouped probabilities, baselines and draws. All windows are by decision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import durable

FLOOR = 1e-15


def by_decision(decision: str = "decision_id"):
    return Window.partitionBy(decision)


def normalized(score: Column, decision: str = "decision_id") -> Column:
    """Scores below zero count as zero; a decision without any score is uniform."""
    s = F.greatest(score, F.lit(0.0))
    total = F.sum(s).over(by_decision(decision))
    return F.when(total > 0, s / total).otherwise(1.0 / F.count("*").over(by_decision(decision)))


def softmax(score: Column, temperature: Column | float = 1.0, keys: tuple[str, ...] = ("decision_id",)) -> Column:
    """Softmax within the keys, shifted by the largest score."""
    w = Window.partitionBy(*keys)
    scaled = score / temperature
    e = F.exp(scaled - F.max(scaled).over(w))
    return e / F.sum(e).over(w)


def log_loss(cand: DataFrame, p: str, keys: list[str] | None = None) -> DataFrame:
    own = cand.where("chosen")
    return own.groupBy(*(keys or [])).agg(F.avg(-F.log(F.greatest(p, F.lit(FLOOR)))).alias("nll"), F.count("*").alias("decisions"))


def temperature_grid(low: float, high: float, n: int) -> list[float]:
    """Points at equal distances in log space."""
    step = (high / low) ** (1 / (n - 1))
    return [low * step**i for i in range(n)]


def grid_losses(cand: DataFrame, score: str, grid: list[float]) -> DataFrame:
    """NLL at each temperature. The softmax of all grid points is taken in one pass over the
    candidates: a decision is reduced to one loss per point before anything is exploded."""
    w = by_decision()
    top = F.max(score).over(w)
    shifted = cand.select("decision_id", "chosen", (F.col(score) - top).alias("_s"))
    per = shifted.groupBy("decision_id").agg(
        *[F.log(F.sum(F.exp(F.col("_s") / t))).alias(f"_z{i}") for i, t in enumerate(grid)], F.max(F.when(F.col("chosen"), F.col("_s"))).alias("_c")
    )
    means = per.agg(*[F.avg(F.least(F.col(f"_z{i}") - F.col("_c") / t, F.lit(34.538776394910684))).alias(f"l{i}") for i, t in enumerate(grid)])
    return means.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"l{i}").alias("nll")) for i, t in enumerate(grid)])).alias("x")).select("x.*")


#: -log of the probability floor: no decision loses more.
MOST_LOSS = 34.538776394910684


def temperature_slopes(decisions: DataFrame, log_t: float) -> tuple[float, float, float]:
    """(mean NLL, its first and its second derivative in log T) over ``decisions`` (s, c): scores less their
    greatest, and the chosen one. Decisions at the loss floor are flat. One pass without a shuffle of rows."""
    beta = math.exp(-log_t)
    e = F.transform("s", lambda x: F.exp(x * beta))
    total = lambda f: F.aggregate(F.zip_with("e", "s", f), F.lit(0.0), lambda a, x: a + x)
    own = decisions.select("s", "c", e.alias("e")).select("c", total(lambda e, s: e).alias("z"), total(lambda e, s: e * s).alias("m"), total(lambda e, s: e * s * s).alias("q"))
    own = own.select((F.log("z") - F.col("c") * beta).alias("loss"), (F.col("m") / F.col("z") - F.col("c")).alias("d1"), (F.col("q") / F.col("z") - F.pow(F.col("m") / F.col("z"), F.lit(2))).alias("d2"))
    free = F.col("loss") < MOST_LOSS
    loss, d1, d2 = own.agg(F.avg(F.least("loss", F.lit(MOST_LOSS))), F.avg(F.when(free, F.col("d1")).otherwise(0.0)), F.avg(F.when(free, F.col("d2")).otherwise(0.0))).first()
    return (0.0, 0.0, 0.0) if loss is None else (loss, -beta * d1, beta * d1 + beta * beta * d2)


def fit_temperature(cand: DataFrame, score: str, *, low: float = 0.05, high: float = 20.0, tolerance: float = 1e-9, passes: int = 60) -> tuple[float, float]:
    """(temperature, NLL) that minimise NLL between two bounds: safeguarded Newton on log T.

    Decisions become one row each, once; a pass aggregates loss, slope and curvature, and three numbers come
    to the driver. A step that leaves the bracket of slopes, or meets no upward curvature, halves the bracket
    instead. It ends when a step is within ``tolerance`` or at a bound towards which the loss falls. Decisions
    without a choice don't count; without any the temperature is 1, or the bound next to it.
    """
    top = F.max(score).over(by_decision())
    shifted = cand.select("decision_id", "chosen", (F.col(score) - top).alias("_s"))
    decisions = durable(shifted.groupBy("decision_id").agg(F.collect_list("_s").alias("s"), F.max(F.when(F.col("chosen"), F.col("_s"))).alias("c")).where("c IS NOT NULL").select("s", "c"))
    a, b = math.log(low), math.log(high)
    at = min(b, max(a, 0.0))
    for bound, falls in ((a, lambda d: d >= 0), (b, lambda d: d <= 0)):
        loss, d1, d2 = temperature_slopes(decisions, bound)
        if falls(d1) and (d1 or d2):
            return math.exp(bound), loss
    for _ in range(passes):
        loss, d1, d2 = temperature_slopes(decisions, at)
        a, b = (a, at) if d1 > 0 else (at, b)
        step = at - d1 / d2 if d2 > 0 else math.inf
        new = step if a < step < b else (a + b) / 2
        if d1 == 0 or abs(new - at) <= tolerance:
            return math.exp(at if d1 == 0 else new), loss
        at = new
    return math.exp(at), loss


def uniform(decision: str = "decision_id") -> Column:
    return 1.0 / F.count("*").over(by_decision(decision))


def supported(count: Column, decision: str = "decision_id") -> Column:
    return F.max(count).over(by_decision(decision)) > 0


def history_or(count: Column, other: Column, decision: str = "decision_id") -> Column:
    """The historical share where any candidate has support, else the other probability."""
    total = F.sum(count).over(by_decision(decision))
    return F.when(supported(count, decision), count / total).otherwise(other)


def draw(cand: DataFrame, p: str, seed: int, sample: int = 0, decision: str = "decision_id", move: str = "move") -> DataFrame:
    """One move per decision by inverse CDF over moves in order; arms with one seed share the draw."""
    from quillog.functions.scalars import hash_uniform

    w = Window.partitionBy(decision).orderBy(move)
    own = cand.withColumns(
        {"_c": F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_u": hash_uniform(F.lit(str(seed)), F.col(decision).cast("string"), F.lit(str(sample)))}
    )
    hit = F.min(F.when(F.col("_u") < F.col("_c"), F.col(move)))
    return own.groupBy(decision).agg(F.coalesce(hit, F.max(move)).alias("drawn"))


def top_list(cand: DataFrame, p: str, k: int, *, ties: list[str] = ("engine_rank", "move")) -> DataFrame:
    w = by_decision().orderBy(F.desc(p), *ties)
    return cand.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def residual_logit(features: DataFrame, beta: DataFrame) -> DataFrame:
    """Sum of value times the player's coefficient; players and indexes without one add nothing."""
    joined = features.join(beta, ["player", "idx"], "left")
    return joined.groupBy("decision_id", "engine_rank").agg(F.sum(F.col("val") * F.coalesce("beta", F.lit(0.0))).alias("residual"))
