"""Quality of moves against a reference, thresholds, paired comparison and selection gates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillog.functions.scalars import win_percent
from quillog.session import durable, written

from .metrics import by_dimension
from .order_stats import dimensioned, with_quantiles

GRID = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0)
WITHIN = (25, 50, 100)
REGRETS = ("gap", "delta", "predicted_regret", "actual_regret")


def compare_scores(rows: DataFrame, actual: str = "actual_cp", predicted: str = "predicted_cp", reference: str = "reference_cp") -> DataFrame:
    """Gaps and regrets in centipawns; null unless both scores are finite (not null)."""
    a, p, r = F.col(actual), F.col(predicted), F.col(reference)
    both = a.isNotNull() & p.isNotNull()
    over = lambda x: F.when(r.isNotNull() & x.isNotNull(), F.greatest(r - x, F.lit(0)))
    out = rows.withColumns(
        {"delta": p - a, "gap": F.abs(p - a), "predicted_regret": over(p), "actual_regret": over(a), "exceeds_reference": p > r}
    )
    return out.withColumns({f"within_{t}": F.when(both, F.col("gap") <= t) for t in WITHIN})


def quality_summary(rows: DataFrame, dimensions: list[str], keys: list[str]) -> DataFrame:
    """Quality of compared rows for all and by each dimension: (keys, dimension, value, counts, rates, means, medians)."""
    used = [*keys, *dimensions, *REGRETS, "exact", *[f"within_{t}" for t in WITHIN], "actual_outcome", "predicted_outcome", "exceeds_reference"]
    rows = written(rows.select(*dict.fromkeys(used)))  # read for the rates and for the numbers of equal centipawns
    medians = {f"median_{c}": (c, 0.5) for c in REGRETS}
    long = dimensioned(rows.select(*keys, *dimensions, *REGRETS), dimensions)
    return with_quantiles(by_dimension(rows, dimensions, quality_columns(), keys=keys), long, [*keys, "dimension", "value"], medians, counted=True)


def quality_columns() -> list[Column]:
    finite, different = F.col("gap").isNotNull(), F.col("gap").isNotNull() & ~F.col("exact")
    mate = F.col("actual_outcome").contains("mate") | F.col("predicted_outcome").contains("mate")
    rate = lambda c, where=F.lit(True): F.avg(F.when(where, c.cast("double")))
    stats = [F.avg(c).alias(f"mean_{c}") for c in REGRETS]
    return [
        F.count("*").alias("decisions"), F.count_if(finite).alias("finite_pairs"), F.count_if(~finite).alias("excluded_pairs"), F.count_if(different).alias("different_finite"), rate(F.col("exact")).alias("exact_accuracy"), *stats,
        *[rate(F.col(f"within_{t}")).alias(f"within_{t}") for t in WITHIN], *[rate(F.col(f"within_{t}"), different).alias(f"different_within_{t}") for t in WITHIN],
        F.count_if(mate).alias("mate_pairs"), rate(F.col("actual_outcome") == F.col("predicted_outcome"), mate).alias("mate_agreement"),
        F.count_if((F.col("actual_outcome") == "missing") | (F.col("predicted_outcome") == "missing")).alias("missing_pairs"), F.count_if(F.col("exceeds_reference")).alias("exceeds_count"),
    ]


def to_points(rows: DataFrame) -> DataFrame:
    """Centipawns as percentage points of winning chance, and the gaps and losses between them."""
    a, p, r = (win_percent(F.col(f"{c}_cp")) for c in ("actual", "predicted", "reference"))
    own = rows.withColumns({"_a": a, "_p": p, "_r": r})
    loss = lambda x: F.when(F.col("_r").isNotNull() & F.col(x).isNotNull(), F.greatest(F.lit(0.0), F.col("_r") - F.col(x)))
    return own.withColumns({"human_gap": F.abs(F.col("_p") - F.col("_a")), "signed_gap": F.col("_p") - F.col("_a"), "predicted_loss": loss("_p"), "actual_loss": loss("_a")}).drop("_a", "_p", "_r")


def select_threshold(rows: DataFrame, *, loss: str = "actual_loss", grid: tuple[float, ...] = GRID, target: float = 0.75) -> DataFrame:
    """The smallest tolerance of the grid that covers the target share of human losses.

    One observation per decision: methods repeat it, and it must be the same in all of them.
    """
    per = rows.groupBy("decision_id").agg(F.max(loss).alias("loss"), F.count_distinct(F.coalesce(F.col(loss), F.lit(-1.0))).alias("versions"))
    cover = [F.avg((F.col("loss") <= t).cast("double")).alias(f"c{i}") for i, t in enumerate(grid)]
    wide = per.agg(F.count_if(F.col("versions") > 1).alias("inconsistent"), F.count("loss").alias("pairs"), *cover)
    chosen = F.lit(None).cast("double")
    for i, t in reversed(list(enumerate(grid))):
        chosen = F.when(F.col(f"c{i}") >= target, F.lit(t)).otherwise(chosen)
    return wide.withColumn("tolerance", chosen)


def winning_chance_columns(similar: float, sound: float) -> list[Column]:
    gap, loss = F.col("human_gap"), F.col("predicted_loss")
    out = [F.count("*").alias("decisions")]
    for name, where in (("all", F.lit(True)), ("different", ~F.col("exact"))):
        rate = lambda c, where=where: F.avg(F.when(where, c.cast("double")))
        both = F.when(gap.isNotNull() & loss.isNotNull(), (gap <= similar) & (loss <= sound))
        out += [rate(gap <= similar).alias(f"{name}_similar"), rate(loss <= sound).alias(f"{name}_sound"), rate(both).alias(f"{name}_joint")]
        out += [rate(gap <= t).alias(f"{name}_similar_{str(t).replace('.', '_')}") for t in GRID]
    return out


def severity(rows: DataFrame, loss: str = "predicted_loss", edges: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Counts and rates of losses under each edge and beyond, zeros included."""
    low = (None, *edges)
    cases = []
    for a, b in zip(low, (*edges, None), strict=True):
        inside = (F.lit(True) if a is None else F.col(loss) >= a) & (F.lit(True) if b is None else F.col(loss) < b)
        cases.append((f"<{b}" if b else f">={a}", F.count_if(F.col(loss).isNotNull() & inside)))
    wide = rows.agg(F.count(loss).alias("_n"), *[c.alias(f"_{i}") for i, (_, c) in enumerate(cases)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"_{i}").alias("n"), (F.col(f"_{i}") / F.col("_n")).alias("rate")) for i, (n, _) in enumerate(cases)])).alias("x")).select("x.*")


# --- paired comparison -----------------------------------------------------------------------


def paired(left: DataFrame, right: DataFrame, metrics: list[str], keep: list[str], key: str = "decision_id") -> DataFrame:
    """Differences right less left per decision; ``unmatched`` marks decisions on one side only."""
    a = left.select(key, *keep, *[F.col(m).cast("double").alias(f"_l_{m}") for m in metrics])
    b = right.select(key, *[F.col(m).cast("double").alias(f"_r_{m}") for m in metrics], F.lit(True).alias("_right"))
    both = a.withColumn("_left", F.lit(True)).join(b, key, "full_outer")
    return both.select(key, *keep, (F.col("_left").isNull() | F.col("_right").isNull()).alias("unmatched"), *[(F.col(f"_r_{m}") - F.col(f"_l_{m}")).alias(m) for m in metrics])


def unit_totals(diff: DataFrame, unit: str, metrics: list[str]) -> DataFrame:
    return diff.groupBy(unit).agg(F.count("*").alias("_n"), *[F.sum(m).alias(m) for m in metrics])


#: The Poisson(1) distribution function at 0, 1, ..., 8.
POISSON = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(9))
PER_HASH = 8


def multiplicities(unit: str, resamples: int, seed: int) -> np.ndarray:
    """How often a unit is drawn in each replicate: Poisson(1) counts from SHA-256, eight to a digest."""
    digests = b"".join([hashlib.sha256(f"{seed}:{block}:{unit}".encode()).digest() for block in range(-(-resamples // PER_HASH))])
    uniform = np.frombuffer(digests, dtype=">u4")[:resamples] / 4294967296.0
    return np.searchsorted(np.array(POISSON), uniform, side="right")


def bootstrap(totals: DataFrame, unit: str, metrics: list[str], *, resamples: int = 2_000, seed: int = 42, block: int = 256) -> DataFrame:
    """Estimate and percentile interval of each ratio sum(metric) / sum(_n) over resampled units.

    Instead of drawing units by number and joining them back, every unit gets its multiplicity in
    each replicate by a hash of seed, replicate and unit. A task adds ``resamples`` sums of each metric over
    its units, ``block`` of them at a time, and hands on one row with these vectors; the rows are added
    up in one task, so what is shuffled and held is a row for each task, however many units there are.
    Nulls add nothing, a null unit is one like others (as an empty name); without units the estimates are null.
    """
    own = totals.select(F.coalesce(F.col(unit).cast("string"), F.lit("")), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(["_n", *metrics])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, points, units = np.zeros((len(metrics) + 1, resamples)), np.zeros(len(metrics) + 1), 0
        for batch in batches:
            names, values = batch.column(0).to_pylist(), np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            units += len(names)
            points += values.sum(axis=1)
            for k in range(0, len(names), block):
                drawn = np.stack([multiplicities(name, resamples, seed) for name in names[k : k + block]])
                sums += values[:, k : k + block] @ drawn
        if units:
            yield pa.RecordBatch.from_arrays([pa.array([units]), pa.array([points.tolist()], pa.list_(pa.float64())), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["units", "points", "sums"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, points, units = np.zeros((len(metrics) + 1, resamples)), np.zeros(len(metrics) + 1), 0
        for batch in batches:
            for row in range(len(batch)):
                units += batch.column(0)[row].as_py()
                points += batch.column(1).slice(row, 1).flatten().to_numpy()
                sums += batch.column(2).slice(row, 1).flatten().to_numpy().reshape(sums.shape)
        ratios = sums[1:, sums[0] != 0] / sums[0, sums[0] != 0]
        cells = [[units]]
        for i in range(len(metrics)):
            low, high = np.quantile(ratios[i], (0.025, 0.975)).tolist() if ratios.shape[1] else (None, None)
            cells += [[points[i + 1] / points[0] if points[0] else None], [low], [high]]
        yield pa.RecordBatch.from_arrays([pa.array([units]), *[pa.array(c, pa.float64()) for c in cells[1:]]], names)

    names = ["units", *[f"{m}_{end}" for m in metrics for end in ("estimate", "low", "high")]]
    parts = own.mapInArrow(add, "units bigint, points array<double>, sums array<double>")
    schema = StructType([StructField("units", LongType()), *[StructField(n, DoubleType()) for n in names[1:]]])
    done = parts.repartition(1).mapInArrow(end, schema)  # one row for each task of the step before
    return done.select("units", *[f"`{m}_estimate`" for m in metrics], *[f"`{m}_{side}`" for m in metrics for side in ("low", "high")])


def transitions(left: DataFrame, right: DataFrame, covered: str, correct: str, key: str = "decision_id") -> DataFrame:
    both = left.select(key, F.col(covered).alias("lc"), F.col(correct).alias("lk")).join(right.select(key, F.col(covered).alias("rc"), F.col(correct).alias("rk")), key)
    new, lost = F.col("rc") & ~F.col("lc"), F.col("lc") & ~F.col("rc")
    return both.agg(
        F.count_if(new).alias("newly_covered"), F.count_if(lost).alias("lost"), F.count_if(F.col("lc") & F.col("rc")).alias("both"), F.count_if(new & F.col("rk")).alias("newly_covered_correct"),
        (F.count_if("rk") - F.count_if("lk")).alias("net_correct"),
    )


def timing(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    """Count, mean, exact median and 95th percentile, and total of a column."""
    own = durable(rows.select(c.alias("t")))
    return with_quantiles(own.agg(F.count("t").alias("n"), F.avg("t").alias("mean"), F.sum("t").alias("total")), own, [], {"p50": ("t", 0.5), "p95": ("t", 0.95)})


# --- gates -----------------------------------------------------------------------------------


def select_penalty(results: DataFrame) -> DataFrame:
    """Of rows (penalty, nll, accuracy, style) those no worse than the population's (penalty null)
    in NLL and accuracy; the least (style, nll, -penalty) wins."""
    base = results.where("penalty IS NULL").select(F.col("nll").alias("_n"), F.col("accuracy").alias("_a"))
    ok = results.where("penalty IS NOT NULL").join(F.broadcast(base), (F.col("nll") <= F.col("_n")) & (F.col("accuracy") >= F.col("_a")))
    return ok.agg(F.min_by("penalty", F.struct("style", "nll", -F.col("penalty"))).alias("penalty"), F.count("*").alias("eligible"))


def noninferior(metrics: DataFrame, gates: list[Column], improved: list[Column]) -> DataFrame:
    """Candidate if every gate holds and any lower bound is above zero, else baseline."""
    every, any_ = gates[0], improved[0]
    for g in gates[1:]:
        every = every & g
    for g in improved[1:]:
        any_ = any_ | g
    return metrics.withColumn("selected", F.when(F.coalesce(every & any_, F.lit(False)), "candidate").otherwise("baseline"))


def sequential_width(pairs: DataFrame, widths: list[int], *, gain: float = 0.01, cost: float = 10.0) -> DataFrame:
    """From the smallest width, move to a larger one when against the current choice it gains more
    than ``gain`` with a positive lower bound, at ``cost`` milliseconds per point at most.

    ``pairs`` has (low, high, gain, lower, ms) for every pair of widths: a bounded table, folded in order.
    """
    item = F.struct("low", "high", ((F.col("gain") > gain) & (F.col("lower") > 0) & (F.col("ms") <= cost * F.col("gain") * 100)).alias("ok"))
    held = pairs.agg(F.collect_list(item).alias("_p"))
    step = lambda now, k: F.when(F.exists(F.col("_p"), lambda x: (x["low"] == now) & (x["high"] == k) & x["ok"]), k).otherwise(now)
    return held.select(F.aggregate(F.array(*[F.lit(k) for k in widths[1:]]), F.lit(widths[0]), step).alias("width"))
