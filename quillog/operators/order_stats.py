"""Exact quantiles and ranks of groups of any size, without a group's values in one place.

Quantiles are found by distributed selection: each wanted rank has an interval of values that holds it,
a round counts the values of each open interval in ``buckets`` parts of equal width (combined before
the shuffle), and the interval becomes the least and greatest value seen in the part that the rank falls
into. That ends where both are equal, or where an interval holds ``few`` values, which are then sorted.
Ranks come from a range partition of the values, whose counts
give every partition its offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import durable, written

Wanted = dict[str, tuple[str, float]]


def dimensioned(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Each row once as ``dimension`` 'all' and once by each dimension, its ``value`` as text, null as 'unknown'."""
    kinds = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))]
    kinds += [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions]
    return rows.select("*", F.explode(F.array(*kinds)).alias("_kind")).select(*[c for c in rows.columns if c not in ("dimension", "value")], "_kind.*")


def _wide(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(_g, _v0, _v1, ...): ``_g`` holds the keys, nulls among them, and the others a row's values, null for NaN."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    big = 1.7976931348623157e308  # infinite values count as the greatest finite ones
    own = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.greatest(F.lit(-big), F.least(F.lit(big), F.col(c).cast("double"))))
    return rows.select(group.alias("_g"), *[own(c).alias(f"_v{i}") for i, c in enumerate(metrics)])


def _cells(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(_g, _m, _v): a row for each value there is."""
    cells = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(f"_v{i}").alias("_v")) for i in range(len(metrics))])
    return _wide(rows, keys, metrics).select("_g", F.explode(cells).alias("_c")).select("_g", "_c.*").where("_v IS NOT NULL")


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def quantiles(rows: DataFrame, keys: list[str], wanted: Wanted, *, buckets: int = 1_024, few: int = 4_096, broadcast_rows: int = 100_000, counted: bool = False) -> DataFrame:
    """(keys, names of ``wanted``): for each group with any value the exact quantiles, between ranks
    interpolated linearly. ``wanted`` maps a result's name to (column, probability).

    Nulls and NaN don't count; a column without a value in a group gives null there; null keys are groups;
    an empty table gives an empty result. Values are compared as doubles. ``rows`` is read once a round, so
    what is costly in it should be written before; evenly spread values take a round for each factor of
    ``buckets`` between a group's rows and ``few``, and one to end. A round's shuffle has at most
    ``buckets`` rows for a task and interval. Intervals are broadcast up to ``broadcast_rows``, which are
    counted first; the driver gets two numbers a round.

    With ``counted`` equal values of a group are first made one row with their number, which is written, so
    that rounds don't read ``rows``: for values such as centipawns, of which there are far fewer than rows.
    """
    metrics = list(dict.fromkeys(c for c, _ in wanted.values()))
    cells = _cells(rows, keys, metrics).withColumn("_c", F.lit(1).cast("bigint"))
    whole = _wide(rows, keys, metrics)
    seen = [F.struct(F.lit(i).alias("_m"), F.count(f"_v{i}").alias("_n"), F.min(f"_v{i}").alias("_lo"), F.max(f"_v{i}").alias("_hi")) for i in range(len(metrics))]
    if counted:
        cells = written(cells.groupBy("_g", "_m", "_v").agg(F.sum("_c").alias("_c")))
        ends = durable(cells.groupBy("_g", "_m").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    else:
        ends = durable(whole.groupBy("_g").agg(F.array(*seen).alias("_e")).select("_g", F.explode("_e").alias("_x")).select("_g", "_x.*").where("_n > 0"))
    at = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    mine = [F.when(F.col("_m") == metrics.index(c), F.array(*[F.struct(F.lit(name).alias("_t"), F.lit(k).alias("_side"), r.cast("bigint").alias("_r")) for k, r in enumerate((F.floor(at(p)), F.ceil(at(p))))])) for name, (c, p) in wanted.items()]
    targets = F.flatten(F.filter(F.array(*mine), lambda x: x.isNotNull()))
    held = ["_g", "_m", "_lo", "_hi", "_n", "_t", "_side", "_r"]  # _n: values in the interval, _r: the rank among them
    state = written(ends.select("_g", "_m", "_lo", "_hi", "_n", F.explode(targets).alias("_x")).select("_g", "_m", "_lo", "_hi", "_n", "_x.*"))
    same = ["_g", "_m", "_lo", "_hi"]
    values = F.flatten(F.collect_list(F.array_repeat("_v", F.col("_c").cast("int")))) if counted else F.collect_list("_v")
    while True:
        pending = state.where("_lo < _hi")
        intervals = pending.select(*same, "_n").distinct()
        n, most = intervals.agg(F.count("*"), F.max("_n")).first()
        if n == 0:
            break
        hits = cells.join(_small(intervals, n, broadcast_rows), ["_g", "_m"]).where("_v >= _lo AND _v <= _hi")
        if most <= few:
            listed = hits.groupBy(*same).agg(F.sort_array(values).alias("_l"))
            found = pending.join(listed, same).withColumn("_lo", F.get("_l", F.col("_r").cast("int"))).withColumn("_hi", F.col("_lo"))
        else:
            part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets), F.lit(buckets - 1))
            counted = hits.groupBy(*same, part.alias("_b")).agg(F.sum("_c").alias("_k"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
            upto = F.sum("_k").over(Window.partitionBy(*same).orderBy("_b"))  # over at most ``buckets`` rows
            parts = counted.withColumn("_upto", upto).withColumn("_under", F.col("_upto") - F.col("_k"))
            found = pending.join(parts, same).where("_upto > _r AND _under <= _r")
            found = found.select("_g", "_m", F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), F.col("_k").alias("_n"), "_t", "_side", (F.col("_r") - F.col("_under")).alias("_r"))
        state = written(state.where("_lo = _hi").select(*held).unionByName(found.select(*held)), state)
    state = durable(state)
    pick = lambda name, side: F.max(F.when((F.col("_t") == name) & (F.col("_side") == side), F.col("_lo")))
    sizes = [F.max(F.when(F.col("_m") == i, F.col("_n"))).alias(f"_n{i}") for i in range(len(metrics))]
    lows = state.groupBy("_g").agg(*[pick(name, side).alias(f"_{side}_{name}") for name in wanted for side in (0, 1)])
    both = lows.join(ends.groupBy("_g").agg(*sizes), "_g")
    out = []
    for name, (c, p) in wanted.items():
        place = (F.col(f"_n{metrics.index(c)}") - 1) * F.lit(float(p))
        low, high = F.col(f"_0_{name}"), F.col(f"_1_{name}")
        share = place - F.floor(place)
        out.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    return both.select(*[F.col("_g")[k].alias(k) for k in keys], *out)


def with_quantiles(summary: DataFrame, rows: DataFrame, keys: list[str], wanted: Wanted, **options) -> DataFrame:
    """``summary`` (one row for each of ``keys``) with the quantiles of ``rows``, null where there is no value."""
    own = quantiles(rows, keys, wanted, **options)
    own = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *wanted)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else F.lit(True)
    if not keys:
        return summary.crossJoin(F.broadcast(own)) if own.limit(1).count() else summary.select("*", *[F.lit(None).cast("double").alias(name) for name in wanted])  # one row each
    return summary.join(own, same, "left").drop(*[f"_k_{k}" for k in keys])
