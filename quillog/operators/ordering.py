"""Positions, running totals, ranks and ordered searches over tables of any size.

Rows are range-partitioned by their order; each range sums its own rows, and the sums of the ranges before
it are its offset. Only one number for each range goes through the driver. Searches in an order use a
tree of blocks, each an array of the least values below it, so that every step is a join on a block.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import durable, written

FANOUT = 256


def running(rows: DataFrame, order: list[str | Column], size: str | Column, name: str = "upto", *, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``size`` over all rows up to and with this one in ``order``.

    The order must tell rows apart; equal keys would share a range, so count them first. An empty table
    gives an empty result; null sizes count as zero; nulls sort as Spark sorts them.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_size", F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0))).repartitionByRange(n, *order)
    dealt = durable(dealt.withColumn("_range", F.spark_partition_id()))
    totals = sorted(dealt.groupBy("_range").agg(F.sum("_size")).collect())
    before = [0, *accumulate(t for _, t in totals)][:-1]
    kind = dict(dealt.groupBy().agg(F.sum("_size").alias("s")).dtypes)["s"]
    offsets = rows.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(totals, before, strict=True)], f"_range int, _before {kind}")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("_within", F.sum("_size").over(own)).join(F.broadcast(offsets), "_range")  # a row for each range
    return summed.withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_size", "_within", "_before")


def segmented(rows: DataFrame, keys: list[str], order: list[str | Column], counts: dict[str, Column], *, bucket: str = "_bucket", inclusive: bool = False, descending: bool = False) -> DataFrame:
    """``rows`` with running sums of ``counts`` over the earlier rows of their ``keys`` in ``order`` (this one too, if ``inclusive``).

    A scan on two levels: sums by keys and bucket, whose running totals are the buckets' offsets, and
    windows within a bucket, so a key with most of the rows is spread over as many tasks as it has buckets.
    ``bucket`` is a column that rises with the order (falls, if ``descending``), such as the day. Rows
    that are dealt by keys and bucket before aren't dealt again. Null keys are keys; null counts add nothing.
    """
    own = rows.withColumns({f"_c_{n}": F.coalesce(c, F.lit(0)) for n, c in counts.items()})
    by = F.desc(bucket) if descending else F.asc(bucket)
    parts = own.groupBy(*keys, bucket).agg(*[F.sum(f"_c_{n}").alias(f"_s_{n}") for n in counts])
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])], *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in counts])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])]
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = own.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_c_{n}").over(within), F.lit(0)) for n in counts})
    met = local.join(offsets, reduce(lambda a, b: a & b, same), "left")
    return met.withColumns({n: F.col(f"_o_{n}") + F.col(f"_c_{n}") for n in counts}).drop(*[f"_{x}_{n}" for x in "oc" for n in counts], *[f"_k{i}" for i in range(len(keys) + 1)])


def segmented_all(rows: DataFrame, sets: list[tuple[list[str], dict[str, Column]]], order: list[str | Column], *, bucket: str = "_bucket") -> DataFrame:
    """``segmented`` for several sets of keys and counts at once, whose names must differ.

    ``rows`` is read twice, whatever the number of sets: for the sums by all keys and bucket, which are
    written, and for the windows. Rows that are dealt by some of the keys that all sets have, and the
    bucket, aren't dealt again, as the offsets are written too: while they are small Spark broadcasts them.
    """
    counts = {n: c for _, own in sets for n, c in own.items()}
    own = rows.withColumns({f"_c_{n}": F.coalesce(c, F.lit(0)) for n, c in counts.items()})
    every = list(dict.fromkeys([*(k for keys, _ in sets for k in keys), bucket]))
    fine = written(own.groupBy(*every).agg(*[F.sum(f"_c_{n}").alias(f"_s_{n}") for n in counts]))
    out = own
    for keys, mine in sets:
        within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_c_{n}").over(within), F.lit(0)) for n in mine})
    for keys, mine in sets:
        parts = fine.groupBy(*keys, bucket).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in mine])
        earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
        held = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])]
        offsets = written(parts.select(*held, *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in mine]))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])]
        out = out.join(offsets, reduce(lambda a, b: a & b, same), "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    return out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_c_{n}") for n in counts}).drop(*[f"_{x}_{n}" for x in "oc" for n in counts])


def positions(rows: DataFrame, order: list[str | Column], name: str = "position", **options) -> DataFrame:
    """``rows`` numbered from 0 in ``order``, which must tell them apart."""
    return running(rows, order, F.lit(1).cast("bigint"), name, **options).withColumn(name, F.col(name) - 1)


def average_ranks(rows: DataFrame, values: dict[str, str], *, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``rows`` with a rank from 1 for each of ``values`` (column to name), ties sharing their mean.

    Equal values are counted before they are ordered, so a frequent one is one row; nulls have null ranks.
    """
    for column, name in values.items():
        counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
        ranks = durable(running(counts, ["_value"], "_n", "_upto", **options).select("_value", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)))
        ranks = F.broadcast(ranks) if ranks.count() <= broadcast_rows else ranks
        rows = rows.join(ranks, F.col(column) == F.col("_value"), "left").drop("_value")
    return rows


def next_cyclic(names: DataFrame, key: str, name: str = "other", **options) -> DataFrame:
    """Each of the distinct ``key`` with the next one in order, the last with the first; one alone has itself."""
    placed = durable(positions(names.select(key).distinct(), [key], "_at", **options))
    n = placed.count()
    after = placed.select(F.col(key).alias(name), F.pmod(F.col("_at") - 1, F.lit(max(1, n))).alias("_at"))
    return placed.join(after, "_at").select(key, name)


class LeastTree:
    """Blocks of a table's ``value`` by position: level 0 has the values of ``fanout`` rows in an array,
    each further level the least values of as many blocks below, up to one block."""

    def __init__(self, placed: DataFrame, value: str, *, fanout: int = FANOUT, broadcast_rows: int = 2_000):
        self.fanout, self.broadcast_rows = fanout, broadcast_rows
        self.levels: list[DataFrame] = []
        below = placed.select("position", F.col(value).alias("_least"))
        while True:
            slots = F.array_sort(F.collect_list(F.struct((F.col("position") % fanout).cast("int").alias("slot"), F.col("_least").alias("least"))))
            level = durable(below.groupBy(F.floor(F.col("position") / fanout).alias("block")).agg(slots.alias("slots")))
            n = level.count()
            self.levels.append(F.broadcast(level) if n <= broadcast_rows else level)
            if n <= 1:
                return
            below = level.select(F.col("block").alias("position"), F.array_min(F.transform("slots", lambda s: s["least"])).alias("_least"))

    def _first(self, limit: Column, after: Column) -> Column:
        """The first slot beyond ``after`` with a value below ``limit``, or null."""
        return F.get(F.filter("slots", lambda s: (s["slot"] > after) & (s["least"] < limit)), F.lit(0))["slot"]

    def first_below(self, rows: DataFrame, limit: str, after: str, name: str) -> DataFrame:
        """``rows`` with ``name``, the first position greater than ``after`` whose value is below ``limit``, or null.

        A row climbs until a block has such a value right of it, then goes down to it: two joins a level.
        """
        out = rows.withColumns({"_node": F.col(after), "_found": F.lit(None).cast("bigint"), "_depth": F.lit(None).cast("int")})
        for depth, level in enumerate(self.levels):
            block = F.floor(F.greatest(F.col("_node"), F.lit(0)) / self.fanout)
            met = out.withColumn("block", F.when(F.col("_found").isNull(), block)).join(level, "block", "left")
            hit = self._first(F.col(limit), F.when(F.col("_node") < 0, F.lit(-1)).otherwise(F.col("_node") % self.fanout))
            met = met.withColumn("_hit", F.when(F.col("_found").isNull(), hit))
            out = met.withColumns({
                "_found": F.coalesce("_found", F.col("block") * self.fanout + F.col("_hit")),
                "_depth": F.coalesce("_depth", F.when(F.col("_hit").isNotNull(), F.lit(depth))),
                "_node": block,
            }).drop("block", "slots", "_hit")
        for depth in reversed(range(len(self.levels) - 1)):
            down = F.when(F.col("_depth") > depth, F.col("_found"))
            met = out.withColumn("block", down).join(self.levels[depth], "block", "left")
            hit = self._first(F.col(limit), F.lit(-1))
            out = met.withColumn("_found", F.when(F.col("block").isNotNull(), F.col("block") * self.fanout + hit).otherwise(F.col("_found"))).drop("block", "slots")
        return out.withColumn(name, F.col("_found")).drop("_node", "_found", "_depth")


def next_below(rows: DataFrame, key: str, limit: str, value: str, name: str = "other", *, fanout: int = FANOUT, **options) -> DataFrame:
    """Each of the unique ``key`` with the next other key, in cyclic order, whose ``value`` is below this row's ``limit``.

    Null where there is none; a null limit finds nothing and a null value isn't found; an empty table gives an empty result.
    """
    placed = durable(positions(rows.select(key, limit, value), [key], **options))
    if placed.limit(1).count() == 0:
        return placed.select(key, F.col(key).alias(name))
    tree = LeastTree(placed.where(F.col(value).isNotNull()), value, fanout=fanout) if placed.where(F.col(value).isNotNull()).limit(1).count() else None
    if tree is None:
        return placed.select(key, F.lit(None).cast(placed.schema[key].dataType).alias(name))
    ahead = tree.first_below(placed.select(key, limit, "position"), limit, "position", "_next")
    top = F.least("position", F.lit(-1))  # before the first
    wrapped = tree.first_below(ahead.where("_next IS NULL").drop("_next").withColumn("_start", top), limit, "_start", "_next").drop("_start")
    found = ahead.where("_next IS NOT NULL").unionByName(wrapped.where(F.col("_next") != F.col("position")))
    named = placed.select(F.col("position").alias("_next"), F.col(key).alias(name))
    hits = found.select(key, "_next").join(named, "_next").select(key, name)
    return placed.select(key).join(hits, key, "left")
