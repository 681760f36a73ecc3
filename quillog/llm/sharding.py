"""Sharding by sampled splitters.

Records are ordered by the hash of their text (so that equal texts lie side by side) and then by
the hash of their id. A size-weighted sample of these keys gives quantile boundaries; records are
dealt into the ranges between them, overfull ranges are subdivided, and the position of a record in
bytes within its range, added to the bytes of all ranges before it, says which shard it belongs to.

Shards are therefore contiguous runs of ranges whose sizes differ by at most about one record, and
the only thing that leaves the executors is one row per range.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import durable

OVERFULL = 2  # times the wanted bytes of a range


def _numbers(values: list[int]) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at(values: list[int], index: Column) -> Column:
    return F.get(_numbers(values), index.cast("int"))


@dataclass(frozen=True)
class Splitters:
    """Sorted lower bounds of all ranges but the first, as (text hash, id hash)."""

    bounds: list[tuple[int, int]]

    def range_of(self, text_hash: Column, id_hash: Column) -> Column:
        """How many bounds are not above the key: a binary search over the constant arrays."""
        if not self.bounds:
            return F.lit(0)
        heads, tails = (_numbers([b[i] for b in self.bounds]) for i in (0, 1))
        steps = [1 << k for k in reversed(range(len(self.bounds).bit_length()))]

        def step(low: Column, width: Column) -> Column:
            at = (low + width - 1).cast("int")
            head, tail = F.get(heads, at), F.get(tails, at)
            fits = (head < text_hash) | ((head == text_hash) & (tail <= id_hash))
            return F.when(fits, low + width).otherwise(low)

        return F.aggregate(_numbers(steps), F.lit(0).cast("bigint"), step)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow rows that sharding moves: ids, sizes and hashes, never texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("_size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64(text).alias("_h"),
        F.xxhash64(F.col(id_col), F.xxhash64(text)).alias("_g"),
        F.monotonically_increasing_id().alias("_d"),  # tells equal rows apart
    )


def sample_splitters(keys: DataFrame, ranges: int, per_range: int, total: int, seed: int = 1) -> Splitters:
    """Boundaries at the quantiles of about ``ranges * per_range`` keys drawn in proportion to size.

    A record of ``_size`` bytes is drawn ``_size * wanted / total`` times on average: its whole part
    always, and the fraction if a hash of key and seed falls below it, so a rerun draws the same
    keys. The driver receives that sample and nothing more, however many tasks there are.
    """
    uniform = (F.xxhash64(F.lit(seed), "_h", "_g").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    draws = F.floor(F.col("_size") * (ranges * per_range / max(1, total)) + uniform).cast("int")
    drawn = keys.select("_h", "_g", draws.alias("_draws")).where(F.col("_draws") > 0)
    sample = sorted(key for h, g, n in drawn.collect() for key in [(h, g)] * n)
    at = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    return Splitters(sorted(set(at)))


def shard_by_size(
    docs: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 32,
    sample_per_range: int = 16,
    range_bytes: int = 8 << 30,
    seed: int = 1,
) -> DataFrame:
    """Shard and slot of every row of ``docs`` under the law ``bytes``.

    Returns ``id_col``, size, text_crc32, law, shard, slot. The number of ranges is
    ``ranges_per_shard`` for each shard, or more where a range would exceed ``range_bytes`` of text, which
    are some 100 MB of the narrow rows that a range holds; these rows are written once and read from there.

    Null text counts as an empty one, null ids are ordinary keys, repeated rows each get a slot of
    their own (which of them gets which is immaterial, as they are equal), an empty table gives an
    empty result, and further columns of ``docs`` are ignored. With fewer rows than shards some
    shards stay empty.
    """
    keys = durable(keyed(docs, id_col, text_col))
    total, rows = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(max(n_shards * ranges_per_shard, -(-total // range_bytes)), rows))
    placed = keys.withColumn("_r", sample_splitters(keys, ranges, sample_per_range, total, seed).range_of(F.col("_h"), F.col("_g")))

    # Overfull ranges are cut into strips by a hash of the key.
    wanted = max(1, total // ranges)
    sums = {r["_r"]: (r["b"], r["n"]) for r in placed.groupBy("_r").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()}
    strips = [-(-sums.get(r, (0, 0))[0] // wanted) if sums.get(r, (0, 0))[0] > OVERFULL * wanted else 1 for r in range(ranges)]
    base = [0, *accumulate(strips)]
    strip = F.pmod(F.xxhash64("_g", "_d", F.lit(seed)), _at(strips, F.col("_r")))
    placed = placed.withColumn("_u", (_at(base, F.col("_r")) + strip).cast("int"))
    units = [(0, 0)] * base[-1]
    for r, both in sums.items():
        units[base[r]] = both
    split = [r for r in range(ranges) if strips[r] > 1]
    if split:
        for r in split:
            units[base[r]] = (0, 0)
        again = placed.where(_at(strips, F.col("_r")) > 1)
        for u in again.groupBy("_u").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect():
            units[u["_u"]] = (u["b"], u["n"])
    byte_start = [0, *accumulate(b for b, _ in units)]
    row_start = [0, *accumulate(n for _, n in units)]

    order = Window.partitionBy("_u").orderBy("_h", "_g", "_id", "_d")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = _at(byte_start, F.col("_u")) + F.sum("_size").over(before) - F.col("_size")

    def sharded(frame: DataFrame) -> DataFrame:
        at = frame.withColumn("_row", _at(row_start, F.col("_u")) + F.row_number().over(order) - 1)
        return at.withColumn("_at", offset).withColumn("_shard", F.least(F.expr(f"(_at * {n_shards}) div {max(1, total)}"), F.lit(n_shards - 1)).cast("int"))

    # A shard begins inside the unit that holds its first byte; only those units are counted again.
    begins = [-(-s * total // n_shards) for s in range(n_shards)]
    inside = [max((u for u in range(len(units)) if byte_start[u] <= b), default=0) for b in begins]
    holds = [0] * len(units)
    for u in inside:
        holds[u] = 1
    counted = sharded(placed.where(_at(holds, F.col("_u")) == 1))
    cut: dict[int, list[tuple[int, int]]] = {}
    for r in counted.groupBy("_u", "_shard").count().collect():
        cut.setdefault(r["_u"], []).append((r["_shard"], r["count"]))
    first = [row_start[u] + sum(n for s, n in cut.get(u, []) if s < k) for k, u in enumerate(inside)]

    return sharded(placed).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_row") - _at(first, F.col("_shard"))).cast("bigint").alias("slot"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as one folder per shard; ids must be unique and not null."""
    where = assigned.select(F.col(id_col), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = docs.join(where, id_col)
    ranged = joined.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    ranged.write.option("maxRecordsPerFile", rows_per_file).partitionBy("_shard").parquet(path)
