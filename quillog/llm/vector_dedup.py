"""Near-duplicate vectors by a pivot-permutation index.

Reference points are drawn from the vectors themselves and thinned so that no two are close. Each
vector is described by its nearest reference points in order and entered in their inverted lists.
Vectors that share at least ``min_shared`` of their points are compared by cosine in double
precision; a pair is looked at in the list of its smallest shared point only. Long lists are cut
into blocks and pairs of blocks are compared as matrices, so what leaves a comparison is one row per
vector (its links and the smallest vector connected to it within the blocks), not one per pair.

Equal vectors are compared once: one of them stands for all, with their number as its weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillog.session import durable

from .components import connected


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def thin(points: np.ndarray, most: float) -> np.ndarray:
    """The points, each unless it is closer than ``most`` to one kept before."""
    kept: list[int] = []
    for i in range(len(points)):
        if not kept or (points[kept] @ points[i]).max() < most:
            kept.append(i)
    return points[kept]


def draw_pivots(vectors: DataFrame, rows: int, per_root: float, at_most: int, thin_above: float, seed: int) -> dict[int, np.ndarray]:
    """For each dimension about ``per_root * sqrt(rows)`` pivots, never more than ``at_most`` in all.

    The sample is drawn by hash with one probability for all rows, twice as large as wanted.
    """
    wanted = min(at_most, max(64, int(per_root * rows**0.5)))
    uniform = F.xxhash64(F.lit(seed), "_vec").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    drawn = vectors.where(uniform < 2 * wanted / max(1, rows)).select(F.xxhash64(F.lit(seed + 1), "_vec").alias("_o"), "_vec")
    by_size: dict[int, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: r["_o"]):
        by_size.setdefault(len(r["_vec"]), []).append(r["_vec"])
    return {k: thin(unit(np.array(v, dtype=np.float64)), thin_above)[:wanted] for k, v in by_size.items()}


def describe(pivots, nearest: int):
    """The ordered nearest pivots of each vector; vectors of a size without pivots share list -1."""

    def run(batches):
        for batch in batches:
            out = [None] * len(batch)
            sizes = batch["_vec"].map(len).to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                points = pivots.value.get(int(size))
                if points is None or not len(points):
                    for i in own:
                        out[i] = np.array([-1], dtype=np.int32)
                    continue
                for some in np.array_split(own, max(1, len(own) // 2048)):
                    near = unit(np.array(batch["_vec"].iloc[some].tolist(), dtype=np.float64)) @ points.T
                    k = min(nearest, near.shape[1])
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                    for i, row in zip(some, top, strict=True):
                        out[i] = row.astype(np.int32)
            yield pd.DataFrame({"_rep": batch["_rep"], "_w": batch["_w"], "_vec": batch["_vec"], "_perm": out})

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each row of ``b``."""
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            count += a[:, i, None] == b[None, :, j]
    return count


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest pivot that rows of ``a`` and ``b`` have in common, pairwise."""
    same = a[:, :, None] == b[:, None, :]
    return np.where(same, a[:, :, None], np.iinfo(np.int32).max).min((1, 2))


def compare_blocks(threshold: float, min_shared: int, slab: int = 256):
    """Links between the rows of two blocks of one inverted list (or within one block)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high, size = key
        rows = rows.sort_values("_rep", kind="stable").reset_index(drop=True)
        ids, weight = rows["_rep"].to_numpy(), rows["_w"].to_numpy()
        points = unit(np.array(rows["_vec"].tolist(), dtype=np.float64).reshape(len(rows), size))
        perm = np.array(rows["_perm"].tolist(), dtype=np.int32)
        block = rows["_block"].to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links = np.zeros(len(rows), dtype=np.int64)
        ends: list[np.ndarray] = []
        for at in range(0, len(left), slab):
            some = left[at : at + slab]
            maybe = _shared(perm[some], perm[right]) >= min(min_shared, perm.shape[1])
            if low == high:
                maybe &= right[None, :] > some[:, None]
            if not maybe.any():
                continue
            i, j = np.nonzero(maybe & (points[some] @ points[right].T >= threshold))
            i, j = some[i], right[j]
            for part in np.array_split(np.arange(len(i)), max(1, len(i) // 50_000)):
                a, b = i[part], j[part]
                own = _first_shared(perm[a], perm[b]) == pivot
                a, b = a[own], b[own]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                ends.append(np.stack([a, b]))
        # Rows are in id order, so the least row reachable is the least id. Labels spread along links.
        least = np.arange(len(rows))
        if ends:
            a, b = np.concatenate(ends, axis=1)
            while True:
                new = least.copy()
                np.minimum.at(new, a, least[b])
                np.minimum.at(new, b, least[a])
                new = new[new]
                if (new == least).all():
                    break
                least = new
        linked = np.flatnonzero(links)
        return pd.DataFrame({"_rep": ids[linked], "_links": links[linked], "_least": ids[least[linked]]})

    return run


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    nearest: int = 8,
    min_shared: int = 2,
    pivots_per_root: float = 2.0,
    max_pivots: int = 16_384,
    thin_above: float = 0.6,
    block_rows: int = 1_024,
    seed: int = 1,
) -> DataFrame:
    """(id, n_links, component_id) for every row of ``vectors``.

    ``n_links`` counts other rows at cosine ``threshold`` or more that the index finds;
    ``component_id`` is the smallest id reachable. Vectors that are null, zero or hold a null or
    non-finite component link with nothing, nor do vectors of different lengths with each other.
    Rows that repeat an id count as rows of their own among the links of others; their own links and
    component are those of the id. Rows with a null id are counted in no link and have a null
    component. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    item = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("_id"), item.alias("_vec"))
    rows = rows.withColumn("_ok", F.col("_id").isNotNull() & usable(F.col("_vec")))
    rows = rows.withColumns({"_v1": F.xxhash64("_vec"), "_v2": F.xxhash64(F.lit(11), "_vec")})
    good = rows.where("_ok")
    classes = good.groupBy("_v1", "_v2").agg(F.min("_id").alias("_rep"), F.count("*").alias("_w"), F.first("_vec").alias("_vec"))
    classes = durable(classes)
    n = classes.count()
    pivots = spark.sparkContext.broadcast(draw_pivots(classes, n, pivots_per_root, max_pivots, thin_above, seed))

    described = durable(
        classes.select("_rep", "_w", "_vec").mapInPandas(describe(pivots, nearest), f"_rep {kind}, _w bigint, _vec array<double>, _perm array<int>")
    )
    lists = described.select("_rep", "_w", "_vec", "_perm", F.size("_vec").alias("_size"), F.explode("_perm").alias("_pivot"))
    lengths = lists.groupBy("_pivot", "_size").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
    cut = lists.join(lengths, ["_pivot", "_size"]).withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    # A row goes to every pair of blocks that has its own; with one block that is one group.
    paired = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_pivot", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_size", "_block", "_rep", "_w", "_vec", "_perm"
    )
    found = durable(
        paired.groupBy("_pivot", "_low", "_high", "_size").applyInPandas(compare_blocks(threshold, min_shared), f"_rep {kind}, _links bigint, _least {kind}")
    )
    links = found.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    components = connected(found.where(F.col("_rep") != F.col("_least")).select(F.col("_rep").alias("a"), F.col("_least").alias("b")))
    # Rows with one id but different vectors belong together too; ids rarely repeat, so this is small.
    whole = (
        classes.select("_v1", "_v2", "_rep", "_w")
        .join(links, "_rep", "left")
        .join(components.select(F.col("node").alias("_rep"), "component"), "_rep", "left")
        .select("_v1", "_v2", (F.col("_w") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"), F.coalesce("component", "_rep").alias("_c"))
    )
    keyed = rows.drop("_vec").withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("_v1", "_v2")})
    return keyed.join(whole, ["_v1", "_v2"], "left").select(
        F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("_c", "_id").alias("component_id")
    )
