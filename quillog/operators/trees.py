"""Tree scorers whose cost doesn't grow with the rows: equal binned rows are one cell with their number.

Trees look at numbers only through their bins, so rows with the same bins, categories, label and weight are
alike. They are counted first, which Spark combines before its shuffle; what is fitted then is the table of
cells, which the bins and categories bound. Boosting takes all rows in every round, so a cell with the summed
weight stands for its rows. A bootstrap gives every row a Poisson count of mean one and a cell of n rows the
sum of theirs, which is Poisson with mean n: so a forest's bags are drawn by cell and tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillog.session import written

BINS = 32


class Bins:
    """Codes of a preprocessing's columns: numbers by at most ``BINS`` ranges of about equally many training rows (each
    value its own where there are no more), categories by their place. The driver gets the limits."""

    def __init__(self, prep, bins: int = BINS):
        self.prep, self.bins = prep, bins
        self.columns = [*[f"{c}_bin" for c in prep.numerics], *[f"{c}_index" for c in prep.categories]]

    def fit(self, train: DataFrame) -> Bins:
        filled = [f"{c}_filled" for c in self.prep.numerics]
        self.limits: list[list[float]] = []
        if filled:
            about = train.agg(*[F.approx_count_distinct(c).alias(c) for c in filled]).first()
            ranges = train.approxQuantile(filled, [k / self.bins for k in range(1, self.bins)], 0.001)
            for c, limits in zip(filled, ranges, strict=True):
                values = sorted(r[0] for r in train.select(c).distinct().limit(self.bins + 1).collect()) if about[c] <= 2 * self.bins else []
                self.limits.append(values[1:] if 0 < len(values) <= self.bins else sorted(set(limits)))
        return self

    def widths(self) -> list[int]:
        """The number of codes of each place of the feature vector."""
        return [*[len(x) + 1 for x in self.limits], *[2 for c in self.prep.categories for _ in range(len(self.prep.levels[c]) + 1)]]

    def transform(self, rows: DataFrame) -> DataFrame:
        for c, limits in zip(self.prep.numerics, self.limits, strict=True):
            rows = Bucketizer(splits=[-np.inf, *limits, np.inf], inputCol=f"{c}_filled", outputCol=f"{c}_bin", handleInvalid="keep").transform(rows)
        return rows.withColumns({c: F.col(c).cast("int") for c in self.columns})

    def cells(self, rows: DataFrame, *by: str) -> DataFrame:
        """(codes, by, n): the distinct codes of binned rows and how many rows have them."""
        return rows.groupBy(*self.columns, *by).agg(F.count("*").alias("n"))

    def vectors(self, cells: DataFrame) -> DataFrame:
        """Cells with their codes as ``features``, categories one-hot."""
        hot = [(F.col(f"{c}_index") == level).cast("double") for c in self.prep.categories for level in range(len(self.prep.levels[c]) + 1)]
        return cells.withColumn("features", array_to_vector(F.array(*[F.col(f"{c}_bin").cast("double") for c in self.prep.numerics], *hot)))

    def matrix(self, columns: list[np.ndarray]) -> np.ndarray:
        """Codes of cells by place of the feature vector."""
        n = len(self.prep.numerics)
        hot = [columns[n + k] == level for k, c in enumerate(self.prep.categories) for level in range(len(self.prep.levels[c]) + 1)]
        return np.stack([*columns[:n], *hot]).astype(np.int16)


def scored(rows: DataFrame, cells: DataFrame, bins: Bins) -> DataFrame:
    """Binned rows with the ``score`` of their cell."""
    return rows.join(cells.select(*bins.columns, "score"), bins.columns).drop(*[c for c in bins.columns if c.endswith("_bin")])


class BinnedBoosted:
    """Spark's boosted trees over cells."""

    def __init__(self, classifier, bins: Bins):
        self.classifier, self.bins = classifier, bins

    def fit(self, train: DataFrame) -> BinnedBoosted:
        by = [self.classifier.getLabelCol(), self.classifier.getWeightCol(), self.classifier.getValidationIndicatorCol()]
        cells = self.bins.cells(self.bins.transform(train), *by).withColumn(by[1], F.col(by[1]) * F.col("n"))
        # Only whole cells are dealt; by a number that the size of the table doesn't lower to one.
        self.model = self.classifier.fit(self.bins.vectors(written(cells.repartition(cells.sparkSession.sparkContext.defaultParallelism))))
        self.featureImportances = self.model.featureImportances
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        own = self.bins.transform(rows)
        cells = self.model.transform(self.bins.vectors(self.bins.cells(own)))
        return scored(own, cells.withColumn("score", vector_to_array("probability")[1]), self.bins)


@dataclass
class Grown:
    """Trees in heap order from node 1: the feature and last code of the left side (-1: a leaf), and each node's counts of both labels."""

    feature: np.ndarray
    cut: np.ndarray
    counts: np.ndarray

    def leaves(self, tree: int, codes: np.ndarray, depth: int) -> np.ndarray:
        at, row = np.ones(codes.shape[1], dtype=np.int32), np.arange(codes.shape[1])
        for _ in range(depth):
            f = self.feature[tree][at]
            at = np.where(f >= 0, 2 * at + (codes[f, row] > self.cut[tree][at]), at)
        return at


def _impurity(w: np.ndarray) -> np.ndarray:
    """Gini impurity times the weight."""
    total = w.sum(axis=1)
    return total - (w * w).sum(axis=1) / np.where(total > 0, total, 1.0)


def best_splits(hist: np.ndarray, widths: np.ndarray, weights: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """For each node the best of its drawn features' splits. ``hist`` counts both labels by node, drawn feature and code;
    ``widths`` are the codes of each node's drawn features."""
    sizes = widths.ravel()
    begin = np.cumsum(sizes) - sizes
    run = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(hist, axis=0)])
    left = run[1:] - np.repeat(run[begin], sizes, axis=0)
    whole = run[begin + sizes] - run[begin]
    right = np.repeat(whole, sizes, axis=0) - left
    gain = np.repeat(_impurity(whole * weights), sizes) - _impurity(left * weights) - _impurity(right * weights)
    gain[(left.sum(axis=1) < least) | (right.sum(axis=1) < least)] = -1.0
    per = widths.sum(axis=1)
    start = np.cumsum(per) - per
    best = np.array([s + int(np.argmax(gain[s : s + p])) for s, p in zip(start.tolist(), per.tolist(), strict=True)], dtype=np.int64)
    drawn = np.searchsorted(begin, best, side="right") - 1
    return {"drawn": drawn % widths.shape[1], "cut": best - begin[drawn], "gain": gain[best], "left": left[best], "right": right[best]}


class BinnedForest:
    """A random forest over cells with the parameters of Spark's classifier.

    A pass grows all trees by a level: tasks count their cells' bags by node, drawn feature and code and hand on
    one row for each tree; these are added up by tree, whose best splits return to the driver. What a task, and
    what the driver, holds is bounded by trees, nodes and codes, not by cells. Bags are drawn afresh in each pass
    by seed, part and tree. Labels are 0 and 1, and a label's rows have one weight.
    """

    def __init__(self, classifier: RandomForestClassifier, bins: Bins, cells_a_part: int = 8_192):
        self.classifier, self.bins, self.cells_a_part = classifier, bins, cells_a_part
        if classifier.getFeatureSubsetStrategy() != "sqrt" or classifier.getImpurity() != "gini":
            raise ValueError("only sqrt features and gini impurity")

    def _packed(self, train: DataFrame) -> tuple[DataFrame, np.ndarray]:
        c = self.classifier
        cells = written(self.bins.cells(self.bins.transform(train), c.getLabelCol(), c.getWeightCol()).withColumnsRenamed({c.getLabelCol(): "label", c.getWeightCol(): "weight"}))
        weights = np.ones(2)
        for r in cells.groupBy("label").agg(F.min("weight").alias("low"), F.max("weight").alias("high")).collect():
            if r.low != r.high:
                raise ValueError("a label's rows have several weights")
            weights[int(r.label)] = r.low
        parts = max(1, -(-cells.count() // self.cells_a_part))
        fields = [*self.bins.columns, F.col("label").cast("int").alias("label"), "n"]
        dealt = cells.select(F.pmod(F.xxhash64(*self.bins.columns, "label"), F.lit(parts)).alias("part"), F.struct(*fields).alias("cell")).repartition(parts, "part")
        return written(dealt.groupBy("part").agg(F.sort_array(F.collect_list("cell")).alias("cells"))), weights

    def fit(self, train: DataFrame) -> BinnedForest:
        c, bins = self.classifier, self.bins
        trees, depth, least, seed = c.getNumTrees(), c.getMaxDepth(), c.getMinInstancesPerNode(), c.getSeed() % (1 << 32)
        packed, weights = self._packed(train)
        widths = np.array(bins.widths())
        picked = int(np.ceil(np.sqrt(len(widths))))
        nodes = 2 ** (depth + 1)
        grown = Grown(np.full((trees, nodes), -1, dtype=np.int16), np.zeros((trees, nodes), dtype=np.int16), np.zeros((trees, nodes, 2), dtype=np.int64))
        active = {t: np.array([1]) for t in range(trees)}
        earned = np.zeros((trees, len(widths)))
        for level in range(depth):
            if not active:
                break
            drawn = {t: np.argsort(np.random.default_rng([seed, level, t]).random((len(a), len(widths))), axis=1)[:, :picked] for t, a in active.items()}
            found = self._splits(packed, grown, active, drawn, widths, weights, level, seed, least)
            now, active = active, {}
            for r in found:
                t, at = r.tree, now[r.tree]
                left, right, gain = np.array(r.left).reshape(-1, 2), np.array(r.right).reshape(-1, 2), np.array(r.gain)
                if level == 0:
                    grown.counts[t, 1] = left[0] + right[0]
                ok = gain > 0
                at, left, right, gain, cut, pick = at[ok], left[ok], right[ok], gain[ok], np.array(r.cut)[ok], np.array(r.drawn)[ok]
                feature = drawn[t][ok, pick]
                grown.feature[t, at], grown.cut[t, at] = feature, cut
                grown.counts[t, 2 * at], grown.counts[t, 2 * at + 1] = left, right
                np.add.at(earned[t], feature, gain)
                below, counts = np.concatenate([2 * at, 2 * at + 1]), np.concatenate([left, right])
                below = np.sort(below[(counts.sum(axis=1) >= 2 * least) & (counts > 0).all(axis=1)])
                if len(below):
                    active[t] = below
        self.grown, self.weights, self.depth = grown, weights, depth
        total = earned.sum(axis=1, keepdims=True)
        share = (earned / np.where(total > 0, total, 1.0)).sum(axis=0)
        self.featureImportances = DenseVector(share / share.sum() if share.sum() > 0 else share)
        return self

    def _splits(self, packed, grown, active, drawn, widths, weights, level, seed, least) -> list:
        bins = self.bins

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(len(batch)):
                    cells = batch.column(1).slice(i, 1).flatten()
                    own = {cells.type.field(k).name: cells.field(k).to_numpy(zero_copy_only=False) for k in range(cells.type.num_fields)}
                    codes, part = bins.matrix([own[name] for name in bins.columns]), batch.column(0)[i].as_py()
                    for t, at in active.items():
                        slot = np.full(grown.feature.shape[1], -1, dtype=np.int32)
                        slot[at] = np.arange(len(at))
                        bag = np.random.default_rng([seed, 1 << 20, part, t]).poisson(own["n"])
                        row = np.flatnonzero(bag)
                        here = codes[:, row]
                        place = slot[grown.leaves(t, here, level)]
                        inside = place >= 0
                        row, place, here = row[inside], place[inside], here[:, inside]
                        sizes = widths[drawn[t]]
                        begin = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
                        counted, label, n = np.zeros(2 * int(sizes.sum())), own["label"][row], bag[row]
                        for j in range(sizes.shape[1]):
                            key = 2 * (begin[place, j] + here[drawn[t][place, j], np.arange(len(row))]) + label
                            counted += np.bincount(key, n, minlength=len(counted))
                        sums[t] = counted + sums[t] if t in sums else counted
            for t, counted in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([counted.astype(np.int64).tobytes()], pa.binary())], ["tree", "hist"])

        def choose(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            hist = sum(np.frombuffer(x, dtype=np.int64) for x in parts["hist"])
            best = best_splits(hist.reshape(-1, 2), widths[drawn[key[0]]], weights, least)
            return pd.DataFrame([{"tree": key[0], **{k: v.ravel().tolist() for k, v in best.items()}}])

        per_tree = packed.mapInArrow(count, "tree int, hist binary").repartition(min(len(active), packed.sparkSession.sparkContext.defaultParallelism), "tree")
        return per_tree.groupBy("tree").applyInPandas(choose, "tree int, drawn array<int>, cut array<int>, gain array<double>, left array<bigint>, right array<bigint>").collect()

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score``, the mean over trees of the share of label 1 in the leaf's weights."""
        grown, weights, depth, bins = self.grown, self.weights, self.depth, self.bins
        mass = grown.counts * weights
        share = (mass[:, :, 1] / np.where(mass.sum(axis=2) > 0, mass.sum(axis=2), 1.0)).astype(np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = bins.matrix([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                score = sum(share[t][grown.leaves(t, codes, depth)] for t in range(len(share))) / len(share)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*bins.columns, "score"])

        own = bins.transform(rows)
        cells = bins.cells(own).select(*bins.columns).repartition(rows.sparkSession.sparkContext.defaultParallelism)
        return scored(own, cells.mapInArrow(run, ", ".join(f"{c} int" for c in bins.columns) + ", score double"), bins)
