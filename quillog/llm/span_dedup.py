"""Removal of word windows that a document with a smaller id has, by a compacted de Bruijn graph.

The edges of the graph are the ``window``-grams of words. A document is a walk over them, and is first
compacted by itself into paths: runs of successive edges whose least ``anchor``-gram (by hash, the
leftmost of ties) stands at the same place. What is least depends on an edge's words alone, so an edge that
stands in two documents lies in paths of the same anchor, and only anchors of several documents are
kept. Paths that are walked whole by several documents are nonbranching and compact by one join on
anchor and digest: for all but the first document every edge of it is repeated. Where paths of one
anchor differ the graph branches, and there the first document's walk of each path is opened into
its edges, which are joined one by one.

Each edge and path carries its source coordinates, the smallest document with its place. They chain
repeated edges into long spans, and a document's words are removed only where their digest, taken anew
from the text, is that of the words at the source. So a shuffle carries about 7 rows for 100 words,
and edges only at branches; a passage in very many documents is one path to all but its ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillog.session import discard, durable, written

from .lookup import beside
from .names import free_prefix, named
from .periodic_runs import words_of
from .piece_codec import slabs

WINDOW, ANCHOR = 50, 19
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * FACTORS[2]
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` successive words, equal on all machines for equal words."""
    own = _spread(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(1))
    whole, done, width = None, 0, 1
    while True:  # grams of 1, 2, 4, ... words, put together as the bits of size say
        if size & width:
            whole = own if whole is None else whole[: len(own) - done] * FACTORS[0] + own[done:]
            done += width
        if done == size:
            return _spread(whole)
        own = _spread(own[: len(own) - width]) * FACTORS[1] + own[width:]
        width *= 2


def leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """For each ``size`` successive values the place of the least, the leftmost of ties."""
    at, least, width = np.arange(len(values)), values, 1
    while width < size:
        step = min(width, size - width)
        first = least[: len(least) - step] <= least[step:]
        at = np.where(first, at[: len(at) - step], at[step:])
        least = np.where(first, least[: len(least) - step], least[step:])
        width += step
    return at


def paths(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first edge, edges, anchor) of the paths that a text walks; an edge is the number of its first word."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = gram_hashes(words, anchor)
    at = leftmost_least(grams, window - anchor + 1)
    starts = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    return starts, np.diff(np.append(starts, len(at))), grams[at[starts]]


class Digests:
    """Digests of stretches of a text's words, joined by one space."""

    def __init__(self, words: list[bytes]):
        self.whole = memoryview(b" ".join(words) + b" ")
        self.at = np.cumsum([0, *(len(w) + 1 for w in words)])

    def __call__(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.minimum(starts + lengths, len(self.at) - 1)
        bounds = zip(self.at[np.minimum(starts, ends)].tolist(), self.at[ends].tolist(), strict=True)
        return np.array([xxhash.xxh3_64_intdigest(self.whole[a:b]) for a, b in bounds], dtype=np.uint64).view(np.int64)


def _cat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *arrays])


def path_rows(docs: DataFrame, window: int, anchor: int, slab: int) -> DataFrame:
    """(anchor, digest, id, start, edges) of the paths of every text of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slabs(texts, slab):
                sizes, parts = [], []
                for text in texts[begin:end]:
                    words = words_of(text)
                    starts, edges, anchors = paths(words, window, anchor)
                    sizes.append(len(starts))
                    if len(starts):
                        parts.append((anchors.view(np.int64), Digests(words)(starts, edges + window - 1), starts, edges))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(begin, end), sizes)))
                anchors, digests, starts, edges = (pa.array(_cat([p[k] for p in parts])) for k in range(4))
                yield pa.RecordBatch.from_arrays([anchors, digests, ids, starts, edges], ["anchor", "digest", "id", "start", "edges"])

    longs = [StructField(c, LongType()) for c in ("anchor", "digest", "start", "edges")]
    return docs.mapInArrow(run, StructType([*longs[:2], docs.schema["id"], *longs[2:]]))


def edge_rows(docs: DataFrame, window: int, slab: int) -> DataFrame:
    """(anchor, digest, id, start) of the edges of the paths that ``want`` of ``docs`` (id, text, want) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(1).to_pylist(), batch.column(2)
            for begin, end in slabs(texts, slab):
                sizes, parts = [], []
                for k in range(begin, end):
                    anchors, starts, edges = (c.to_numpy(zero_copy_only=False) for c in wanted.slice(k, 1).flatten().flatten())
                    digests = Digests(words_of(texts[k]))
                    at = np.repeat(starts - np.cumsum(edges) + edges, edges) + np.arange(edges.sum())
                    sizes.append(len(at))
                    parts.append((np.repeat(anchors, edges), digests(at, np.full(len(at), window)), at))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(begin, end), sizes)))
                anchors, digests, starts = (pa.array(_cat([p[k] for p in parts])) for k in range(3))
                yield pa.RecordBatch.from_arrays([anchors, digests, ids, starts], ["anchor", "digest", "id", "start"])

    longs = [StructField(c, LongType()) for c in ("anchor", "digest", "start")]
    return docs.mapInArrow(run, StructType([*longs[:2], docs.schema["id"], longs[2]]))


def repeated_parts(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, slab: int = 1_000_000, **options) -> DataFrame:
    """(id, start, edges, digest, source, source_start): stretches of successive edges of ``docs`` (id,
    text) that a smaller id has, with the smallest id's coordinates and the digest of their words.

    Rows with a null id are left out.
    """
    walks = written(path_rows(docs.where("id IS NOT NULL"), window, anchor, slab))
    shared = durable(walks.groupBy("anchor").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("anchor"))
    known = written(beside(walks, shared, ["anchor"], **options))
    discard(walks)

    here = F.struct(F.col("id").alias("source"), F.col("start").alias("source_start"))
    whole = durable(known.groupBy("anchor", "digest").agg(F.min(here).alias("_at"), F.max("id").alias("_last")).select("anchor", "digest", "_at.*", "_last"))
    copies = beside(known, whole.where("source < _last").drop("_last"), ["anchor", "digest"], **options).where("id > source")
    parts = copies.select("id", "start", "edges", "digest", "source", "source_start")

    branching = whole.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor")
    opened = durable(whole.join(branching, "anchor", "left_semi").select("anchor", "digest", F.col("source").alias("id")))
    first = beside(known, opened, ["anchor", "digest", "id"], "left_semi", **options)
    wanted = durable(first.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "edges")).alias("want")))
    edges = written(edge_rows(beside(docs, wanted, ["id"], size=64 + 40 * F.size("want"), **options).select("id", "text", "want"), window, slab))
    seen = edges.groupBy("anchor", "digest").agg(F.min(here).alias("_at"), F.max("id").alias("_last")).where("_at.source < _last")
    seen = durable(seen.select("anchor", "digest", "_at.*"))
    again = beside(edges, seen, ["anchor", "digest"], **options).where("id > source")
    return parts.unionByName(again.select("id", "start", F.lit(1).cast("bigint").alias("edges"), "digest", "source", "source_start"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, prefix: str = "_", slab: int = 1_000_000, **options) -> DataFrame:
    """Every row of ``docs`` with its remaining words joined by one space in ``text_col``, and n_words
    (before), n_removed and spans, their names after ``prefix``.

    A word goes if a window of ``window`` words that covers it also starts in a row of a smaller id;
    windows are judged on the input. ``spans`` lists (start, length, source, source_start) in words: a span
    follows one source as long as it goes on there, so spans may overlap. Null and empty texts have no
    words; texts shorter than a window stay whole; rows of one id never cost each other a word; rows with a
    null id neither count nor lose words. An empty table gives an empty result. Further columns pass
    unchanged, but those that have a result's name are replaced; ``free_prefix`` gives a prefix that meets none.
    """
    if not 0 < anchor < window:
        raise ValueError("an anchor is shorter than a window")
    results = [f"{prefix}{c}" for c in ("n_words", "n_removed", "spans")]
    docs = docs.drop(*[c for c in results if c not in (id_col, text_col)])
    parts = repeated_parts(docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")), window=window, anchor=anchor, slab=slab, **options)
    marks = parts.groupBy("id").agg(F.collect_list(F.struct("start", "edges", "digest", "source", "source_start")).alias("parts"))
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), (F.struct(*map(named, rest)) if rest else F.lit(0)).alias("rest")).join(marks, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = batch.column(1).to_pylist(), batch.column(3)
            marked, kind = listed.is_valid().to_pylist(), listed.type.value_type.field("source").type
            for begin, end in slabs(texts, slab):
                left, counts, gone, sizes, spans, sources = [], [], [], [], [], []
                for k in range(begin, end):
                    words = words_of(texts[k])
                    counts.append(len(words))
                    if not marked[k]:
                        left.append(b" ".join(words).decode())
                        gone.append(0)
                        sizes.append(0)
                        continue
                    own = listed.slice(k, 1).flatten()
                    starts, edges, digests, _, source_starts = (c if i == 3 else c.to_numpy(zero_copy_only=False) for i, c in enumerate(own.flatten()))
                    ids = own.field("source")
                    same = Digests(words)(starts, edges + window - 1) == digests
                    order = np.flatnonzero(same)
                    order = order[np.argsort(starts[order], kind="stable")]
                    ends = starts + edges + window - 1
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, starts[order], 1)
                    np.add.at(change, ends[order], -1)
                    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    left.append(b" ".join([words[i] for i in keep.tolist()]).decode())
                    gone.append(len(words) - len(keep))
                    found = chained(order, starts, edges, ids.to_pylist(), source_starts, window)
                    sizes.append(len(found))
                    spans += [(s, n, at) for s, n, at, _ in found]
                    sources.append(ids.take(pa.array([i for *_, i in found], pa.int64())))
                flat = np.array(spans, dtype=np.int64).reshape(-1, 3)
                source = pa.concat_arrays([pa.array([], kind), *sources])
                cells = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), source, pa.array(flat[:, 2])], ["start", "length", "source", "source_start"])
                ends = pa.array(np.cumsum([0, *sizes], dtype=np.int32))
                part = batch.slice(begin, end - begin)
                columns = [part.column(0), pa.array(left, pa.string()), part.column(2), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.ListArray.from_arrays(ends, cells)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "rest", "n_words", "n_removed", "spans"])

    cell = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("source", docs.schema[id_col].dataType), StructField("source_start", LongType())])
    schema = StructType([rows.schema["id"], rows.schema["text"], rows.schema["rest"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(cell))])
    own = free_prefix(docs)
    done = rows.select("id", "text", "rest", "parts").mapInArrow(run, schema).toDF(f"{own}id", f"{own}text", f"{own}rest", *results)
    at = {id_col: F.col(f"{own}id"), text_col: F.col(f"{own}text")}
    return done.select(*[at.get(c, F.col(f"{own}rest").getField(c) if c in rest else None).alias(c) for c in docs.columns], *results)


def chained(order: np.ndarray, starts: np.ndarray, edges: np.ndarray, sources: list, source_starts: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, source start, number of a part) of the spans that parts in ``order`` of their start
    make up: successive edges at successive places of one source."""
    open_spans: dict[tuple, list[int]] = {}
    out = []
    for i in order.tolist():
        start, n, at = int(starts[i]), int(edges[i]), int(source_starts[i])
        span = open_spans.get((sources[i], start - at))
        if span and start <= span[0] + span[1]:
            span[1] = max(span[1], start + n - span[0])
        else:
            span = open_spans[sources[i], start - at] = [start, n, at, i]
            out.append(span)
    return [(s, n + window - 1, at, i) for s, n, at, i in out]
