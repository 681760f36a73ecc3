"""Periodic runs of words by a descending-LCP Kruskal over each text's suffixes.

A run is a maximal stretch of words with smallest period q. Its first position s and s + q have a
longest common prefix (LCP) of exactly its length less q, and no position between them shares that
prefix, else the period would be smaller. So suffix classes are united by decreasing LCP, with
union-find and an ordered set of positions for each class: each such pair becomes adjacent in its
class just when the class reaches that LCP, and every pair that becomes adjacent at a distance within
the LCP is the start of a run if the words before its two positions differ.

A run of at least ``min_length`` words and ``min_exponent`` periods needs an LCP of its length less a
period, hence only suffixes that share at least that with another are united; most texts have none,
which hashes of word windows tell at once.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .names import free_prefix, named
from .piece_codec import slabs

RUN = "struct<start: bigint, length: bigint, period: bigint>"
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but spaces and the five ASCII line and tab characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The shortest LCP of the two first periods of a run that is long enough."""
    return max(1, math.ceil(min_length * (min_exponent - 1) / min_exponent))


def window_repeats(words: list[bytes], size: int) -> bool:
    """Whether some ``size`` words stand twice, as far as hashes tell: never False where they do."""
    n = len(words)
    if n <= size:
        return False
    own = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    whole, done, width = None, 0, 1
    while True:  # windows of 1, 2, 4, ... words, put together as the bits of size say
        if size & width:
            whole = own if whole is None else whole[: len(own) - done] * FACTORS[1] + own[done:]
            done += width
        if done == size:
            break
        own = (own[: len(own) - width] ^ (own[: len(own) - width] >> np.uint64(29))) * FACTORS[0] + own[width:]
        width *= 2
    whole = np.sort(whole)
    return bool((whole[1:] == whole[:-1]).any())


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their suffixes, LCP of each with the next), by prefix doubling."""
    n = len(ids)
    ranks, width = [np.append(np.unique(ids, return_inverse=True)[1], -1)], 1
    while ranks[-1].max() < n - 1:
        last = ranks[-1][:n].astype(np.int64)
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = last[width:] + 1
        ranks.append(np.append(np.unique(last * (n + 1) + after, return_inverse=True)[1], -1))
        width *= 2
    order = np.argsort(ranks[-1][:n])
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for level in reversed(range(len(ranks))):
        step = np.where(ranks[level][a] == ranks[level][b], 1 << level, 0)
        a, b, lcp = a + step, b + step, lcp + step
    return order, lcp


def newly_adjacent(order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, l): positions i < j that become neighbours in a class when classes unite at LCP l.

    The smaller class goes into the larger one, so a position moves a logarithmic number of times.
    """
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(p: int) -> int:
        if p not in parent:
            parent[p], members[p] = p, [p]
        top = p
        while parent[top] != top:
            top = parent[top]
        while parent[p] != top:
            parent[p], p = top, parent[p]
        return top

    for p, q, level in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist(), strict=True):
        large, small = root(p), root(q)
        if len(members[large]) < len(members[small]):
            large, small = small, large
        ours, theirs = members[large], members.pop(small)
        parent[small] = large
        last = -1  # the position of the smaller class before this one
        for k, x in enumerate(theirs):
            at = bisect_left(ours, x)
            if at and ours[at - 1] > last:
                yield ours[at - 1], x, level
            if at < len(ours) and (k + 1 == len(theirs) or theirs[k + 1] > ours[at]):
                yield x, ours[at], level
            last = x
        if len(theirs) * 16 < len(ours):
            for x in theirs:
                insort(ours, x)
        else:
            ours += theirs
            ours.sort()


def runs_of(words: list[bytes], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` words and ``min_exponent`` (2 at
    least) periods, by start, then period."""
    least = least_lcp(min_length, min_exponent)
    if not window_repeats(words, least):
        return []
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    found = []
    for i, j, level in newly_adjacent(*suffixes(ids), least):
        period = j - i
        if period <= level and level + period >= max(min_length, min_exponent * period) and (i == 0 or ids[i - 1] != ids[j - 1]):
            found.append((i, level + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find(docs: DataFrame, *, text_col: str = "text", min_length: int = 24, min_exponent: int = 3, prefix: str = "_", slab: int = 1_000_000) -> DataFrame:
    """Every row of ``docs`` with its words joined by one space in ``text_col``, runs collapsed to their
    first period, and n_words (before) and runs, their names after ``prefix``.

    ``runs`` is an array of (start, length, period) in words, by start, then period; overlapping runs
    are all there. Null and empty texts and texts of white space have no words, no runs and become
    empty. Rows are on their own: repeated rows and null ids are rows like others, an empty table gives
    an empty result, further columns pass unchanged, but those that have a result's name are replaced;
    ``free_prefix`` gives a prefix that meets none. Rows go through in slabs of about ``slab`` characters;
    beside them a task holds some 200 bytes for each word of the longest text with a repeated passage.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    results = [f"{prefix}n_words", f"{prefix}runs"]
    docs = docs.drop(*[c for c in results if c != text_col])
    kept = [c for c in docs.columns if c != text_col]
    own = free_prefix(docs)
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in slabs(texts, slab):
                split = [words_of(t) for t in texts[begin:end]]
                found = [runs_of(w, min_length, min_exponent) for w in split]
                left = [b" ".join(collapsed(w, r)).decode() for w, r in zip(split, found, strict=True)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.array([x for r in found for x in r], dtype=np.int64).reshape(-1, 3)
                cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(runs_type.value_type))
                columns = [pa.array(left, pa.string()), pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), cells, type=runs_type)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(1).slice(begin, end - begin)], ["text", "n", "runs", "rest"])

    rest = F.struct(*map(named, kept)) if kept else F.lit(0)
    rows = docs.select(named(text_col).cast("string").alias("text"), rest.alias("rest"))
    schema = StructType.fromDDL(f"text string, n bigint, runs array<{RUN}>").add(rows.schema["rest"])
    done = rows.mapInArrow(run, schema).toDF(f"{own}text", *results, f"{own}rest")
    return done.select(*[F.col(f"{own}text").alias(c) if c == text_col else F.col(f"{own}rest").getField(c).alias(c) for c in docs.columns], *results)


def strongest(runs: Column) -> Column:
    """The run of greatest length over period, compared exactly; ties by smallest start, then period."""
    more = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(more(x, best), x).otherwise(best))


def repeat_tail(text: Column, begin: Column, period: Column) -> Column:
    """``text`` as words joined by one space, in which each word from number ``begin(n)`` on repeats the
    ``period(n)`` words there; both are functions of the number of words. Texts without words stay."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        a, p = begin(n), period(n)
        return F.when(n > 0, F.array_join(F.transform(ws, lambda w, i: F.when(i >= a, F.get(ws, (a + (i - a) % p).cast("int"))).otherwise(w)), " "))

    return F.coalesce(F.element_at(F.transform(F.array(words), repeated), 1), text)
