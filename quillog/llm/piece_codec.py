"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges run from an agenda, best piece first and leftmost among equals. A popped merge is skipped
with the dropout rate, drawn afresh in every occurrence of a unit by a hash of seed, row key and
position, so one seed always gives one segmentation and other seeds give others. A space starts a
unit and nothing but spaces joins units, so each unit is segmented by itself.

What is drawn is the number of merges up to the next skip, which is geometric. An occurrence whose first
skip lies beyond its unit's merges has the plain segmentation, which is kept by unit. All others are
segmented anew, side by side: their symbols and the ranks of neighbouring symbols are rows of two
matrices, and each step pops the best candidate of every row, to merge or to skip it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MASK = (1 << 64) - 1
NEVER = 1 << 40
NEVER_RANK = (1 << 31) - 1
SHORT = 48  # units up to this many characters are segmented side by side


def spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after another."""
    total = int(sizes.sum())
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]


def geometric(draws: np.ndarray, scale: float) -> np.ndarray:
    """How many merges come before the next skip."""
    u = (_mixed(draws) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(np.log1p(-u) * scale, float(NEVER)).astype(np.int64)


class Pieces:
    """The vocabulary of a byte-fallback BPE model: merges by rank, bytes and surface forms."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {score: k for k, score in enumerate(scores)}
        self.rank = {model.id_to_piece(i): order[model.get_score(i)] for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.surface = [b""] * n
        for piece, i in self.ids.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.of_rank = np.full(len(scores), -1, dtype=np.int32)  # -1 where several pieces have one rank
        shared = Counter(self.rank.values())
        for piece, k in self.rank.items():
            self.of_rank[k] = self.ids[piece] if shared[k] == 1 else -1
        self.point = np.full(0x110000, -1, dtype=np.int32)  # piece of each single character
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.point[ord(piece)] = i
        self.point[ord(" ")] = self.ids.get(SPACE, -1)
        both = {self.ids[p[:k]] * n + self.ids[p[k:]]: (r, self.ids[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self._fill(both, n)
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback, so decoding could lose characters")
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", piece) for piece in self.ids):
            raise ValueError("pieces run over the ends of units")
        if any(re.search(r"[^\W_²][\W_²]", piece) for piece in self.ids):
            raise ValueError("a piece goes on after a word")

    def _fill(self, pairs: dict[int, tuple[int, int]], n: int) -> None:
        """A hash table, with open addressing, from pairs that merge to the rank and id of what they make."""
        self.n, self.bits = n, (len(pairs) * 4).bit_length()
        size = (1 << self.bits) + 64
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks, self.made = np.full(size, NEVER_RANK, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.probes = 1
        slots = self._slot(np.array(list(pairs), dtype=np.int64)).tolist()
        for key, at, (rank, made) in zip(pairs, slots, pairs.values(), strict=True):
            tries = 1
            while self.keys[at] != -1:
                at, tries = at + 1, tries + 1
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made
            self.probes = max(self.probes, tries)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the table has each pair of symbols; the last slot, which is never filled, for pairs
        that make no piece and for missing symbols (negative)."""
        keys = left.astype(np.int64) * self.n + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        at[there != keys] = len(self.keys) - 1
        slot = self._slot(keys[open_])
        for k in range(1, self.probes):
            if not len(open_):
                break
            there = self.keys[slot + k]
            hit = there == keys[open_]
            at[open_[hit]] = slot[hit] + k
            left_over = ~hit & (there != -1)
            open_, slot = open_[left_over], slot[left_over]
        return at

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each two symbols make, NEVER_RANK where they make none."""
        return self.ranks[self.pair_slots(left, right)]

    def segment_many(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, draws: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of many units, unit after unit, with the number of ids and of popped merges of each.

        A unit is ``sizes`` symbols of ``points`` from ``starts``, each a piece. ``first`` is its first
        skipped pop (NEVER for none); ``draws`` and ``scale`` give the ones after that.
        """
        counts, pops = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        edges = [0, 3, 5, 7, 9, 12, 16, 24, SHORT]
        for low, high in itertools.pairwise(edges):
            every = np.flatnonzero((sizes > low) & (sizes <= high))
            for own in np.array_split(every, max(1, -(-len(every) * high // 200_000))) if len(every) else []:
                at = np.arange(high)[None, :]
                symbols = np.where(at < sizes[own, None], points[np.minimum(starts[own, None] + at, len(points) - 1)], -1)
                ranks = np.full((len(own), high), NEVER_RANK, dtype=np.int32)
                ranks[:, :-1] = self.pair_ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(own), high - 1)
                done.extend(self._merge(own, symbols.astype(np.int32), ranks, first[own], draws[own], scale, pops))
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *(s[s >= 0] for _, s in done)])
        order = np.concatenate([np.zeros(0, dtype=np.int64), *(own for own, _ in done)])
        sizes_of = np.concatenate([np.zeros(0, dtype=np.int64), *((s >= 0).sum(1) for _, s in done)])
        counts[order] = sizes_of
        where = np.zeros(len(starts), dtype=np.int64)
        where[order] = np.cumsum(sizes_of) - sizes_of
        return spans(ids, where, counts), counts, pops

    def _merge(self, own, symbols, ranks, skip, draws, scale, pops) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        popped = 0
        skip, draws = skip.copy(), draws.copy()
        columns = np.arange(symbols.shape[1])[None, :]
        while len(own):
            best = ranks.argmin(1)
            row = np.arange(len(own))
            rank = ranks[row, best]
            live = rank != NEVER_RANK
            if not live.all():
                pops[own[~live]] = popped
                yield own[~live], symbols[~live]
                own, symbols, ranks, skip, draws, best, rank = (x[live] for x in (own, symbols, ranks, skip, draws, best, rank))
                row = np.arange(len(own))
                if not len(own):
                    return
            over = np.flatnonzero(skip == popped)
            ranks[over, best[over]] = NEVER_RANK
            draws[over] += np.uint64(0x9E3779B97F4A7C15)
            skip[over] += 1 + geometric(draws[over], scale)
            merging = np.ones(len(own), dtype=bool)
            merging[over] = False
            row, at, new = row[merging], best[merging], self.of_rank[rank[merging]]
            several = np.flatnonzero(new < 0)
            if len(several):
                pair = row[several], at[several]
                new[several] = self.made[self.pair_slots(symbols[pair], symbols[pair[0], pair[1] + 1])]
            from_ = np.minimum(columns + (columns > at[:, None]), symbols.shape[1] - 1)
            moved = np.take_along_axis(symbols[row], from_, 1)
            moved[:, -1] = -1
            each = np.arange(len(row))
            moved[each, at] = new
            from_ = np.minimum(columns + (columns >= at[:, None]), symbols.shape[1] - 1)
            ranked = np.take_along_axis(ranks[row], from_, 1)
            ranked[:, -1] = NEVER_RANK
            right = np.where(at + 1 < symbols.shape[1], moved[each, np.minimum(at + 1, symbols.shape[1] - 1)], -1)
            ranked[each, at] = self.pair_ranks(new, right)
            has = np.flatnonzero(at > 0)
            ranked[has, at[has] - 1] = self.pair_ranks(moved[has, at[has] - 1], new[has])
            symbols[row], ranks[row] = moved, ranked
            popped += 1

    def segment(self, unit: str, skips: Iterable[int] = ()) -> tuple[list[int], int]:
        """Piece ids of one unit, and how many merges were popped. ``skips`` are the numbers (from 0,
        ascending) of the pops to skip; without any it is the plain BPE segmentation."""
        symbols = list(unit)
        n = len(symbols)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, agenda = self.rank, []
        coming, pops = iter(skips), 0
        skip = next(coming, NEVER)

        def offer(left: int, right: int) -> None:
            known = rank.get(symbols[left] + symbols[right])
            if known is not None:
                heapq.heappush(agenda, (known, left, right, len(symbols[left]), len(symbols[right])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, a, b = heapq.heappop(agenda)
            if len(symbols[left]) != a or len(symbols[right]) != b or follow[left] != right:
                continue
            pops += 1
            if pops > skip:
                skip = next(coming, NEVER)
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            follow[left] = follow[right]
            if follow[left] < n:
                before[follow[left]] = left
                offer(left, follow[left])
            if before[left] >= 0:
                offer(before[left], left)
        return self._numbers(s for s in symbols if s), pops

    def _numbers(self, symbols) -> list[int]:
        out: list[int] = []
        for s in symbols:
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            else:
                out.extend([self.bytes[b] for b in s.encode()])
        return out


def _mixed(x):
    """A 64-bit number, or an array of them, spread over all bits."""
    if isinstance(x, int):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        return x ^ x >> 31
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


#: A unit is the spaces before it, marks, and then letters and digits, after which no piece goes on;
#: line breaks and the space mark itself stand alone.
UNITS = re.compile(rf" *(?:[^\w \n{SPACE}]|[_²])*[^\W_²]+| *(?:[^\w \n{SPACE}]|[_²])+| +|\n|{SPACE}")


class Encoder:
    """Plain segmentations of units, of which about ``held`` are kept, and texts by them."""

    def __init__(self, path: str, dropout: float, seed: int, held: int = 300_000):
        self.table, self.dropout, self.seed, self.held = pieces(path), dropout, seed, held
        self.scale = 0.0 if dropout <= 0 else 1 / math.log1p(-dropout) if dropout < 1 else -0.0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        # Of each known unit: symbols and plain ids as runs of two arrays, and its merges. A unit that
        # can't be segmented side by side has no symbols.
        self.points, self.ids = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.starts, self.sizes, self.at, self.counts, self.pops = (np.zeros(0, dtype=np.int64) for _ in range(5))

    def _one(self, unit: str, skips: Iterable[int] = ()) -> tuple[list[int], int]:
        if unit == SPACE:
            return [self.table.bytes[b] for b in SPACE.encode()], 0
        return self.table.segment(unit.replace(" ", SPACE), skips)

    def _learn(self, units: list[str]) -> None:
        """Adds the plain segmentations of units that aren't known."""
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        points = self.table.point[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.cumsum(sizes) - sizes
        simple = (sizes <= SHORT) & (np.minimum.reduceat(points, starts) >= 0)
        some, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        never, zero = np.full(len(some), NEVER, dtype=np.int64), np.zeros(len(some), dtype=np.uint64)
        ids, counts_of, pops_of = self.table.segment_many(points, starts[some], sizes[some], never, zero, 0.0)
        counts, pops, at = (np.zeros(len(units), dtype=np.int64) for _ in range(3))
        counts[some], pops[some] = counts_of, pops_of
        at[some] = np.cumsum(counts_of) - counts_of
        more: list[int] = []
        for i in rest.tolist():
            found, pops[i] = self._one(units[i])
            at[i], counts[i] = len(ids) + len(more), len(found)
            more += found
        before = len(self.ids)
        self.ids = np.concatenate([self.ids, ids, np.array(more, dtype=np.int32)])
        self.starts = np.concatenate([self.starts, starts + len(self.points)])
        self.sizes = np.concatenate([self.sizes, np.where(simple, sizes, 0)])
        self.points = np.concatenate([self.points, points])
        self.at, self.counts, self.pops = (np.concatenate(x) for x in ((self.at, at + before), (self.counts, counts), (self.pops, pops)))
        self.known.update(zip(units, range(len(self.names), len(self.names) + len(units)), strict=True))
        self.names += units

    def _skips(self, first: int, draw: int) -> Iterator[int]:
        """The numbers of the skipped pops of one occurrence, without end."""
        skip, draws = first, np.array([draw], dtype=np.uint64)
        while True:
            yield skip
            draws += np.uint64(0x9E3779B97F4A7C15)
            skip += 1 + int(geometric(draws, self.scale)[0])

    def encode_all(self, texts: list[str], row_keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text. Equal text and key give equal ids, whatever stands beside them."""
        if len(self.names) > self.held:
            self._forget()
        split = [UNITS.findall(" " + t) if t else [] for t in texts]
        units = [u for own in split for u in own]
        lengths = np.array([len(own) for own in split], dtype=np.int64)
        if not units:
            return [np.zeros(0, dtype=np.int32)] * len(texts)
        fresh = list(dict.fromkeys([u for u in units if u not in self.known]))
        if fresh:
            self._learn(fresh)
        unit = np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units))
        if self.dropout <= 0:
            ids, counts = spans(self.ids, self.at[unit], self.counts[unit]), self.counts[unit]
        else:
            base = np.array([xxhash.xxh64_intdigest((k & MASK).to_bytes(8, "little"), seed=self.seed & MASK) for k in row_keys], dtype=np.uint64)
            place = np.arange(len(units)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            draws = _mixed(place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.repeat(base, lengths))
            first = geometric(draws, self.scale)
            dropped = first < self.pops[unit]
            many = np.flatnonzero(dropped & (self.sizes[unit] > 0))
            own = unit[many]
            ids, new_counts, _ = self.table.segment_many(self.points, self.starts[own], self.sizes[own], first[many], draws[many], self.scale)
            counts, at = self.counts[unit], self.at[unit]
            counts[many], at[many] = new_counts, len(self.ids) + np.cumsum(new_counts) - new_counts
            more: list[int] = []
            for i in np.flatnonzero(dropped & (self.sizes[unit] == 0)).tolist():
                found, _ = self._one(units[i], self._skips(int(first[i]), int(draws[i])))
                counts[i], at[i] = len(found), len(self.ids) + len(ids) + len(more)
                more += found
            ids = spans(np.concatenate([self.ids, ids, np.array(more, dtype=np.int32)]), at, counts)
        ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum(lengths)]
        return np.split(ids, ends[:-1])

    def encode(self, text: str, row_key: int) -> np.ndarray:
        return self.encode_all([text], [row_key])[0]

    def decode(self, ids) -> str:
        whole = b"".join([self.table.surface[i] for i in ids])
        return whole[1:].decode() if whole else ""


@cache
def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    return Encoder(path, dropout, seed)


def slabs(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``most`` characters, at least one text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t or "") > most:
            yield begin, i
            begin, held = i, 0
        held += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def encode(text: Column, row_key: Column, *, model: str = MODEL, dropout: float = 0.1, seed: int = 1) -> Column:
    """Piece ids of ``text``. ``row_key`` (a bigint, such as a hash of the id) keys the dropout.

    Null gives null, an empty text no ids. Any other text, however long and whatever its characters,
    decodes to itself; what the vocabulary lacks becomes bytes. Equal text and key give equal ids.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = _encoder(model, dropout, seed)
        for texts, keys in batches:
            rows = [t if isinstance(t, str) else None for t in texts]
            out: list = []
            for a, b in slabs(rows):
                coded = own.encode_all([t or "" for t in rows[a:b]], keys.iloc[a:b].tolist())
                out += [None if t is None else c for t, c in zip(rows[a:b], coded, strict=True)]
            yield pd.Series(out, dtype=object)

    return run(text, F.coalesce(row_key.cast("bigint"), F.lit(0)))


def encode_table(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = 0.1, seed: int = 1, slab: int = 1_000_000
) -> DataFrame:
    """(id, n_pieces, piece_ids, decoded_sha256, lossless) of every row: encoded, decoded and compared.

    Both directions run in one pass. Rows go through in slabs of about ``slab`` characters, so what
    a task holds beside Spark's own batch is bounded by the longest text. Null texts give nulls and
    are lossless; null ids and repeated rows are rows like others. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(model, dropout, seed)
        for batch in batches:
            keys, all_texts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for begin, end in slabs(all_texts, slab):
                part, texts = batch.slice(begin, end - begin), all_texts[begin:end]
                coded = [None if t is None else c for t, c in zip(texts, own.encode_all([t or "" for t in texts], keys[begin:end]), strict=True)]
                sizes = [None if c is None else len(c) for c in coded]
                decoded = [None if c is None else own.decode(c.tolist()) for c in coded]
                gone = np.array([c is None for c in coded])
                ends = np.cumsum([0, *(n or 0 for n in sizes)], dtype=np.int32)
                values = np.concatenate([np.zeros(0, dtype=np.int32), *(c for c in coded if c is not None)])
                ids = pa.ListArray.from_arrays(ends, values, mask=pa.array(gone))
                digests = [None if d is None else hashlib.sha256(d.encode()).hexdigest() for d in decoded]
                same = [d == t for d, t in zip(decoded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), ids, pa.array(digests, pa.string()), pa.array(same)], ["_id", "n", "ids", "sha", "same"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col).alias("_key"))
    coded = rows.mapInArrow(run, f"_id {kind}, n int, ids array<int>, sha string, same boolean")
    return coded.toDF(id_col, "n_pieces", "piece_ids", "decoded_sha256", "lossless")


def decode(ids: Column, *, model: str = MODEL) -> Column:
    """The text of piece ids; null gives null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _encoder(model, 0.0, 0)
        for some in batches:
            yield pd.Series([None if x is None else own.decode(x.tolist()) for x in some], dtype=object)

    return run(ids)
