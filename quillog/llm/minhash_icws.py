"""Near-duplicate documents by improved consistent weighted sampling.

Shingles are five consecutive words, weighted by TF-IDF. Each document is sampled by ICWS: two
documents agree in one sample with a probability equal to their weighted Jaccard similarity. Samples
are banded; the members of a bucket are first compared with one centre, another in each band, which
joins groups of copies without looking at their pairs. Buckets that still hold several components are
gone through block by block: longer sketches of their members are compared as matrices, and those
that have a partner in another component whose sketch allows the threshold come back with their
texts into the same pair of blocks, where such pairs are compared. What leaves a pair of blocks are
the links that join components, fewer than its rows. A comparison computes the weighted Jaccard
similarity exactly from the whole texts.

Inside a task the work is arithmetic on numpy arrays; Spark partitions, shuffles and joins it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillog.session import durable

from .components import connected

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BASE = U(0x100000001B3)
BASE_INV = U(pow(0x100000001B3, -1, 1 << 64))
DOC_BITS = 12
CHUNK_BYTES = 1 << 20
CACHED = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([U(1)], np.full(n - 1, U(base)))))


@cache
def _word_bytes() -> np.ndarray:
    """ASCII letters and digits and all bytes of other characters belong to words."""
    return np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


@dataclass
class Shingles:
    """Distinct shingles of some documents, document after document, each in ascending order."""

    doc: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    starts: np.ndarray  # of the documents that have any
    owners: np.ndarray


def shingles(texts: list[str], width: int) -> Shingles:
    """A text of fewer than ``width`` words (but at least one) has a single shingle of all its words."""
    data = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    size = len(raw)
    top = 1 << max(20, (size - 1).bit_length())
    inside = _word_bytes()[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(size + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * _powers(top, int(BASE))[:size], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _powers(top, int(BASE_INV))[begin] + (end - begin).astype(U))
    bounds = np.cumsum([len(d) + 1 for d in data])
    doc = np.searchsorted(bounds, begin, side="right")
    n = len(words)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Shingles(none, none.astype(U), none, none, none)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    at = np.arange(n) - first[doc]
    code = np.zeros(n, dtype=U)
    for k in range(width):
        take = at + k < count[doc]
        code[take] = code[take] * ODD + words[np.flatnonzero(take) + k]
    whole = (at + width <= count[doc]) | (at == 0)
    doc, code = doc[whole], mix(code[whole])
    key = np.sort((doc.astype(U) << U(64 - DOC_BITS)) | (code >> U(DOC_BITS)))
    fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(fresh, len(key)))
    key = key[fresh]
    doc = (key >> U(64 - DOC_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return Shingles(doc, key & U((1 << (64 - DOC_BITS)) - 1), tf, starts, doc[starts])


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``CHUNK_BYTES``, with the place of the first."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (held + len(t) > CHUNK_BYTES or i - begin == (1 << DOC_BITS) - 1):
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


@dataclass
class Weights:
    """TF-IDF of shingles: ``1 + log(tf)`` times an idf factor.

    The factor is ``1 + strength * log(n / df) / log(1 / share)`` for a shingle in ``df`` of ``n``
    documents and never more than ``1 + strength``, which it reaches at ``df = share * n``. So only
    shingles in more documents than that need a count of their own: ``code`` (ascending) and ``df``.
    """

    code: np.ndarray
    df: np.ndarray
    documents: int
    strength: float
    share: float

    def of(self, found: Shingles) -> np.ndarray:
        idf = np.ones(len(found.code))
        if len(self.code):
            at = np.minimum(np.searchsorted(self.code, found.code), len(self.code) - 1)
            own = np.flatnonzero(self.code[at] == found.code)
            idf[own] = np.clip(np.log(self.documents / self.df[at[own]]) / np.log(1 / self.share), 0, 1)
        return (1 + np.log(found.tf)) * (1 + self.strength * idf)


def locally_frequent(share: float, shingle_words: int, most_docs: int = 2_000, most_codes: int = 4_000_000):
    """Shingles in at least half of ``share`` of the documents of a run of rows, with their number of
    documents there, and a row of the null code with the number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        docs = 0

        def told() -> pd.DataFrame:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= share / 2 * docs
            codes = pd.array([None, *code[often].view(np.int64).tolist()], dtype="Int64")
            return pd.DataFrame({"_code": codes, "_n": [docs, *n[often].tolist()]})

        for batch in batches:
            for _, texts in chunks(batch["_text"].tolist()):
                held.append(shingles(texts, shingle_words).code)
                docs += len(texts)
                if docs >= most_docs or sum(map(len, held)) >= most_codes:
                    yield told()
                    held, docs = [], 0
        if docs:
            yield told()

    return run


def count_codes(wanted, shingle_words: int):
    """How many documents of the task hold each of the ``wanted`` shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = wanted.value
        total = np.zeros(len(codes), dtype=np.int64)
        for batch in batches:
            for _, texts in chunks(batch["_text"].tolist()):
                found = shingles(texts, shingle_words).code
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                total += np.bincount(at[codes[at] == found], minlength=len(codes))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"_at": some, "_n": total[some]})

    return run


def fit_weights(full: DataFrame, strength: float, share: float, shingle_words: int) -> Weights:
    """Weights by exact document frequencies over all rows of ``full`` (_text).

    A shingle in ``share`` of all documents is in half that share of some runs of rows, and these runs
    know it in at least half that share of all documents; what fewer know is left. Of the rest, at
    most ``2 / share`` times the shingles of a mean document, all documents are counted.
    """
    context = full.sparkSession.sparkContext
    heard = durable(full.select("_text").mapInPandas(locally_frequent(share, shingle_words), "_code bigint, _n bigint").groupBy("_code").agg(F.sum("_n").alias("_n")))
    documents = heard.where("_code IS NULL").agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    codes = heard.where(F.col("_code").isNotNull() & (F.col("_n") >= share / 2 * documents)).select("_code").toArrow()["_code"].to_numpy().view(np.uint64)
    codes, df = np.sort(codes), np.zeros(len(codes))
    if len(codes):
        counted = full.select("_text").mapInPandas(count_codes(context.broadcast(codes), shingle_words), "_at bigint, _n bigint")
        counted = counted.groupBy("_at").agg(F.sum("_n").alias("_n")).toArrow()
        df[counted["_at"].to_numpy()] = counted["_n"].to_numpy()
    often = df > share * documents
    return Weights(codes[often], df[often], max(1, documents), strength, share)


@cache
def _gamma2() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of the Gamma(2, 1) distribution and their logarithms."""
    x = np.concatenate(([0.0], np.geomspace(1e-6, 40, 1 << 18)))
    q = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - np.exp(-x) * (1 + x), x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


def icws(found: Shingles, weights: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """(documents with shingles) x samples: hashes of the sampled (shingle, t)."""
    gamma, log_gamma = _gamma2()
    logs = np.log(weights).astype(np.float32)
    low, half = U(0xFFFF), np.float32(1 / (1 << 32))
    sizes = np.diff(np.append(found.starts, len(found.code)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty((len(sizes), samples), dtype=U)
    x, y = np.empty_like(found.code), np.empty_like(found.code)
    for j in range(samples):
        np.bitwise_xor(found.code, mix(np.array([seed * 1_000_003 + j + 1], dtype=U)), out=x)
        x *= U(0xD6E8FEB86659FD93)
        x ^= np.right_shift(x, U(32), out=y)
        x *= U(0x9FB21C651E98DF25)
        x ^= np.right_shift(x, U(28), out=y)
        r = gamma.take(np.bitwise_and(x, low, out=y).view(np.int64))
        beta = np.right_shift(x, U(32), out=y).astype(np.float32)
        beta *= half
        t = logs / r
        t += beta
        np.floor(t, out=t)
        np.right_shift(x, U(16), out=y)
        cost = log_gamma.take(np.bitwise_and(y, low, out=y).view(np.int64))
        beta -= t
        beta -= np.float32(1)
        beta *= r
        cost += beta
        hit = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, found.starts), sizes))
        if len(hit) > len(sizes):
            whose = owner[hit]
            hit = hit[np.concatenate(([True], whose[1:] != whose[:-1]))]
        out[:, j] = mix(found.code[hit] + t[hit].astype(np.int64).astype(U) * ODD)
    return out


SIGNED = "_id {id}, _c1 bigint, _c2 bigint, _size int, _bands array<bigint>"


def sign(weights, shingle_words: int, bands: int, rows: int, seed: int):
    """Class key (two hashes of the shingles with their counts), number of shingles and band hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, all_texts = batch["_id"], batch["_text"].tolist()
            for begin, texts in chunks(all_texts):
                found = shingles(texts, shingle_words)
                own = ids.iloc[begin : begin + len(texts)].iloc[found.owners]
                if not len(own):
                    continue
                drawn = icws(found, weights.value.of(found), bands * rows, seed).reshape(len(own), bands, rows)
                band = np.zeros((len(own), bands), dtype=U)
                for k in range(rows):
                    band = mix(band * ODD + drawn[:, :, k])
                tagged = found.code + found.tf.astype(U) * ODD
                keys = [np.add.reduceat(mix(tagged + U(s)), found.starts).view(np.int64) for s in (1, 2)]
                size = np.diff(np.append(found.starts, len(found.code)))
                yield pd.DataFrame({"_id": own.to_numpy(), "_c1": keys[0], "_c2": keys[1], "_size": size, "_bands": list(band.view(np.int64))})

    return run


def sketches(weights, shingle_words: int, coarse: int, samples: int, seed: int):
    """Sixteen bits of each of the first ``coarse`` samples per text, which are those of the bands, and
    eight bits of each of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["_id"]
            for begin, texts in chunks(batch["_text"].tolist()):
                found = shingles(texts, shingle_words)
                own = ids.iloc[begin : begin + len(texts)].iloc[found.owners]
                if len(own):
                    drawn = icws(found, weights.value.of(found), samples, seed)
                    first, rest = drawn[:, :coarse].astype(np.uint16), drawn[:, coarse:].astype(np.uint8)
                    yield pd.DataFrame({"_rep": own.to_numpy(), "_sketch": [a.tobytes() + b.tobytes() for a, b in zip(first, rest, strict=True)]})

    return run


@dataclass(frozen=True)
class Blocks:
    """How the members of two blocks of a bucket (or of one) are compared."""

    threshold: float
    bands: int
    per_band: int
    samples: int
    deviations: float
    slab: int = 256

    def least(self, n: int) -> float:
        return n * self.threshold - self.deviations * (n * self.threshold * (1 - self.threshold)) ** 0.5

    def likely(self, key: tuple, rows: pd.DataFrame, seen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows from different components, unless their sketches fall short of the threshold by
        ``deviations`` standard deviations. A pair that shares several buckets is looked at in that of
        its first band only. Pairs of two rows that are both ``seen`` by then are left out."""
        band, low, high, coarse = key[0], key[2], key[3], self.bands * self.per_band
        raw = np.frombuffer(b"".join(rows["_sketch"]), dtype=np.uint8).reshape(len(rows), 2 * coarse + self.samples - coarse)
        fine = raw[:, 2 * coarse :]
        held = np.ascontiguousarray(raw[:, : 2 * coarse]).view(np.uint16)
        comp, block = pd.factorize(rows["_comp"])[0], rows["_block"].to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        across = np.ascontiguousarray(held[right].T)
        middle = min(192, fine.shape[1])
        for at in range(0, len(left), self.slab):
            some = left[at : at + self.slab]
            apart = comp[some][:, None] != comp[right][None, :]
            if low == high:
                apart &= right[None, :] > some[:, None]
            if not apart.any():
                continue
            same, equal = np.zeros(apart.shape, dtype=np.uint8), np.empty(apart.shape, dtype=bool)
            down = np.ascontiguousarray(held[some].T)
            for k in range(coarse):
                np.equal(down[k][:, None], across[k][None, :], out=equal)
                same += equal.view(np.uint8)
            i, j = np.nonzero(apart & (same >= self.least(coarse)))
            for part in np.array_split(np.arange(len(i)), max(1, len(i) // 10_000)):
                a, b = some[i[part]], right[j[part]]
                n = same[i[part], j[part]].astype(np.int64)
                if seen is not None:
                    fresh = ~(seen[a] & seen[b])
                    a, b, n = a[fresh], b[fresh], n[fresh]
                n += (fine[a, :middle] == fine[b, :middle]).sum(1)
                near = n >= self.least(coarse + middle)
                a, b, n = a[near], b[near], n[near]
                n += (fine[a, middle:] == fine[b, middle:]).sum(1)
                near = n >= self.least(self.samples)
                a, b = a[near], b[near]
                first = (held[a] == held[b]).reshape(-1, self.bands, self.per_band).all(2).argmax(1) == band
                if first.any():
                    yield a[first], b[first]

    def having_partners(self):
        """The rows that are in a likely pair."""

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates("_rep", ignore_index=True)
            found = np.zeros(len(rows), dtype=bool)
            for a, b in self.likely(key, rows, found):
                found[a] = found[b] = True
            return rows[found]

        return run

    def joining(self, weights, shingle_words: int):
        """Links (a, b) at the threshold, as many as join all components that have any."""

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates("_rep", ignore_index=True)
            ids, own = rows["_rep"].to_numpy(), read_all(rows["_text"].tolist(), weights.value, shingle_words)
            root = pd.factorize(rows["_comp"])[0]
            out: list[tuple[int, int]] = []
            for a, b in self.likely(key, rows):
                for i in np.unique(a):
                    others = b[a == i]
                    others = others[root[others] != root[i]]
                    for j in others[similarities(own[i], [own[j] for j in others]) >= self.threshold]:
                        if root[i] != root[j]:
                            root[root == root[j]] = root[i]
                            out.append((i, j))
            at = np.array(out, dtype=np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

        return run


def read_all(texts: list[str], weights: Weights, shingle_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles (ascending) and their weights of each text."""
    none = np.zeros(0, dtype=U), np.zeros(0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, some in chunks(texts):
        found = shingles(some, shingle_words)
        weight = weights.of(found)
        own = [none] * len(some)
        for k, a, b in zip(found.owners, found.starts, [*found.starts[1:], len(found.code)], strict=True):
            own[k] = found.code[a:b], weight[a:b]
        out += own
    return out


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of one text with others; all have shingles."""
    if not others:
        return np.zeros(0)
    codes, weights = (np.concatenate([x[k] for x in others]) for k in (0, 1))
    starts = np.cumsum([0, *(len(x[0]) for x in others[:-1])])
    at = np.minimum(np.searchsorted(one[0], codes), len(one[0]) - 1)
    shared = np.add.reduceat(np.where(one[0][at] == codes, np.minimum(one[1][at], weights), 0.0), starts)
    return shared / (one[1].sum() + np.add.reduceat(weights, starts) - shared)


def verify(weights, shingle_words: int, threshold: float):
    known: dict = {}
    held = 0

    def read(key, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of a text; those read last are kept, up to ``CACHED`` shingles."""
        nonlocal held
        found = known.get(key)
        if found is None:
            found = read_all([text], weights.value, shingle_words)[0]
            if held + len(found[0]) > CACHED:
                known.clear()
                held = 0
            known[key] = found
            held += len(found[0])
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["a"], batch["b"], batch["_ta"], batch["_tb"], strict=True)
            yield batch.loc[[bool(similarities(read(a, ta), [read(b, tb)])[0] >= threshold) for a, b, ta, tb in rows], ["a", "b"]]

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
    bands: int = 16,
    rows: int = 4,
    idf_strength: float = 1.0,
    idf_share: float = 0.01,
    sketch: int = 512,
    deviations: float = 3.5,
    block_rows: int = 1_024,
    block_shingles: int = 2_000_000,
    broadcast_ids: int = 2_000_000,
    seed: int = 1,
) -> DataFrame:
    """(id, class_id, group_id): one row per non-null id of ``docs``.

    ``class_id`` is the smallest id with the same shingles as often, ``group_id`` the smallest id of
    the connected group. Words are runs of ASCII letters and digits and other characters, lower-cased.
    Texts without a word (null and empty ones too) are groups of their own. Rows that repeat an id are
    one document: of its texts any that has words counts. Rows with a null id are left out. Other
    columns are ignored. An empty table gives an empty result.

    The similarity is that of TF-IDF weights, whose idf factor lies between 1 (a shingle in all
    documents) and 1 + ``idf_strength`` (in ``idf_share`` of them or fewer). For copies in less than that
    share it is the plain similarity of shingles with repeats damped; where a group of copies makes up
    most of the table, a pair meets 0.8 for certain from a plain similarity of 0.89.

    Two documents of similarity s share a band with probability ``1 - (1 - s ** rows) ** bands``
    (0.9998 for 0.8 at the defaults). A pair across components is passed over only if its sketches
    lie ``deviations`` standard deviations below the threshold, with a probability under 0.0003.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL")
    full = texts.where("_text IS NOT NULL")

    weights = spark.sparkContext.broadcast(fit_weights(full, idf_strength, idf_share, shingle_words))
    signed = durable(full.mapInPandas(sign(weights, shingle_words, bands, rows, seed), SIGNED.format(id=kind)))
    # Texts of one class have equal band hashes, so a class is made by partial aggregation alone.
    classes = durable(signed.groupBy("_c1", "_c2").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"), F.first("_size").alias("_size")))
    # Written before it is grouped, so that a class with very many members can be split in the join.
    owned = durable(signed.select("_id", "_c1", "_c2").join(classes.select("_c1", "_c2", "_rep"), ["_c1", "_c2"]).select("_id", "_rep"))
    members = owned.groupBy("_id").agg(F.min("_rep").alias("_rep"))

    spread = classes.select("_rep", "_size", F.posexplode("_bands").alias("_band", "_hash"))
    shared = spread.groupBy("_band", "_hash").agg(F.min("_rep").alias("_lo"), F.max("_rep").alias("_hi")).where("_lo <> _hi")
    buckets = durable(spread.join(shared.select("_band", "_hash"), ["_band", "_hash"]))

    def compare(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that meet the threshold."""
        pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        needed = durable(pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct())
        if needed.count() <= broadcast_ids:
            needed = F.broadcast(needed)
        held = full.join(needed, "_id", "left_semi")
        joined = pairs.join(held.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")
        joined = joined.join(held.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a")
        return durable(joined.mapInPandas(verify(weights, shingle_words, threshold), f"a {kind}, b {kind}"))

    # First every member with one centre of each bucket: another in each band, so that a document
    # some edits away from one centre is likely to meet a nearer one.
    order = F.xxhash64("_rep", "_band")
    first = buckets.groupBy("_band", "_hash").agg(F.min_by("_rep", order).alias("a"))
    links = compare(buckets.join(first, ["_band", "_hash"]).select("a", F.col("_rep").alias("b")))
    components = connected(links)
    placed = buckets.join(components.select(F.col("node").alias("_rep"), "component"), "_rep", "left").withColumn("_comp", F.coalesce("component", "_rep")).drop("component")
    mixed = placed.groupBy("_band", "_hash").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"), F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo <> _hi")
    mixed = mixed.select("_band", "_hash", F.ceil(F.greatest(F.col("_n") / block_rows, F.col("_sum") / block_shingles)).cast("int").alias("_blocks"))
    open_ = durable(placed.join(mixed, ["_band", "_hash"]))
    some = full.join(open_.select(F.col("_rep").alias("_id")).distinct(), "_id", "left_semi")
    fine = durable(some.mapInPandas(sketches(weights, shingle_words, bands * rows, sketch, seed), f"_rep {kind}, _sketch binary"))
    own = open_.join(fine, "_rep").withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    paired = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_band", "_hash", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "_rep", "_comp", "_sketch"
    )
    blocks = Blocks(threshold, bands, rows, sketch, deviations)
    keys = ["_band", "_hash", "_low", "_high"]
    # Groups take long for their bytes, so they are dealt by their rows rather than by what AQE would merge.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), open_.count() // 4_096)
    paired = paired.repartition(parts, *keys)
    likely = durable(paired.groupBy(*keys).applyInPandas(blocks.having_partners(), paired.schema))
    texts_of = full.join(likely.select(F.col("_rep").alias("_id")).distinct(), "_id", "left_semi").select(F.col("_id").alias("_rep"), "_text")
    joins = likely.join(texts_of, "_rep").groupBy(*keys).applyInPandas(blocks.joining(weights, shingle_words), f"a {kind}, b {kind}")
    components = connected(durable(links.union(joins)))

    grouped = members.join(components.select(F.col("node").alias("_rep"), "component"), "_rep", "left")
    ids = texts.select("_id").distinct()
    out = ids.join(grouped, "_id", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("_rep", "_id").alias("class_id"),
        F.coalesce("component", "_rep", "_id").alias("group_id"),
    )
