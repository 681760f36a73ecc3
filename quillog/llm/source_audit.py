"""How the sources of a language differ in their words, over the terms that enough documents hold.

The terms are found by iceberg prefix refinement. A document's terms are sorted as bytes, each with an
end mark, and each term notes the longest prefix of the ladder 4, 8, 16, ... bytes that it shares with
the term before it; so those that begin a prefix of some width in their document are those that note
less. A task adds up its documents by group, term and what it notes. Level by level the first terms are
counted by language and prefix, and prefixes in fewer than ``least`` documents go with all terms below
them; terms whose end mark lies within a kept prefix are complete, the others are refined by the next
width. No level counts a term whose prefix has gone, so the long tail of rare words never becomes a
table of groups.

Rates are exact integers: a billionth part with a prior of five in each term. The differences of
sources are summed in each task over its terms, by pair of sources, before a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import discard, durable, written

from .lookup import beside
from .names import named

#: Of each byte what it is in a term: letters (A-Z as a-z) and all beyond ASCII themselves, else a space.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
END = b"\0"
FIRST = 4
#: What rows of the first prefixes have as ``shared``: they are counted already by the tasks that make the terms.
START = -1
PRIOR, UNIT = 5, 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def shared_width(a: bytes, b: bytes, first: int = FIRST) -> int:
    """The largest width first, 2 first, 4 first, ... at which two different terms share their prefix, or 0."""
    width = first
    while a[:width] == b[:width]:
        width *= 2
    return 0 if width == first else width // 2


class Held:
    """Counts of a task's documents by group, shared width and term, until they are handed on.

    A term's entry is its documents, times ``ONE``, plus its occurrences.
    """

    SHIFT = 40
    ONE = 1 << SHIFT

    def __init__(self, first: int):
        self.first = first
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[str, str], dict[int, dict[bytes, int]]] = {}
        self.bytes = 0

    def add(self, lang: str, source: str, text: str | None) -> None:
        first, twice, one, own = self.first, 2 * self.first, self.ONE, Counter(terms_of(text))
        widths = self.groups.setdefault((lang, source), {0: {}, first: {}})
        fresh, near, before, head, taken = widths[0], widths[first], b"", None, 0
        for term in sorted(own):
            start = term[:first]
            if start != head:
                held, head = fresh, start
            elif before[:twice] != term[:twice]:  # as most do that share any prefix
                held = near
            else:
                held = widths.setdefault(shared_width(before, term, first), {})
            if term in held:
                held[term] += own[term] + one
            else:
                held[term] = own[term] + one
                taken += len(term) + 150  # a bytes object's 33, an integer's 32 and the table's 50 to 100
            before = term
        self.bytes += taken

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), widths in self.groups.items():
            for width, held in widths.items():
                packed = np.fromiter(held.values(), dtype=np.int64, count=len(held))
                ended = pc.binary_join_element_wise(pa.array(list(held), pa.binary()), pa.scalar(END, pa.binary()), pa.scalar(b"", pa.binary()))
                docs = packed >> self.SHIFT
                if width == 0:
                    starts = pa.table([pc.binary_slice(ended, 0, self.first), docs], ["start", "docs"]).group_by("start", use_threads=False).aggregate([("docs", "sum")]).combine_chunks()
                    counts = starts["docs_sum"].to_numpy()
                    yield self._batch(lang, source, pa.array(starts["start"].to_pylist(), pa.binary()), counts, np.zeros(len(counts), dtype=np.int64), START)
                yield self._batch(lang, source, ended, docs, packed & (self.ONE - 1), width)
        self.clear()

    @staticmethod
    def _batch(lang: str, source: str, terms: pa.Array, docs: np.ndarray, n: np.ndarray, shared: int) -> pa.RecordBatch:
        same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), dtype=np.int32))) for x in (lang, source)]
        return pa.RecordBatch.from_arrays([*same, terms, pa.array(docs), pa.array(n), pa.array(np.full(len(terms), shared, dtype=np.int32))], ["lang", "source", "term", "docs", "n", "shared"])


def term_rows(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", first: int = FIRST, held_bytes: int = 90_000_000, rows_at_once: int = 256) -> DataFrame:
    """(lang, source, term, docs, n, shared): ``term`` in bytes with its end mark, ``n`` its occurrences in
    ``docs`` documents of the group, in each of which an earlier term has its prefix of width ``shared``
    and no wider one. Rows whose ``shared`` is ``START`` hold a prefix of width ``first`` instead, of ``docs``
    documents. A task combines its documents in about ``held_bytes`` of memory; a term may have several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(first)
        for batch in batches:
            for begin in range(0, len(batch), rows_at_once):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(begin, rows_at_once).columns), strict=True):
                    held.add(lang, source, text)
                    if held.bytes > held_bytes:
                        yield from held.rows()
        yield from held.rows()

    columns = [F.coalesce(named(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]
    return docs.select(*columns, named(text_col).cast("string").alias("text")).mapInArrow(run, "lang string, source string, term binary, docs bigint, n bigint, shared int")


def among(rows: DataFrame, kept: DataFrame, key: Column, **options) -> DataFrame:
    """Rows whose language and ``key`` stand in ``kept`` (lang, prefix); options as for ``beside``."""
    own = kept.select("lang", F.col("prefix").alias("_prefix"))
    return beside(rows.withColumn("_prefix", key), own, ["lang", "_prefix"], "left_semi", size=F.octet_length("_prefix") + 40, **{"salts": 16, **options}).drop("_prefix")


def frequent_terms(rows: DataFrame, least: int, *, first: int = FIRST, **options) -> DataFrame:
    """(lang, prefix) of the complete terms, with their end mark, that at least ``least`` documents hold.

    ``rows`` come from ``term_rows`` and are read once a level. Only one number a level returns to the driver.
    """
    width, pending, complete = first, None, None
    while True:
        at = rows.where(F.col("shared") == START) if pending is None else among(rows.where((F.col("shared") != START) & (F.octet_length("term") > width // 2)), pending, F.substring("term", 1, width // 2), **options)
        counted = at.where(F.col("shared") < width).groupBy("lang", F.substring("term", 1, width).alias("prefix")).agg(F.sum("docs").alias("docs"))
        level = durable(counted.where(F.col("docs") >= least).select("lang", "prefix", (F.substring("prefix", -1, 1) == F.lit(END)).alias("_whole")))
        done = level.where("_whole").select("lang", "prefix")
        complete = done if complete is None else complete.unionByName(done)
        pending = level.where("NOT _whole").select("lang", "prefix")
        if pending.limit(1).count() == 0:
            return complete
        width *= 2


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)"), (total + PRIOR * terms).cast("decimal(20,0)"))).cast("bigint")


def pair_sums(rates: DataFrame) -> DataFrame:
    """(lang, i, j, value) for i < j: the sum over the rows of a language of |p[i] - p[j]|.

    ``rates`` has (lang, p), p an array with a place for each source of the language. A task holds one
    number for each pair of its languages' sources, which is what the result has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            for lang in dict.fromkeys(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                p = np.stack([flat[ends[k] : ends[k + 1]] for k in own.tolist()], axis=1)
                total = sums.setdefault(lang, np.zeros((len(p), len(p)), dtype=np.int64))
                for i in range(len(p) - 1):
                    total[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)
        for lang, total in sums.items():
            i, j = np.triu_indices(len(total), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["lang", "i", "j", "value"])

    parts = rates.mapInArrow(run, "lang string, i int, j int, value bigint")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, least: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", first: int = FIRST, **options) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source that occurs.

    Part ``pair`` has each other source of the language with the summed difference of the rates of all
    kept terms (0 where no term is kept); part ``term`` has the ``top`` kept terms that occur in the group
    and are more frequent there than in the language. Ranks go from 1 by decreasing value, ties by item.

    A document is a row: repeated rows count as often as they stand, ids aren't looked at. Null text,
    language and source are empty; texts without terms make groups with the prior's rates; an empty table
    gives an empty result; further columns are ignored, whatever their names. Texts are tokenised
    whole, once. The result itself has a row for each pair of sources of a language.
    """
    own = docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    rows = written(term_rows(own, first=first))
    kept = durable(frequent_terms(rows, least, first=first, **options))
    counts = among(rows.where(F.col("shared") != START), kept, F.col("term"), **options).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    by_term = durable(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source")))
    held = by_term.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("N"))
    vocabulary = by_term.groupBy("lang").agg(F.count("*").alias("V"), F.sum("all").alias("L"))
    groups = own.groupBy("lang", "source").agg(F.count("*").alias("_rows")).join(held, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("N", "V", "L")])
    discard(rows)
    langs = durable(groups.groupBy("lang").agg(F.max("V").alias("V"), F.max("L").alias("L"), F.sort_array(F.collect_list(F.struct("source", "N"))).alias("sources")))

    shared = beside(by_term, langs, ["lang"], size=100 + 40 * F.size("sources"), **{"salts": 16, **options})
    p = F.transform("sources", lambda s: rate(F.coalesce(F.try_element_at("by_source", s["source"]), F.lit(0)), s["N"], F.col("V")))
    sums = pair_sums(shared.select("lang", p.alias("p")))
    place = lambda i: F.element_at("sources", F.col(i) + 1)["source"]
    pairs = langs.select("lang", "sources", F.posexplode("sources").alias("i", "_a")).select("lang", "sources", "i", F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("j")).where("i <> j")
    pairs = pairs.select("lang", place("i").alias("source"), place("j").alias("item"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))

    q = rate(F.col("all"), F.col("L"), F.col("V"))
    present = F.filter("sources", lambda s: F.map_contains_key("by_source", s["source"]))
    each = shared.select("lang", "term", "V", q.alias("q"), "by_source", F.explode(present).alias("s"))
    over = each.withColumn("value", rate(F.element_at("by_source", F.col("s.source")), F.col("s.N"), F.col("V")) - F.col("q")).where("value > 0")
    item = F.expr("substring(term, 1, octet_length(term) - 1)").cast("string")
    terms = over.select("lang", F.col("s.source").alias("source"), F.lit("term").alias("part"), item.alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
