"""Exact line dedup: each repeated line stays only in the smallest document that holds it.

Lines travel as 128-bit hashes of their keys with document and position. They are range-partitioned
by hash with a secondary sort by document and position, and the first occurrence of each hash is
streamed along. The result is one compressed bitmap per document, not text: 63 positions to a long,
and only longs in which something is dropped.

Very frequent lines (each over one part in ``hot_parts`` of all lines, hence at most ``hot_parts`` of
them) are known beforehand from an aggregate that is combined before its shuffle; they are dealt
over many ranges by a salt, and their first document comes from a broadcast of that bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillog.session import durable

from .names import free_prefix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
BITS = 63


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII takes the faster function."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _th, _pos, _h1, _h2) of every line whose key has at least ``min_chars`` code points."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.posexplode_outer(lines_of(F.col(text_col))).alias("_pos", "_line"))
    return (
        own.withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )


def drop_bitmaps(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    hot_parts: int = 10_000,
    hot_rows: int = 64,
    salts: int = 256,
) -> DataFrame:
    """(_id, _th, _bits) for documents that lose a line: ``_bits`` maps position div 63 to a mask.

    Repeated ids are one document. Rows with a null id are left out: they neither count nor lose lines.
    """
    lines = durable(line_hashes(docs, id_col, text_col, min_chars))  # read three times; texts only once
    total = lines.count()
    hot = (
        lines.groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_hot_first"))
        .where(F.col("_n") > max(hot_rows, total // hot_parts))
        .select("_h1", "_h2", "_hot_first")
    )
    salted = lines.join(F.broadcast(hot), ["_h1", "_h2"], "left").withColumn(
        "_salt", F.when(F.col("_hot_first").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    ranged = salted.repartitionByRange("_h1", "_h2", "_salt").sortWithinPartitions("_h1", "_h2", "_salt", "_id", "_pos")
    stream = Window.partitionBy("_h1", "_h2", "_salt").orderBy("_id", "_pos")
    first = F.coalesce("_hot_first", F.first("_id").over(stream))
    dropped = ranged.withColumn("_first", first).where(F.col("_id") > F.col("_first"))
    words = dropped.groupBy("_id", "_th", F.expr(f"_pos div {BITS}").cast("int").alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, _pos % {BITS})")).alias("_mask")
    )
    return words.groupBy("_id", "_th").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_bits"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: str = "_", **options) -> DataFrame:
    """Every row of ``docs`` with its remaining text in ``text_col``, and n_lines and n_dropped, their
    names after ``prefix``.

    Null and empty texts have one empty line and stay as an empty text; a document all of whose
    lines go keeps an empty text. Equal rows are treated equally; an empty table gives an empty result.
    Other columns pass unchanged, but columns of ``docs`` that have a result's name are replaced by it;
    ``free_prefix`` gives a prefix that meets none.
    """
    results = [f"{prefix}n_lines", f"{prefix}n_dropped"]
    docs = docs.drop(*[c for c in results if c not in (id_col, text_col)])
    own = free_prefix(docs)
    hashed, bits, kept_text = f"{own}th", f"{own}bits", f"{own}kept"
    marks = drop_bitmaps(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    marks = marks.select(F.col("_id").alias(id_col), F.col("_th").alias(hashed), F.col("_bits").alias(bits))
    rows = docs.withColumn(hashed, F.xxhash64(text_col)).join(marks, [id_col, hashed], "left")
    lines = lines_of(F.col(text_col))

    def gone(i: Column) -> Column:
        mask = F.element_at(F.col(bits), F.floor(i / BITS).cast("int"))
        return F.coalesce(F.call_function("shiftright", mask, (i % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    kept = F.when(F.col(bits).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~gone(i)), "\n")
    )
    n_dropped = F.when(F.col(bits).isNull(), F.lit(0)).otherwise(
        F.aggregate(F.map_values(bits), F.lit(0), lambda n, mask: n + F.bit_count(mask))
    )
    counted = rows.withColumns({results[0]: F.size(lines).cast("bigint"), results[1]: n_dropped.cast("bigint"), kept_text: kept})
    return counted.drop(text_col, bits, hashed).withColumnRenamed(kept_text, text_col)
