"""The corpus pipeline: language, lines, near-duplicates, benchmark leaks, then pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` applies them to ``documents``, writing each stage's rows to the shared
checkpoint folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillog.llm import decontam, lang_crf, line_dedup, minhash_icws, piece_codec
from quillog.llm.names import free_prefix
from quillog.session import durable, table

#: A document is rejected where its likeliest language has less than this share of its words.
MIN_LANGUAGE_SCORE = 0.3

#: SQL can't express the stages: a fitted model, keyed sampling and a tokenizer.
ORACLE_SQL = None


def _like(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs``, with n_chars (where there is one) following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length(text).cast("bigint"))
    return docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; those without a letter or of no one language go.

    Null and empty texts go; repeated rows, null ids and further columns pass as they are; an empty
    table gives an empty one.
    """
    own = free_prefix(docs)
    tagged = lang_crf.predict(docs, lang_crf.learn(docs), prefix=own)
    return tagged.where((F.col(f"{own}lang_pred") != lang_crf.UNKNOWN) & (F.col(f"{own}score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the smallest document; documents left without text go.

    Null and empty texts stay, as empty ones; repeated rows are treated equally; rows with a null id
    lose nothing; further columns pass as they are; an empty table gives an empty one.
    """
    own = free_prefix(docs)
    left = line_dedup.dedup_lines(docs, prefix=own)
    return _like(left.where(F.col(f"{own}n_dropped").eqNullSafe(0) | F.col("text").rlike(r"\S")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    All rows of the id that stays are kept, whatever else they hold. Texts without words (null and
    empty ones too) are groups of their own; rows with a null id stay; an empty table gives an empty one.
    """
    groups = minhash_icws.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where(F.col("doc_id") != F.col("group_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go.

    Null and empty texts, and all where the benchmark is empty, stay; repeated rows are treated
    equally; null ids and further columns pass as they are; an empty table gives an empty one.
    """
    own = free_prefix(docs)
    flagged = decontam.flag(docs, table(spark, sf_dir, "benchmark"), prefix=own)
    return flagged.where(~F.col(f"{own}contaminated")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each remaining text, and whether they decode to it.

    Null texts have null ids; repeated rows and null ids are rows like others; further columns go; an
    empty table gives an empty result.
    """
    return piece_codec.encode_table(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
