"""Joins of many rows with a table of unique keys, whose size is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", *, size: Column | None = None, broadcast_bytes: int = 48_000_000, salts: int = 1) -> DataFrame:
    """``rows`` joined (or semi-joined) with ``table``, whose ``keys`` are unique and which should be written.

    ``size`` is what a row of the table takes in memory (64 bytes if not given). Up to ``broadcast_bytes``
    the table is broadcast. Beyond that both sides are shuffled: a frequent key's rows go to ``salts``
    tasks by a salt, with the table repeated for each (for tables much smaller than the rows), and what
    is still skewed is left to Spark's adaptive splitting of joins.
    """
    taken = table.agg(F.sum(F.lit(64) if size is None else size)).first()[0] or 0
    if taken <= broadcast_bytes:
        return rows.join(F.broadcast(table), keys, how)
    if salts == 1:
        return rows.join(table, keys, how)
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how).drop("_salt")
