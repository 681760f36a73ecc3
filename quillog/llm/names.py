"""Column names that meet none of a caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_prefix(*frames: DataFrame) -> str:
    """A run of underscores with which no column of ``frames`` begins, whatever its case."""
    prefix = "_"
    while any(c.startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix


def named(name: str) -> Column:
    """The column of just this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")
