"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch

#: ASCII white space: the blank and \x09 to \x0D, as Java's regex engine takes it.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` with a number that tells its rows apart, and that column's name; written once, so that it lasts."""
    name = free_name(df, "_row_number")
    return keep(df.withColumn(name, F.monotonically_increasing_id()), label), name
