"""Words read from print, made ready to compare: rule bars, labels of wrapped lines, marks above letters, shapes of dates."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .money import repair_money
from .repair import repair_date

#: What a table's rules and quotes are read as at a word's edges; shapes of a date, with a Thai month, or with one not read.
EDGE = r"^[|()\[\]“”\"'‘’]+|[|()\[\]“”\"'‘’]+\z"
DATE_SHAPES = (
    r"^\d{1,2}[-/.]\d{1,2}[-/.](?:\d{2}|\d{4})\z",
    r"^\d{1,2}-?[ก-๎]{1,3}\.[ก-๎]{1,2}\.?-?(?:25|20)\d{2}\z",
    r"^\d{1,2}-[^-\s]{1,8}-(?:25|20)\d{2}\z",
)


def clean_edges(c: Column, x0: Column, x1: Column) -> Column:
    """A word as an array of (text, x0, x1): parted at bars, edges stripped, each part with its share of the box by characters."""
    parts = F.split(c, r"\|")
    share = (x1 - x0) / F.greatest(F.length(c), F.lit(1))

    def part(p: Column, i: Column) -> Column:
        at = F.length(F.array_join(F.slice(parts, F.lit(1), i), "|")) + F.when(i > 0, 1).otherwise(0)
        return F.struct(F.regexp_replace(p, EDGE, "").alias("text"), (x0 + at * share).alias("x0"), (x0 + (at + F.length(p)) * share).alias("x1"))

    return F.filter(F.transform(parts, part), lambda w: w["text"] != "")


def without_labels(c: Column, labels: list[str]) -> Column:
    """A description without the labels that wrapped lines brought in; runs of blanks become one."""
    for label in labels:
        c = F.replace(c, F.lit(label), F.lit(" "))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    # In small parts, so that of a batch of long texts only Arrow's bytes are held, not a Python string for each (Arrow's own normaliser doesn't compose).
    parts = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(i, 256).to_pylist()], pa.string()) for i in range(0, len(texts), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def bare(c: Column) -> Column:
    """Composed letters without the marks above and below them, and without blanks: what a reader drops most."""
    return F.regexp_replace(_composed(c), r"[\p{M}\p{Z}\t\n\x0b\f\r﻿]+", "")


def is_date_word(c: Column) -> Column:
    """Whether a word has a date's shape, its month read or not."""
    out = F.lit(False)
    for shape in DATE_SHAPES:
        out = out | c.rlike(shape)
    return out


def tidy(c: Column, kind: Column) -> Column:
    """A word repaired by its column's kind: money and dates only, and only where the repair is certain."""
    return F.when(kind == "money", repair_money(c)).when(kind == "date", F.coalesce(repair_date(c), c)).otherwise(c)
