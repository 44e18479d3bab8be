"""A corpus pipeline: quality, exact dedup, near dedup, mixing and packing, each stage an operator of ``tallyspark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes
as Parquet and reads again as the next stage's documents.  What holds for all stages:
decisions are made on rows, never on ids, so a row with a null id, or with the id of
another text, keeps its own decision; repeated rows are rows of their own; a null text counts as
empty; long texts are read whole; extra columns are carried through all but the
last stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, mixing, near_dup, packing, quality
from tallyspark.llm.common import free_name, keep, numbered
from tallyspark.llm.queries import quality_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (a score of 0.3 or more).

    Empty and null texts score the sample's share of label 1.  Equal texts score alike, so ties and
    repeated rows go the same way.
    """
    names = free_name(docs, "_score"), free_name(docs, "_predicted")
    return quality.score(docs, quality_model(spark, sf_dir), names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space counting as one blank), the row with the smallest id.

    Null and empty texts are equal.  A row without id stays only where no row of its text has one; among rows of
    one id and text, the first by place in its file stays.
    """
    at = free_name(docs, "_locator")
    rows = exact_dedup.located(docs, at)
    kept = exact_dedup.deduplicate(rows, locator_col=at).where("kept").select(F.col("locator").alias(at))
    return rows.join(kept, at, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8), the row with the smallest id.

    Texts without words are linked with nothing and stay.  A row without id stays only where no row of its group has
    one; ties go to the first row.
    """
    rows, row = numbered(docs, "near-rows")
    groups = near_dup.near_duplicates(rows, words=5, percent=80, id_col=row).select(F.col("doc_id").alias("place"), "component_id")
    ids = rows.select(F.col(row).alias("place"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("rank"))
    stays = groups.join(ids, "place").groupBy("component_id").agg(F.min(F.struct("rank", "place"))["place"].alias(row)).select(row)
    return rows.join(stays, row, "left_semi").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its words of a document by the document's size, to the nearest whole.

    Texts without words are taken no time.  Null sources are a source.
    """
    at, n, each = free_name(docs, "_locator"), free_name(docs, "_copies"), free_name(docs, "_copy")
    rows = exact_dedup.located(docs, at)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias(n)
    taken = mixing.mix(rows, carry=[at]).select(at, copies).where(F.col(n) > 0)
    return rows.join(taken, at).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(each)).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    A null or empty text is one piece that holds the end id; long texts are cut into pieces of a sequence's length.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mix", mix_stage),
    ("sequence packing", pack_stage),
]

#: Votes of neighbours, token ids and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
