"""Token counts: batch encoding in Arrow functions that return lengths only.

Whole texts are cut at places where byte-level BPE never joins bytes, new pieces
are encoded with the vocabulary's library in batches balanced by bytes, and only
the counts leave the Python worker.  There is no shuffle; memory is bounded by
one Arrow batch and the table of known pieces (``most_known`` entries).

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id stays null.
Empty texts: 0 tokens.  Repeated rows: one result row each.  Empty tables: no
rows.  Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import PieceCounter, default_vocabulary


def count_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary``: the tokenizer's file, at the same place on every executor.
    ``slice_bytes``: texts taken together from an Arrow batch.
    """
    path = vocabulary or default_vocabulary()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop, size = start, 0
                while stop < batch.num_rows and (stop == start or size + sizes[stop] <= slice_bytes):
                    size += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                counts = counter.count(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
                start = stop

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    slim = slim.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = slim.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
