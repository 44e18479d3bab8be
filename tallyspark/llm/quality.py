"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A document is a vector of hashed counts: its byte trigrams, the trigrams of its
characters' classes (lower, upper, digit, blank, other bytes as they are) and of
repetition (how many of its words repeat the one before, how few are distinct).
Counts are damped, scaled to length one and projected on the leading singular
vectors of a bounded sample of labelled documents (``sample`` rows at most, those
with the smallest digests of their ids).  The sample's vectors are broadcast - a
few MB, whatever the input - and each task multiplies its documents with them in
blocks.  Features, projection and vectors are rounded to integers, so products are exact
and a score doesn't depend on which documents share a block.  The ``neighbours`` most
similar vote with their similarity to the power ``sharpness``.

The whole text counts; label, lang, source and id are never inputs.  Nulls: a null
text is empty; a text without any feature (empty) gets the sample's share of label
1; a null id stays null.  Ties in similarity: the neighbours that come first in the
sample.  Repeated rows: one result each.  Sampled rows of one id and label count
once.  Long texts: features of a whole text are counted in slices of 1 MB.  No labelled rows: every score is 0.5.
Empty tables: no rows.  Other columns are carried along; one that has the name of a
result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import text_or_empty

#: Hashed features of raw and of class trigrams, and bins of the two repetition measures.
RAW, SHAPE, BINS = 2048, 2048, 16
FEATURES = RAW + SHAPE + 2 * BINS
#: Units of features and projection, and of vectors of length one.
UNIT, LENGTH = 1 << 12, 1 << 14
#: Bytes of a text whose trigrams are counted at once.
SLICE = 1 << 20
#: Rows of the sample that are multiplied at once.
SOME_ROWS = 256

_byte = np.arange(256)
_class = np.where((_byte >= 97) & (_byte <= 122) | (_byte >= 128), ord("a"), np.where((_byte >= 65) & (_byte <= 90), ord("A"), np.where((_byte >= 48) & (_byte <= 57), ord("0"), np.where((_byte == 32) | (_byte >= 9) & (_byte <= 13), 32, _byte)))).astype(np.uint8)


def _hashed(b: np.ndarray, size: int, kinds: np.ndarray | None = None) -> np.ndarray:
    """Counts of hashed trigrams of bytes, or of their kinds."""
    out = np.zeros(size, np.int64)
    for start in range(0, max(1, len(b) - 2), SLICE):
        w = b[start : start + SLICE + 2]
        w = (w if kinds is None else kinds[w]).astype(np.uint32)
        h = (w[:-2] << np.uint32(16) | w[1:-1] << np.uint32(8) | w[2:]) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(32 - size.bit_length() + 1), minlength=size)
    return out.astype(np.float32)


def features(text: str) -> np.ndarray:
    """The damped counts of a text, of length one; zeros for a text without words."""
    out = np.zeros(FEATURES, np.float32)
    data = text.encode()
    words = data.split()
    if not words:
        return out
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    out[:RAW] = np.log1p(_hashed(b, RAW))
    out[RAW : RAW + SHAPE] = np.log1p(_hashed(b, SHAPE, _class))
    for at in (out[:RAW], out[RAW : RAW + SHAPE]):
        at /= max(float(np.linalg.norm(at)), 1e-9)
    again = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
    few = 1 - len(set(words)) / len(words)
    rest = out[RAW + SHAPE :]
    rest[min(BINS - 1, int(again * BINS))] = 0.7
    rest[BINS + min(BINS - 1, int(few * BINS))] = 0.35
    return out / float(np.linalg.norm(out))


@dataclass
class Model:
    """Projection (features x dimensions) and the sample's vectors, both in whole units, its labels, and the share of label 1."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float
    neighbours: int
    sharpness: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if not len(self.labels) or not texts:
            return out
        x = np.rint(np.stack([features(t) for t in texts]) * UNIT).astype(np.float64)
        z = units(x @ self.projection)
        some = np.flatnonzero(z.any(axis=1))
        many = len(self.labels)
        k = min(self.neighbours, many)
        for start in range(0, len(some), 256):
            rows = some[start : start + 256]
            # One number for similarity and place in the sample; all are whole and below 2^53.
            key = (z[rows] @ self.vectors.T) * many + np.arange(many)[::-1]
            near = np.argpartition(-key, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(key, near, 1), axis=1), 1)
            cosine = np.floor(np.take_along_axis(key, near, 1) / many) / LENGTH**2
            weight = np.maximum(cosine, 1e-6) ** self.sharpness
            out[rows] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def units(z: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in whole units; rows of zeros stay."""
    norm = np.sqrt((z * z).sum(axis=1))
    return np.rint(z / np.where(norm > 0, norm, 1.0)[:, None] * LENGTH)


def leading(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``x`` by subspace iteration from a fixed start."""
    start = np.random.default_rng(5).standard_normal((x.shape[1], min(x.shape[1], k + 16))).astype(np.float32)
    q, _ = np.linalg.qr(start)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, values, right = np.linalg.svd(x @ q, full_matrices=False)
    return q @ right[:k][values[:k] > 1e-4].T


def fit(labelled: DataFrame, sample: int = 4096, dimensions: int = 64, neighbours: int = 15, sharpness: float = 16.0) -> Model:
    """Fit on at most ``sample`` rows (doc_id, text, label) - a documented bound; the fit takes seconds on the driver."""
    known = labelled.where("label is not null").select("doc_id", text_or_empty("text").alias("text"), F.col("label").cast("int").alias("label"))
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id", "label").alias("draw")).orderBy("draw", "doc_id", "label").limit(sample)
    texts = known.join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("label").alias("is"), "draw")), (F.col("_id") == F.col("doc_id")) & (F.col("is") == F.col("label")))
    texts = texts.withColumn("id", F.col("doc_id").cast("string"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], ["draw", "id", "label", "vector"])

    # A row for each sampled id and label, however many texts they stand on.
    drawn = texts.select("draw", "id", "label", "text").mapInArrow(vectors, "draw long, id string, label int, vector binary")
    rows = drawn.groupBy("draw", "id", "label").agg(F.min("vector").alias("vector")).toArrow()  # ``sample`` rows at most
    x, y = matrix(rows)
    del rows
    if not len(y):
        return Model(np.zeros((FEATURES, 1)), np.zeros((0, 1)), y, 0.5, neighbours, sharpness)
    basis = np.rint(leading(x, min(dimensions, *x.shape)) * UNIT).astype(np.float64)
    # Products of whole numbers are exact, so slices of rows give what the whole sample would, in less memory.
    z = np.concatenate([np.rint(x[at : at + SOME_ROWS] * UNIT).astype(np.float64) @ basis for at in range(0, len(x), SOME_ROWS)])
    return Model(basis, units(z), y, float(y.mean()), neighbours, sharpness)


def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sample's features and labels in order of draw, id and label; the vectors are copied once, into the result."""
    draw, ids, labels = (rows.column(c).to_pylist() for c in ("draw", "id", "label"))
    vector = [v for chunk in rows.column("vector").chunks for v in chunk]
    order = sorted(range(len(draw)), key=lambda i: (draw[i], ids[i] or "", labels[i]))
    x = np.empty((len(order), FEATURES), np.float32)
    for at, i in enumerate(order):
        x[at] = np.frombuffer(vector[i].as_buffer(), np.float16)
    return x, np.array([labels[i] for i in order], np.float64)


def held_out(id_column: str | Column = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score is at least ``least``), or what ``names`` calls them."""
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                scores = np.clip(carried.value.scores([t or "" for t in batch.column(at).to_pylist()]), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(scores), pa.array((scores >= least).astype(np.int32))], result)

    at = docs.columns.index(text_col)
    others = [k for k, c in enumerate(docs.columns) if c.lower() not in [n.lower() for n in names]]
    kind = StructType([*(docs.schema.fields[k] for k in others), StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    result = kind.names
    return docs.mapInArrow(run, kind)
