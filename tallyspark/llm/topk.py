"""Exact top-k search: an impact-ordered index that is read score-at-a-time.

Vectors become integers (``scale`` times each component, rounded down).  They are
dealt at random into index blocks.  In a block each dimension's range is cut into
posting segments of two layers: ``LEVELS[0]`` bands, and ``LEVELS[1]`` sub-bands of
each band.  A segment's quantised impact on a query is the query's component times
the segment's place in its layer times the layer's step, so all segments of the first
layer have more impact than those of the second.  Segments of one layer and all
dimensions are added to the scores of a batch of queries in one product.

After each layer there are bounds: what a segment leaves open is the step of its
layer.  A vector stays only if its upper bound reaches the k-th best lower bound of its
block; those that remain after the last layer are scored exactly with the stored
integers.  A vector is dropped on that proof only, so no member can be lost, ties
included.  Rows with the same integers are one vector with many ids.

A block stays in the task that holds it and query batches stream past it; each block
gives k rows for a query, and a window over the query keeps the best.  Queries are
rows of the table too, so the work is rows times queries; what is shuffled is each vector
once and each query once for a block of up to ``BLOCK`` vectors.

Nulls: vectors that are null, hold a null or a value that isn't finite, or have a
null id, take part neither as query nor as candidate.  Empty vectors and vectors of
another length than the query's score the product of the components both have (0
if none).  Ties: the smaller id.  Repeated ids: each row is a candidate; a query id
that repeats gives its result once, by its first vector in order, and no row of the
query's own id is a candidate.  Large components: scores are exact integers and ranked
as such; one beyond 64 bits is returned as the nearest that 64 bits hold.  Empty
tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import keep

#: Most vectors of an index block, fewest where there would be fewer blocks than tasks, and queries of a batch.
BLOCK, LEAST, BATCH = 65_536, 4096, 256
#: Bands of a dimension, and sub-bands of a band.
LEVELS = (32, 64)
#: Vectors whose best score is taken together where a batch's k-th best is looked for.
GROUP = 32
SMALLEST, LARGEST = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: the usable vectors as arrays of integers."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _dense(columns: list[pa.Array], width: int | None = None) -> np.ndarray:
    """Rows of integers, short ones filled with zeros, long ones cut to ``width``."""
    parts = []
    width = max((max(c.value_lengths().to_pylist(), default=0) for c in columns), default=0) if width is None else width
    for c in columns:
        lengths = np.asarray(c.value_lengths()).astype(np.int64)
        flat = np.asarray(c.flatten()).astype(np.int64)
        if len(lengths) and (lengths == width).all():
            parts.append(flat.reshape(len(lengths), width))
            continue
        out = np.zeros((len(lengths), width), np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row[place < width], place[place < width]] = flat[place < width]
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)


class Index:
    """One block's vectors: distinct integers with their ids in order, and each component's segments in two layers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        x = np.ascontiguousarray(x)
        self.width = x.shape[1]
        if self.width:
            _, first, of = np.unique(x.view(np.dtype((np.void, 8 * self.width))).ravel(), return_index=True, return_inverse=True)
        else:
            first, of = np.zeros(min(1, len(x)), np.int64), np.zeros(len(x), np.int64)
        order = np.lexsort((ids, of))
        self.x, self.ids, self.vector = x[first], ids[order], of[order]
        self.start = np.searchsorted(self.vector, np.arange(len(first) + 1))
        self.largest = int(np.abs(self.x.astype(np.float64)).max(initial=0)) + 1
        self.low = self.x.min(axis=0, initial=LARGEST).astype(np.float64)
        span = (self.x.max(axis=0, initial=SMALLEST).astype(np.float64) - self.low) * (1 + 1e-9) + 1
        place = (self.x - self.low) / span
        self.steps = span / LEVELS[0], span / LEVELS[0] / LEVELS[1]
        band = np.floor(place * LEVELS[0])
        self.layers = band.astype(np.float32), np.floor((place * LEVELS[0] - band) * LEVELS[1]).clip(0, LEVELS[1] - 1).astype(np.float32)
        # What arithmetic in floating point may be wrong by, for each unit of a query's component.
        self.slack = (np.abs(self.low) + span) * (self.width + 8) * 1.2e-7

    def exact(self, query: np.ndarray, rows: np.ndarray) -> list[int] | np.ndarray:
        if float(np.abs(query.astype(np.float64)).sum()) * self.largest < 2.0**62:
            return self.x[rows] @ query
        return [sum(int(a) * int(b) for a, b in zip(self.x[r], query, strict=True)) for r in rows]

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query id, id, score) of the k best of this block for each query."""
        if not len(self.x):
            return
        q = queries[:, : self.width].astype(np.float64)
        size = np.abs(q)
        # Rows of the queries' own ids; a vector stays while another id has it.
        more = np.searchsorted(np.sort(self.ids), own_ids, "right") - np.searchsorted(np.sort(self.ids), own_ids, "left")
        wrong = size @ self.slack
        base = q @ self.low + np.minimum(q, 0) @ self.steps[0] - wrong
        lower = (q * self.steps[0]).astype(np.float32) @ self.layers[0].T
        wanted = k + more
        groups = -(-len(self.x) // GROUP)
        best = np.full((len(q), groups * GROUP), -np.inf, np.float32)
        best[:, : len(self.x)] = lower
        best = np.sort(best.reshape(len(q), groups, GROUP).max(axis=2), axis=1)[:, ::-1]
        # The k-th best group has a vector of that score at least, and so have those before it.
        kth = np.where(wanted <= groups, best[np.arange(len(q)), np.minimum(wanted, groups) - 1], -np.inf)
        open_ = size @ self.steps[0] + 2 * wrong
        row, col = np.nonzero(lower >= (kth - open_)[:, None])
        cuts = np.searchsorted(row, np.arange(len(q) + 1))
        for i in range(len(q)):
            rows = col[cuts[i] : cuts[i + 1]]
            if len(rows) > wanted[i]:
                sure = lower[i, rows].astype(np.float64) + base[i] - np.minimum(q[i], 0) @ self.steps[0] + self.layers[1][rows] @ (q[i] * self.steps[1]) + np.minimum(q[i], 0) @ self.steps[1]
                least = np.partition(sure, len(sure) - wanted[i])[len(sure) - wanted[i]]
                rows = rows[sure + size[i] @ self.steps[1] + 2 * wrong[i] >= least]
            scores = self.exact(queries[i, : self.width], rows)
            yield from self._first(int(own_ids[i]), rows, scores, k)

    def _first(self, own: int, rows: np.ndarray, scores, k: int) -> Iterator[tuple[int, int, int]]:
        found = []
        for r, s in sorted(zip(rows.tolist(), map(int, scores), strict=True), key=lambda e: -e[1]):
            if len(found) >= k and s < found[k - 1][0]:
                break
            ids = self.ids[self.start[r] : self.start[r + 1]]
            ids = ids[:k] if own not in ids[:k] else ids[ids != own][:k]
            found = sorted([*found, *((s, i) for i in ids.tolist())], key=lambda e: (-e[0], e[1]))[:k]
        for s, i in found:
            yield own, i, s


def _search_blocks(k: int):
    """Rows (block, batch, vec_id, v), sorted: a block's vectors (batch -1), then the query batches that stream past. -> query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, None
        held: list[pa.RecordBatch] = []

        def answer(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.asarray(p.column(2)) for p in parts])
            queries = _dense([p.column(3) for p in parts], index.width)
            for at in range(0, len(ids), BATCH):
                rows = [(q, i, min(max(s, SMALLEST), LARGEST), None if SMALLEST < s < LARGEST else str(s)) for q, i, s in index.search(ids[at : at + BATCH], queries[at : at + BATCH], k)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["query_id", "vec_id", "score", "exact"])

        for batch in batches:
            numbers, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1)) >= 0
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if numbers[start] != block:
                    block, index, held = numbers[start], None, []
                if not kinds[start]:
                    held.append(part)
                    continue
                if index is None:
                    ids = np.concatenate([np.asarray(p.column(2)) for p in held]) if held else np.zeros(0, np.int64)
                    index = Index(ids, _dense([p.column(3) for p in held]))
                    held = []
                yield from answer([part])

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each row that ``is_query`` (a condition on ``vec_id``) holds for."""
    spark = vectors.sparkSession
    rows = keep(integers(vectors, id_col, vector_col, scale), "topk-vectors")
    n = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK), min(tasks, n // LEAST))
    candidates = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), F.lit(-1).alias("batch"), "vec_id", "v")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(0).alias("batch"), "vec_id", "v")
    dealt = candidates.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "batch")
    near = dealt.mapInArrow(_search_blocks(k), "query_id long, vec_id long, score long, exact string")
    # Exact scores order those that 64 bits can't hold.
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact").cast("decimal(38,0)").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
