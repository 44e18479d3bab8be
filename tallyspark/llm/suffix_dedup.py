"""Repeated strings removed from all texts, by bucket-pointer refinement.

Every string of ``width`` bytes that starts at two or more places of the corpus is repeated; every byte that a
repeated string covers is removed.  Buckets hold the starts of strings that agree so far:

1. **Initial buckets.**  Each string falls into the bucket of one q-gram inside it: the one of least hash, the first of
   equals.  Equal strings choose equal q-grams, so they share a bucket.  Neighbouring strings mostly choose the same
   place, so consecutive starts travel as one run: about one row for 70 bytes of text.
2. **Whole runs.**  A bucket of one run is finished, its strings are unique.  Where all runs of a bucket are equal over
   all their strings (128-bit digests of the bytes), they are finished too: all repeated.
3. **Refinement.**  In the other buckets, each distinct run is taken once with its bytes.  Tasks hold many buckets: there every
   position points to the bucket of its first 32 bytes, and buckets are refined by sorting on the pointer pairs
   (position, position + 32), then (position, position + 64), then at the offset that completes ``width``.  Each round reads
   the pointers that the round before has written, and positions that are alone in their bucket are finished and not sorted again.
   Members of what remains are compared byte by byte, so the result doesn't rest on the pointers' first hash.

A bucket with more than ``crowd`` distinct runs isn't sent to one task: its strings are counted as rows by their
128-bit digests, combined before the shuffle, which gives the same result.  Texts are cut into pieces of ``PIECE`` starts,
which only ends runs early.  Texts are told apart by 128 bits of their SHA-256, and copies of a text are shuffled once, so
a text that half of the rows hold makes no hot key; runs of one bucket are dealt over several parts.

Nulls: a null text is empty; a null id stays.  Empty texts and texts shorter than ``width``: nothing is removed.  Repeated
rows: both lose all strings of ``width`` bytes, as each repeats in the other.  Matches never cross texts.  Very long texts: pieces.
What remains is bytes: a removed run may end inside a character, hence only its digest is returned.  Empty tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_or_empty

GRAM = 32
PIECE = 1 << 20
#: Parts that runs of one bucket, or equal runs, are dealt over where they are joined with what is known of them.
SALTS = 16
#: Contexts that a task refines together.
BLOCK = 1000
RUN = "k1 long, k2 long, start long, length int, gram long, d1 long, d2 long"
_LETTERS = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place, from hashes of halves."""
    h, factor, step = _LETTERS[data], _FACTOR, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), 2 * step
    return (h ^ (h >> np.uint64(29))) * _MIX


def window_runs(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and q-gram hash of each run of strings that choose the same q-gram."""
    h = gram_hashes(data)
    best = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    window, covered = width - GRAM + 1, 1
    while covered < window:
        step = min(covered, window - covered)
        best = np.minimum(best[:-step], best[step:])
        covered += step
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, np.diff(np.append(first, len(place))), h[place[first]].view(np.int64)


def digest(piece: bytes) -> tuple[int, int]:
    both = hashlib.blake2b(piece, digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def text_key(raw: bytes) -> tuple[int, int]:
    key = hashlib.sha256(raw).digest()
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:16], "big", signed=True)


def keyed(docs: DataFrame) -> DataFrame:
    """Each text's compressed bytes under two longs of its SHA-256, for texts of any length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, packed = [], []
            for value in batch.column(0):
                raw = value.as_py()
                keys.append(text_key(raw))
                packed.append(packer.compress(raw))
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["k1", "k2", "packed"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(pack, "k1 long, k2 long, packed binary")


def text_runs(docs: DataFrame, width: int) -> DataFrame:
    """``RUN`` rows of all strings: text, first start, number of starts, initial bucket, digest of the bytes they cover."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RUN.split(", ")]

        def batch_of(parts: list[tuple]) -> pa.RecordBatch:
            keys = np.repeat(np.array([p[0] for p in parts], np.int64).reshape(-1, 2), [len(p[1]) for p in parts], axis=0)
            pairs = np.frombuffer(b"".join(p[4] for p in parts), np.int64).reshape(-1, 2)
            columns = [keys[:, 0], keys[:, 1], *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)), pairs[:, 0], pairs[:, 1]]
            columns[3] = columns[3].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py()
                for base in range(0, len(raw) - width + 1, PIECE):
                    piece = raw[base : base + PIECE + width - 1]
                    first, count, gram = window_runs(np.frombuffer(piece, np.uint8), width)
                    ends = (first + count + width - 1).tolist()
                    digests = b"".join([hashlib.blake2b(piece[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), ends)])
                    parts.append((text_key(raw), first + base, count, gram, digests))
                    held += len(first)
                    if held > 20000:
                        yield batch_of(parts)
                        parts, held = [], 0
        if parts:
            yield batch_of(parts)

    return docs.where(F.octet_length("text") >= width).select(F.col("text").cast("binary").alias("text")).mapInArrow(runs, RUN)


def refine(contexts: list[bytes], width: int) -> list[np.ndarray]:
    """For each context, which of its strings of ``width`` bytes occur twice or more in all contexts: pointers refined in rounds."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    size = len(data)
    #: Bytes from each position to its context's end.
    room = np.repeat(ends, [len(c) for c in contexts]) - np.arange(size)
    grams = gram_hashes(data)
    live = np.flatnonzero(room[: len(grams)] >= GRAM)
    pointer, crowd = np.full(size, -1), np.zeros(size, np.int64)
    _, bucket, members = np.unique(grams[live], return_inverse=True, return_counts=True)
    pointer[live], crowd[live], fresh = bucket, members[bucket], len(members)
    depth = GRAM
    while depth < width:
        step = min(depth, width - depth)
        live = live[(crowd[live] > 1) & (room[live] >= depth + step)]
        later = live + step
        alone = crowd[later] <= 1
        crowd[live[alone]] = 1
        live, later = live[~alone], later[~alone]
        _, bucket, members = np.unique(pointer[live] * np.int64(fresh) + pointer[later], return_inverse=True, return_counts=True)
        pointer[live], crowd[live], fresh = bucket + fresh, members[bucket], fresh + len(members)
        depth += step
    starts = live[crowd[live] > 1]
    flags = np.zeros(size, bool)
    if len(starts):
        _, first, bucket = np.unique(pointer[starts], return_index=True, return_inverse=True)
        lead = starts[first][bucket]
        same = np.ones(len(starts), bool)
        eights = np.ndarray(size - 7, np.uint64, data, strides=(1,))  # the eight bytes from each position on
        for i in [*range(0, width - 8, 8), width - 8]:
            same &= eights[starts + i] == eights[lead + i]
        flags[starts] = True
        if not same.all():  # a bucket of unequal strings, by a hash that collides: its members are counted as they are
            mixed = np.isin(bucket, bucket[~same])
            seen: dict[bytes, list[int]] = {}
            for s in starts[mixed].tolist():
                seen.setdefault(data[s : s + width].tobytes(), []).append(s)
            for places in seen.values():
                flags[places] = len(places) > 1
    return [flags[e - len(c) : e - width + 1] for c, e in zip(contexts, ends.tolist())]


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of true entries as first and last place."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def refined(contexts: DataFrame, width: int) -> DataFrame:
    """``k1``, ``k2``, ``first``, ``last`` (starts) of repeated strings in contexts that occur once, a bucket's contexts together."""
    out = ["k1", "k2", "first", "last"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple]) -> pa.RecordBatch:
            found = [(r[1], r[2], r[3] + a, r[3] + b) for r, flags in zip(rows, refine([r[5] for r in rows], width)) if r[4] == 1 for a, b in stretches(flags)]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], out)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if len(held) >= BLOCK and row[0] != held[-1][0]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    parts = contexts.select("gram", "k1", "k2", "start", "copies", "bytes").repartition("gram").sortWithinPartitions("gram")
    return parts.mapInArrow(solve, "k1 long, k2 long, first long, last long")


def counted(contexts: DataFrame, width: int) -> DataFrame:
    """The same for buckets of any size: each string is a row, counted by its digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, start, copies, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                pairs = [digest(raw[i : i + width]) for i in range(len(raw) - width + 1)]
                m = len(pairs)
                columns = [[k1] * m, [k2] * m, range(start, start + m), [copies] * m, [p[0] for p in pairs], [p[1] for p in pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "at", "copies", "d1", "d2"])

    rows = contexts.select("k1", "k2", "start", "copies", "bytes").mapInArrow(strings, "k1 long, k2 long, at long, copies long, d1 long, d2 long")
    twice = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("d1", "d2")
    return rows.where("copies = 1").join(twice, ["d1", "d2"]).select("k1", "k2", F.col("at").alias("first"), F.col("at").alias("last"))


def cut_out(asked: DataFrame, width: int) -> DataFrame:
    """``k1``, ``k2``, ``gram``, ``start``, ``copies``, ``bytes`` of rows with a packed text and its asked ``runs``."""
    names = ["k1", "k2", "gram", "start", "copies", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k1, k2, packed, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = opener.decompress(packed)
                for r in runs:
                    piece = raw[r["start"] : r["start"] + r["length"] + width - 1]
                    for column, value in zip(out, (k1, k2, r["gram"], r["start"], r["copies"], piece)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for c, n in zip(out, names)], names)

    return asked.select("k1", "k2", "packed", "runs").mapInArrow(cut, "k1 long, k2 long, gram long, start long, copies long, bytes binary")


def remaining(spanned: DataFrame, width: int) -> DataFrame:
    """``k1``, ``k2``, ``n_removed``, ``n_spans``, ``kept_sha256`` of rows with a packed text and its repeated ``spans`` of starts."""
    names = ["k1", "k2", "n_removed", "n_spans", "kept_sha256"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for k1, k2, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw, kept, at, removed, n = opener.decompress(packed), hashlib.sha256(), 0, 0, 0
                for a, b in sorted((s["first"], s["last"] + width) for s in spans):
                    if a > at or not n:
                        kept.update(raw[at:a])
                        n, at = n + 1, a
                    removed += max(0, b - at)
                    at = max(at, b)
                kept.update(raw[at:])
                rows.append((k1, k2, removed, n, kept.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return spanned.select("k1", "k2", "packed", "spans").mapInArrow(remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, width: int = 200, crowd: int = 20000) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} bytes or more")
    key = ["k1", "k2"]
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    runs = keep(text_runs(texts, width), "strings")
    # A bucket's runs: one, several that are equal, or several of which some differ.
    least = [F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2")]
    buckets = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), *least).where("times > 1")
    # The runs of a bucket are dealt over SALTS parts, as one passage may be in a third of all texts.
    salts, salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.pmod(F.xxhash64("k1", "start"), F.lit(SALTS)).cast("int")
    salted = buckets.select("gram", F.expr("a1 <> b1 or a2 <> b2").alias("mixed"), salts)
    met = keep(runs.withColumn("salt", salt).join(salted, ["gram", "salt"]).drop("salt"), "runs")
    mixed = met.where("mixed")
    spot = F.struct("k1", "k2", "start", "length", "gram")
    distinct = mixed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min(spot).alias("spot"))
    distinct = keep(distinct.select("d1", "d2", "copies", "spot.*"), "contexts")
    spans = met.where("not mixed").select(*key, F.col("start").alias("first"), (F.col("start") + F.col("length") - 1).alias("last"))
    copied = mixed.withColumn("salt", salt).join(distinct.where("copies > 1").select("d1", "d2", salts), ["d1", "d2", "salt"], "left_semi")
    spans = spans.unionAll(copied.select(*key, F.col("start").alias("first"), (F.col("start") + F.col("length") - 1).alias("last")))

    once = keyed(texts.where(F.octet_length("text") >= width)).groupBy(key).agg(F.first("packed").alias("packed"))
    asked = distinct.groupBy(key).agg(F.collect_list(F.struct("start", "length", "gram", "copies")).alias("runs"))
    cut = cut_out(once.join(asked, key), width)
    crowds = distinct.groupBy("gram").count().where(F.col("count") > crowd).select("gram")
    cut = keep(cut.join(crowds.withColumn("crowded", F.lit(True)), "gram", "left"), "bytes")
    spans = spans.unionAll(refined(cut.where("crowded is null"), width)).unionAll(counted(cut.where("crowded"), width))

    held = spans.groupBy(key).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    changed = remaining(once.join(held, key), width)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    half = lambda i: F.conv(F.substring("sha", i, 16), 16, -10).cast("long")
    every = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha"))
    every = every.select("doc_id", "n_bytes", "sha", half(1).alias("k1"), half(17).alias("k2"))
    return every.join(changed, key, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
