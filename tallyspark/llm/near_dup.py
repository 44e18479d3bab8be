"""MinHash near-dedup: multi-index Hamming join of b-bit signatures, exact confirmation, components.

A document's set holds the hashes (64 bits) of its distinct word shingles.  Its
signature has ``SYMBOLS`` symbols of 16 bits from as many minima over the set, split
into ``CHUNKS`` chunks of ``WIDTH``.  Two signatures that differ in at most
``THRESHOLD`` = 2 * CHUNKS - 1 symbols have, by pigeonhole, a chunk with at most one
differing symbol.  That error is enumerated: each chunk is indexed with each one of its
symbols left out, so every pair under the threshold meets in a cell of the index.  Pairs
over it that meet all the same are candidates too: nothing is dropped by distance, so
a pair at similarity 0.8 is missed with a chance of 1.1e-6 only (no chunk with one
error or none).

What candidates go on to is without loss.  Besides its signature a document has
the counts of its set's hashes by bucket (a quarter to half as many buckets as hashes).
The sum of the lesser counts of two documents is never below the size of their
intersection, so a pair whose sum is too small isn't linked.  Every link is
confirmed on the full sets of both texts.

Meetings of many are not expanded into pairs.  Documents with equal sets are one
representative.  In a few rounds, each representative tries the head it meets in most
cells (heads are members of a cell's smallest tree), and confirmed links join trees.
Where different trees still meet, a task takes a block of a cell's members,
compares them inside, and returns the members that have a possible link, never the
pairs.  Their texts are fetched once for each block, the block's task counts all
intersections exactly by an inverted list and returns the links of a spanning forest:
fewer than it has members.  Large cells are split by set size (a pair's sizes are within
a fifth) and then into blocks.

Nulls and texts without words: an empty set, linked with nothing.  A null id: the
row takes part in nothing and is returned with itself as component (null).
Repeated ids: all rows of one id are one document, linked where one of its texts is.
Long texts: words are hashed in slices of 1 MB, and what is held at once is some 40
bytes for each shingle; nothing is cut.  Ties: the smallest id is the component's.
Empty tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_or_empty

SYMBOLS, CHUNKS, WIDTH = 32, 8, 4
#: Signatures that differ in no more symbols are certain to meet.
THRESHOLD = 2 * CHUNKS - 1
#: Rounds in which trees are joined by what is nearest before blocks are compared in full.
ROUNDS = 4
#: Requests for texts up to which they are broadcast (some 40 bytes each, 8 MB in all); more are joined by a shuffle.
FEW = 200_000
#: Members of a block, and shingles of all its members (one member may have more).
BLOCK, BLOCK_SHINGLES = 8192, 1 << 20
#: Members of a star whose sets are compared with one copy of the centre's text.
PART = 32
#: Bytes of a text that are hashed at once, and pairs that are compared at once.
SLICE, PAIRS = 1 << 20, 1 << 18

_odd = np.array([int.from_bytes(blake2b(f"factor {k}".encode(), digest_size=8).digest(), "little") | 1 for k in range(SYMBOLS)], np.uint64)
_add = np.array([int.from_bytes(blake2b(f"offset {k}".encode(), digest_size=8).digest(), "little") for k in range(SYMBOLS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, the same for both cases of a letter; 0 for blanks.
_byte = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED)) | np.uint64(1) << np.uint64(63)
_byte[65:91] = _byte[97:123]
_byte[[9, 10, 11, 12, 13, 32]] = 0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts (bytes and their offsets), and each text's first place among them.

    A word's hash is a sum over its bytes of a number of the byte times a number of the
    place, mod 2^64, spread over all bits.
    """
    values = _byte[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data))
    place -= np.maximum.accumulate(np.where(begins, place, 0))
    place[~inside] = 0
    factor = _factors(0, place.max() + 1)
    lengths = np.add.reduceat(inside.astype(np.uint64), starts)
    return _mix(np.add.reduceat(values * factor[place], starts) + lengths * _GOLDEN), first


def _factors(start: int, stop: int) -> np.ndarray:
    return _mix(np.arange(start, stop, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def _long_text(data: np.ndarray) -> np.ndarray:
    """The words' hashes of one text, taken in slices that end between words; a word beyond a slice is summed in parts."""
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + SLICE)
        if stop < len(data):
            blanks = np.flatnonzero(_byte[data[at:stop]] == 0)
            if len(blanks):
                stop = at + int(blanks[-1]) + 1
            else:
                total = np.zeros(1, np.uint64)
                end = at
                while end < len(data):
                    values = _byte[data[end : end + SLICE]]
                    inside = int(np.argmin(values)) if (values == 0).any() else len(values)
                    total += (values[:inside] * _factors(end - at, end - at + inside)).sum(dtype=np.uint64)
                    end += inside
                    if inside < len(values):
                        break
                out.append(_mix(total + np.array([end - at], np.uint64) * _GOLDEN))
                at = end
                continue
        out.append(_words(data[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, chains of their words' hashes, and each text's first place among them."""
    if len(offsets) == 2 and len(data) > SLICE:
        words = _long_text(data)
        first = np.array([0, len(words)])
    else:
        words, first = _words(data, offsets)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)

    def chained(parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0].copy()
        for p in parts[1:]:
            out *= _GOLDEN
            out ^= out >> np.uint64(32)
            out += p
        return _mix(out + np.uint64(len(parts)))

    n = np.diff(first)
    many = max(0, len(words) - k + 1)
    full = np.arange(many) + k <= np.repeat(first[1:], n)[:many]
    out = chained([words[j : many + j] for j in range(k)])[full] if many else np.zeros(0, np.uint64)
    counts = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = [chained([words[i : i + 1] for i in range(first[d], first[d + 1])])[0] for d in short]
        out = np.insert(out, (np.cumsum(counts) - counts)[short], own)
        counts[short] = 1
    return out, np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of slices of about ``SLICE`` bytes: hashes and each text's first place (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
        high = min(high, len(texts))
        yield _shingle_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)
        low = high


def _distinct(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of symbols for each text; only rows of texts with shingles mean something."""
    out = np.zeros((len(first) - 1, SYMBOLS), "<u2")
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(SYMBOLS):
            out[some, k] = _mix(np.minimum.reduceat(hashes * _odd[k] + _add[k], first[some])) >> np.uint64(48)
    return out


def bucket_counts(distinct: np.ndarray) -> np.ndarray:
    """How many hashes of a set fall in each bucket, a byte each: a power of two of buckets, 64 at least."""
    size = max(64, 1 << max(0, (len(distinct) // 2).bit_length() - 1))
    while True:
        counts = np.bincount((distinct & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if counts.max() <= 255:
            return counts.astype(np.uint8)
        size *= 2


def most_common(counts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections' sizes of pairs i, j of sets with these bucket counts."""
    width = np.array([len(c) for c in counts])
    out = np.zeros(len(i), np.int64)
    least = np.minimum(width[i], width[j])
    for size in np.unique(least):
        at = np.flatnonzero(least == size)
        members, where = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        folded = np.stack([counts[m].reshape(-1, size).sum(axis=0, dtype=np.uint16) for m in members])
        x, y = where[: len(at)], where[len(at) :]
        step = max(1, (1 << 24) // int(size))
        for s in range(0, len(at), step):
            out[at[s : s + step]] = np.minimum(folded[x[s : s + step]], folded[y[s : s + step]]).sum(axis=1, dtype=np.int64)
    return out


def _possible(n: np.ndarray, counts: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs i, j may be linked by what their bucket counts say."""
    both = most_common(counts, i, j)
    return 100 * both >= percent * (n[i] + n[j] - both)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _counts(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint8) for c in column.to_pylist()]


SKETCH = "doc_id long, n_shingles long, digest binary, sign binary, counts binary"


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signs, counts = [], [], [], []
            for hashes, first in shingle_sets(batch.column(1), words):
                own = signatures(hashes, first)
                for i in range(len(own)):
                    s = _distinct(hashes[first[i] : first[i + 1]])
                    sizes.append(len(s))
                    digests.append(blake2b(s, digest_size=16).digest() if len(s) else None)
                    signs.append(own[i].tobytes() if len(s) else None)
                    counts.append(bucket_counts(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, signs, counts))],
                ["doc_id", "n_shingles", "digest", "sign", "counts"],
            )

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, sign -> a row for each index cell: cell, slot (chunk and symbol left out), doc_id."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            signs = _matrix(batch.column(1)).astype(np.uint64)
            keys = np.empty((len(signs), SYMBOLS), np.uint64)
            for slot in range(SYMBOLS):
                c, out = divmod(slot, WIDTH)
                key = np.full(len(signs), slot, np.uint64)
                for j in range(WIDTH):
                    if j != out:
                        key = _mix(key * _GOLDEN + signs[:, c * WIDTH + j])
                keys[:, slot] = key
            slots = np.tile(np.arange(SYMBOLS, dtype=np.int32), len(signs))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(signs)), SYMBOLS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(slots), ids], ["cell", "slot", "doc_id"])


BLOCK_KEY = ["cell", "band", "left_part", "right_part"]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block in turn; batches begin with the four columns of its key, and are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if start == stop:
                continue
            key = tuple(keys[start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _flag_members(percent: int):
    """Rows of blocks (key, slot, part, own, doc_id, n_shingles, sign, counts, tree) -> the members that have a possible link to another tree."""

    def flags(t: pa.Table) -> np.ndarray:
        part, own, n, tree = (np.asarray(t[k]) for k in ("part", "own", "n_shingles", "tree"))
        left, right, slot = (t[k][0].as_py() for k in ("left_part", "right_part", "slot"))
        signs, counts = _matrix(t["sign"]), _counts(t["counts"])
        # In order of size, those with which a member can be linked follow it closely.
        order = np.argsort(n, kind="stable")
        part, own, n, tree, signs, counts = part[order], own[order], n[order], tree[order], signs[order], [counts[k] for k in order]
        stop = np.searchsorted(n, 100 * n // percent, side="right")
        flagged = np.zeros(len(n), bool)
        at = 0
        while at < len(n):
            to = at + 1
            while to < len(n) and (to + 1 - at) * (stop[to] - at) <= PAIRS:
                to += 1
            i, j = np.arange(at, to)[:, None], np.arange(at, stop[to - 1])[None, :]
            fit = (j > i) & (j < stop[i]) & (tree[i] != tree[j]) & (own[i] | own[j]) & ~(flagged[i] & flagged[j])
            if left != right:
                fit &= part[i] != part[j]
            i, j = (x + at for x in np.nonzero(fit))
            if len(i):
                same = (signs[i] == signs[j]).reshape(-1, CHUNKS, WIDTH)
                count = same.sum(axis=2)
                # A pair that meets in several cells is told by the first.
                chunk = (count >= WIDTH - 1).argmax(axis=1)
                row = np.arange(len(i))
                out = np.where(count[row, chunk] == WIDTH, 0, (~same[row, chunk]).argmax(axis=1))
                told = chunk * WIDTH + out == slot
                i, j = i[told], j[told]
                near = _possible(n, counts, i, j, percent)
                flagged[i[near]] = flagged[j[near]] = True
            at = to
        out = np.zeros(len(n), bool)
        out[order] = flagged
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_block(batches):
            found = t.filter(pa.array(flags(t))).select([*BLOCK_KEY, "doc_id", "tree"])
            yield from found.combine_chunks().to_batches()

    return run


def _link_blocks(words: int, percent: int):
    """Rows of blocks (key, doc_id, tree, text) -> links that join trees: a spanning forest of each block's."""

    def links(t: pa.Table) -> tuple[list[int], list[int]]:
        ids, tree = np.asarray(t["doc_id"]), np.asarray(t["tree"])
        _, root = np.unique(tree, return_inverse=True)
        sets = [_distinct(hashes[first[k] : first[k + 1]]) for chunk in t["text"].chunks for hashes, first in shingle_sets(chunk, words) for k in range(len(first) - 1)]
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        # Inverted lists: the members that have each hash.
        members = owner[np.argsort(number, kind="stable")]
        size = np.bincount(number)
        start = np.cumsum(size) - size
        before = np.cumsum(n) - n
        a, b = [], []
        for i in range(len(sets)):
            if (root == root[i]).all():
                break
            own = number[before[i] : before[i] + n[i]]
            many = size[own]
            place = np.arange(int(many.sum())) + np.repeat(start[own] - (np.cumsum(many) - many), many)
            both = np.bincount(members[place], minlength=len(sets))
            for j in np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (both > 0) & (root != root[i])):
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    a.append(int(min(ids[i], ids[j])))
                    b.append(int(max(ids[i], ids[j])))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_block(batches):
            a, b = links(t)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(words: int, percent: int):
    """Rows (a, part, role, b, text), sorted: the centre's text (role 0), then its members'. Yields the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, key = [], None
        for batch in batches:
            a, part, role, b = (batch.column(k).to_pylist() for k in range(4))
            links: list[tuple[int, int]] = []
            i = 0
            for hashes, first in shingle_sets(batch.column(4), words):
                for k in range(len(first) - 1):
                    own = _distinct(hashes[first[k] : first[k + 1]])
                    if key != (a[i], part[i]):
                        key, centres = (a[i], part[i]), []
                    if role[i] == 0:
                        centres.append(own)
                    elif any(_linked(own, c, percent) for c in centres):
                        links.append((a[i], b[i]))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return run


def _confirmed(texts: DataFrame, pairs: DataFrame, words: int, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; texts: doc_id, text, a row each.

    A centre's text goes once to each part of its star, so that no task takes the whole of a large one.
    """
    large = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    parts = F.coalesce(F.ceil(F.col("n") / PART), F.lit(1))
    dealt = keep(pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part")), f"{label}-dealt")
    members = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("role"), "b")
    centres = dealt.select("a", "part").distinct().select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("role"), F.col("a").alias("b"))
    rows = _with_texts(texts, members.unionByName(centres), label).select("a", "part", "role", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return keep(rows.mapInArrow(_confirm(words, percent), "a long, b long"), f"{label}-links")


def _with_texts(texts: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """``wanted`` with the texts of its ``doc_id``: few requests go to the texts, for many both are shuffled."""
    wanted = keep(wanted, f"{label}-wanted")
    return texts.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "doc_id")


def _links_in_blocks(texts: DataFrame, shared: DataFrame, trees: DataFrame, signs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the trees that meet in cells (cell, slot, doc_id), enough to join all that are linked."""
    met = shared.join(trees, "doc_id")
    cells = met.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.min("tree").alias("low"), F.max("tree").alias("high")).where("low < high")
    still = keep(met.join(cells.select("cell", "members"), "cell").join(signs, "doc_id"), "near-still")
    # Set sizes of a pair are in one band or in neighbours: a band's block also takes the next one's members.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    bands = F.when(F.col("members") <= BLOCK, F.array(F.lit(-1))).otherwise(F.array(band, band - 1))
    dealt = still.select("*", F.posexplode(bands).alias("own", "band")).withColumn("own", F.col("own") == 0)
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = dealt.groupBy("cell", "band").agg(F.ceil(weight).cast("int").alias("parts"), F.min("tree").alias("low"), F.max("tree").alias("high"), F.bool_or("own").alias("any"))
    sizes = keep(sizes.where("low < high and any").select("cell", "band", "parts"), "near-sizes")
    member = dealt.join(sizes, ["cell", "band"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    blocks = member.select("*", other).select(
        "cell", "band", F.least("part", "other").alias("left_part"), F.greatest("part", "other").alias("right_part"),
        "slot", "part", "own", "doc_id", "n_shingles", "sign", "counts", "tree",
    )
    kinds = "cell long, band int, left_part int, right_part int, doc_id long, tree long"
    flagged = blocks.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(_flag_members(percent), kinds)
    rows = _with_texts(texts, flagged, "near-flagged").select(*BLOCK_KEY, "doc_id", "tree", "text")
    return keep(rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(_link_blocks(words, percent), "a long, b long"), "near-block-links")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(a, b) links -> (node, root): smallest node reachable, for each node that has a link.

    Each round takes the smallest label of the neighbours and then that label's own
    label, so paths shorten quickly; rounds end when no label changes.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    now = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{label}-labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        taken = keep(now.join(near, now["node"] == near["a"], "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), f"{label}-labels")
        above = taken.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = keep(taken.join(above, "root", "left").select("node", F.least("root", "above").alias("root"), "was"), f"{label}-labels")
        now = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return now


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``words``: length of a shingle.  ``percent``: least similarity of a link, in
    hundredths; the index is laid out for 80 and more.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketches = keep(texts.mapInArrow(_sketches(words), SKETCH), "near-sketches")

    # Equal sets are one representative.
    named = sketches.where("digest is not null and doc_id is not null")
    least = keep(named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sign", "counts")).alias("r")).select("digest", "r.*"), "near-least")
    signs = least.select("doc_id", "n_shingles", "sign", "counts")
    trees = least.select("doc_id", F.col("doc_id").alias("tree")).distinct()

    # Trees are joined by what is nearest: round by round, in the cells where different trees meet.
    cells = signs.select("doc_id", "sign").mapInArrow(_cells, "cell long, slot int, doc_id long")
    seen = cells.withColumn("tree", F.col("doc_id"))
    for number in range(ROUNDS):
        label = f"near-{number}"
        heads = seen.groupBy("cell").agg(F.min(F.struct("tree", F.xxhash64(F.lit(number), "cell", "doc_id").alias("draw"), "doc_id")).alias("head"), F.max("tree").alias("high"))
        heads = heads.where("head.tree < high").select("cell", F.col("head.doc_id").alias("a"), F.col("head.tree").alias("a_tree"))
        mixed = keep(seen.join(keep(heads, f"{label}-heads"), "cell"), f"{label}-mixed")
        # Of a document's heads, the one it meets in most cells; one pair each, whatever the size of a cell.
        met = mixed.where("tree <> a_tree").groupBy(F.col("doc_id").alias("b"), "a").agg(F.count(F.lit(1)).alias("n"))
        nearest = met.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("most"), "a"))["a"].alias("a"))
        side = lambda k: signs.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("counts").alias(f"{k}_counts"))
        tries = (
            nearest.join(side("b"), "b").join(side("a"), "a")
            .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            .select("a", "b", "a_n", "b_n", "a_counts", "b_counts").mapInArrow(_worth(percent), "a long, b long")
        )
        tries = keep(tries, f"{label}-tries")
        shared = mixed.select("cell", "slot", "doc_id")
        if tries.isEmpty():
            break
        trees = _joined(trees, _confirmed(texts, tries, words, percent, label), label)
        seen = shared.join(trees, "doc_id")

    trees = _joined(trees, _links_in_blocks(texts, shared, trees, signs, words, percent), "near-all")

    by_set = keep(least.select("digest", "doc_id").join(trees, "doc_id").select("digest", F.col("tree").alias("component_id")), "near-by-set")
    out = sketches.join(by_set, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(trees: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(doc_id, tree) after the links' trees are one, named by its smallest document."""
    edges = (
        links.join(trees.select(F.col("doc_id").alias("a"), F.col("tree").alias("ra")), "a")
        .join(trees.select(F.col("doc_id").alias("b"), F.col("tree").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    )
    merged = components(edges, label)
    return keep(trees.join(merged, trees["tree"] == merged["node"], "left").select("doc_id", F.coalesce("root", "tree").alias("tree")), f"{label}-trees")


def _worth(percent: int):
    """a, b, a_n, b_n, a_counts, b_counts -> a, b where the bucket counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.concatenate([np.asarray(batch.column(2)), np.asarray(batch.column(3))])
                i = np.arange(batch.num_rows)
                near = pa.array(_possible(n, _counts(batch.column(4)) + _counts(batch.column(5)), i, i + len(i), percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return run
