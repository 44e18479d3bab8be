"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights.

1. Tasks tokenise whole texts, cut only what is longer than a sequence, and write a
   small row for each piece.
2. The histogram of lengths (at most ``capacity`` rows, whatever the input) comes to
   the driver.  The configuration program - how often to use each multiset of lengths
   that fits a sequence - is solved by multiplicative weights over the true lengths:
   lengths not yet covered weigh more.  Under the weights a knapsack dynamic program over
   the capacity prices every configuration, and the best ones through each length are
   used.  The weights also bound the program from below.
3. ``whole`` rounds along: uses are whole sequences, as many as what is left of each length
   allows.  Of its stops (``STOPS``, shares of the ids left) what remains goes by best fit into
   new sequences, still as counts.  Where that isn't at the bound, ``solve`` finds a fractional
   solution too (lengths in ``CLASSES`` named by their longest, each its own where there are no
   more), which is scaled and rounded.  The fewest sequences win; plain best fit is taken only if it
   beats all of them.
4. Spark numbers the pieces of each length (in salted parts of bounded size) and each
   task looks its pieces' places up in the plan, whose size doesn't grow with the input.

Long texts: encoded in parts of 64 KB, cut where ids don't reach across.  Nulls: a null
text is empty: one piece that holds only the end id.  A null id stays
null.  Repeated rows: each is packed by itself.  Empty tables: no rows.  Ties between
pieces of one length are broken by id, piece and checksum; pieces alike in these may
exchange places.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import keep, text_or_empty
from .tokens import default_ranks, default_vocabulary, encode_ids

#: Pieces of one length that one salted part holds, about, and parts that are numbered together.
PART, PARTS = 128, 4096
#: Classes of lengths in the program, the gap to its bound that ends the rounds, and what a use covers of a class.
CLASSES, GAP, STEP = 64, 0.01, 0.1
#: Shares of the ids left at which best fit may take over, and a configuration's price, of the best one's, below which it waits.
STOPS, NEAR = (0.5, 0.2, 0.05, 0.01, 0.0), 0.999


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, ranks: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut to the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode_ids(text.as_py(), ranks, vocabulary), end])
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if k == 0 else start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most value of a multiset of lengths that fits each capacity, and the length chosen last (0: none); value[l] is that of length l."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        sums = best[c - 1 :: -1] + value[1 : c + 1]  # length l leaves c - l
        k = int(sums.argmax())
        if sums[k] > best[c - 1]:
            best[c], choice[c] = sums[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def chosen(choice: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths behind ``priced``."""
    found: dict[int, int] = {}
    while capacity > 0:
        length = int(choice[capacity])
        if length:
            found[length] = found.get(length, 0) + 1
        capacity -= length or 1
    return found


def best_configuration(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of most value that fits ``capacity``."""
    return chosen(priced(value, capacity)[1], capacity)


#: Groups of equal sequences: the lengths of one, and how many there are.
Groups = list[tuple[tuple[int, ...], int]]


def whole(counts: np.ndarray, capacity: int, rounds: int = 1200) -> tuple[list[tuple[np.ndarray, Groups]], float]:
    """The program over true lengths, its uses rounded to whole sequences as they are priced: (left, groups) at each stop, and the lower bound.

    A length's weight falls by multiplication with the share of its pieces that has a place.  All rounds cost the same,
    whatever the counts; what they leave stays in ``left``.
    """
    left, groups, stops, bound = counts.copy(), {}, [], 0.0
    size = np.arange(capacity + 1)
    total = int(counts @ size)
    due = list(STOPS)
    for _ in range(rounds):
        lengths = np.flatnonzero(left)
        while due and left @ size <= due[0] * total:
            stops.append((left.copy(), _listed(groups)))
            due.pop(0)
        if not len(lengths):
            break
        price = np.zeros(capacity + 1)
        price[lengths] = lengths / capacity * np.exp(left[lengths] / counts[lengths] - 1)
        best, choice = priced(price, capacity)
        bound = max(bound, float(counts @ price) / best[capacity])
        through = price[lengths] + best[capacity - lengths]
        near = lengths[through >= NEAR * through.max()][::-1].tolist()
        used = False
        for length in [int(lengths[-1]), *near]:
            found = chosen(choice, capacity - length)
            found[length] = found.get(length, 0) + 1
            n = min(int(left[m]) // k for m, k in found.items())
            if n:
                _use(found, n, left, groups)
                used = True
        if not used:
            # No priced multiset is left whole: the longest piece with the longest that still fit beside it.
            found, room = {}, capacity
            for m in lengths[::-1].tolist():
                k = min(room // m, int(left[m]))
                if k:
                    found[m], room = k, room - k * m
            _use(found, 1, left, groups)
    stops.append((left, _listed(groups)))
    return stops, bound


def _use(found: dict[int, int], n: int, left: np.ndarray, groups: dict[tuple, int]) -> None:
    for length, k in found.items():
        left[length] -= n * k
    key = tuple(sorted(found.items(), reverse=True))
    groups[key] = groups.get(key, 0) + n


def _listed(groups: dict[tuple, int]) -> Groups:
    return [(tuple(length for length, k in key for _ in range(k)), n) for key, n in groups.items()]


@dataclass
class Program:
    """The program's classes (longest lengths and the lengths' class numbers), its solution, value and lower bound."""

    longest: np.ndarray
    class_of: np.ndarray
    amounts: list[tuple[dict[int, int], float]]
    value: float
    bound: float


def solve(counts: np.ndarray, capacity: int, rounds: int = 400, rate: float = 0.3) -> Program:
    """The configuration program by multiplicative weights; its classes' counts are covered by configurations of their longest lengths."""
    wanted = np.flatnonzero(counts)
    if len(wanted) <= CLASSES:
        last = np.arange(len(wanted))
    else:
        total = np.cumsum(wanted * counts[wanted])
        last = np.unique(np.minimum(np.searchsorted(total, total[-1] * np.arange(1, CLASSES + 1) / CLASSES), len(wanted) - 1))
    longest = wanted[last]
    class_of = np.full(capacity + 1, -1)
    class_of[wanted] = np.searchsorted(longest, wanted)
    need = np.bincount(class_of[wanted], counts[wanted], len(longest))
    place = {int(length): k for k, length in enumerate(longest)}
    covered = np.zeros(len(longest))
    amounts: dict[tuple, float] = {}
    used, value, bound = 0.0, np.inf, 0.0
    for _ in range(rounds):
        price = longest / capacity * np.exp(-rate * (covered - covered.min()))
        prices = np.zeros(capacity + 1)
        prices[longest] = price
        best, choice = priced(prices, capacity)
        bound = max(bound, float(need @ price) / best[capacity])
        near_best = price + best[capacity - longest] >= 0.98 * best[capacity]
        for k in np.argsort(covered, kind="stable"):
            if near_best[k] and covered[k] <= covered.min() + 2:
                found = chosen(choice, capacity - int(longest[k]))
                found[int(longest[k])] = found.get(int(longest[k]), 0) + 1
                x = STEP * min(need[place[length]] / n for length, n in found.items())
                for length, n in found.items():
                    covered[place[length]] += x * n / need[place[length]]
                key = tuple(sorted(found.items(), reverse=True))
                amounts[key] = amounts.get(key, 0.0) + x
                used += x
        if covered.min() > 0:
            value = used / float(covered.min())
        if value <= bound * (1 + GAP):
            break
    least = max(float(covered.min()), 1e-9)
    return Program(longest, class_of, [(dict(k), x / least) for k, x in amounts.items()], value, bound)


def rounded(program: Program, counts: np.ndarray, scale: float) -> tuple[np.ndarray, Groups]:
    """What is left of the counts, and the groups of sequences, after the solution times ``scale`` is rounded and places go to actual lengths."""
    left, groups = counts.copy(), []
    members = [list(np.flatnonzero(program.class_of == k)[::-1]) for k in range(len(program.longest))]
    order = sorted(program.amounts, key=lambda s: (-s[1], sorted(s[0].items())))
    for found, x in order if scale else ():
        n = int(x * scale + 0.5)
        while n:
            # The longest that each class still has, as often as all of them last.
            take: dict[int, int] = {}
            for length, m in found.items():
                own = members[int(program.class_of[length])]
                while own and left[own[0]] == 0:
                    own.pop(0)
                at = 0
                for _ in range(m):
                    while at < len(own) and take.get(int(own[at]), 0) >= left[own[at]]:
                        at += 1
                    if at < len(own):
                        take[int(own[at])] = take.get(int(own[at]), 0) + 1
            if not take:
                break
            times = min([n, *(int(left[length]) // m for length, m in take.items())])
            groups.append((tuple(length for length, m in sorted(take.items(), reverse=True) for _ in range(m)), times))
            for length, m in take.items():
                left[length] -= times * m
            n -= times
    return left, groups


def best_fit(counts: np.ndarray, capacity: int, groups: Groups) -> Groups:
    """Place what remains, longest first, each in the fullest sequence with room; equal sequences go as one group."""
    room: dict[int, Groups] = {}
    for items, n in groups:
        room.setdefault(capacity - sum(items), []).append((items, n))
    open_rooms = np.zeros(capacity + 1, bool)
    open_rooms[list(room)] = True
    for length in np.flatnonzero(counts)[::-1]:
        length, left = int(length), int(counts[length])
        while left:
            fits = np.flatnonzero(open_rooms[length:])
            if not len(fits):
                most = capacity // length
                for n, items in ((left // most, most), (1, left % most)):
                    if n and items:
                        room.setdefault(capacity - items * length, []).append(((length,) * items, n))
                        open_rooms[capacity - items * length] = True
                break
            r = length + int(fits[0])
            items, n = room[r].pop()
            used = min(n, left)
            if used < n:
                room[r].append((items, n - used))
            if not room[r]:
                del room[r]
                open_rooms[r] = False
            room.setdefault(r - length, []).append((items + (length,), used))
            open_rooms[r - length] = True
            left -= used
    return [g for gs in room.values() for g in gs]


def plan(histogram: dict[int, int], capacity: int, rounds: int = 400) -> Groups:
    """Groups (lengths of a sequence, number of such sequences) that hold every piece of the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if not counts.any():
        return []
    stops, bound = whole(counts, capacity, 3 * rounds)
    tries = [best_fit(left, capacity, groups) for left, groups in reversed(stops)]
    if min(map(sequences, tries)) > np.ceil(bound - 1e-6):
        program = solve(counts, capacity, rounds)
        tries += [best_fit(left, capacity, groups) for left, groups in (rounded(program, counts, scale) for scale in (1.0, 0.97, 0.9, 0.7, 0.4))]
        tries.append(best_fit(counts, capacity, []))
    return sorted(min(tries, key=sequences), key=lambda g: (-len(g[0]), g))


def sequences(groups: Groups) -> int:
    return sum(n for _, n in groups)


def places(groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first number) of runs of pieces, the runs' first sequences and their offsets."""
    runs: list[tuple[int, int, int, int]] = []
    base = 0
    for items, n in groups:
        offset = 0
        for length in items:
            runs.append((length, n, base, offset))
            offset += length
        base += n
    runs.sort(key=lambda r: r[0])
    length = np.array([r[0] for r in runs], np.int64)
    n = np.array([r[1] for r in runs], np.int64)
    before = np.cumsum(n) - n
    first = before - before[np.searchsorted(length, length)] if len(runs) else before
    return length << 40 | first, np.array([r[2] for r in runs], np.int64), np.array([r[3] for r in runs], np.int64)


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 0,
    vocabulary: str | None = None,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 400,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, capacity, end_id, vocabulary or default_vocabulary(), ranks or default_ranks(), id_col, text_col), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity, rounds)))

    sizes = spark.createDataFrame([(length, -(-n // PART)) for length, n in histogram.items()], "length long, parts long")
    salted = cut.join(F.broadcast(sizes), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("long"))
    # Parts are numbered in two levels, so that no window takes all parts of a length.
    held = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("part") / PARTS))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    ranges = held.groupBy("length", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("length", "range", F.coalesce(F.sum("n").over(before("length").orderBy("range")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(before("length", "range").orderBy("part")), F.lit(0))
    firsts = held.withColumn("within", within).join(ranges, ["length", "range"]).select("length", "part", (F.col("base") + F.col("within")).alias("first"))
    own = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.join(firsts, ["length", "part"]).withColumn("number", F.col("first") + F.row_number().over(own) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = where.value
        for batch in batches:
            if batch.num_rows:
                own = np.asarray(batch.column(3)) << 40 | np.asarray(batch.column(5))
                at = np.searchsorted(key, own, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(base[at] + own - key[at]), pa.array(offset[at])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
