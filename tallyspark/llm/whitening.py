"""Embedding whitening from an exact characteristic polynomial.

Vectors become integers x (``scale`` times each component, rounded down).  The fit list holds each distinct x
once: n vectors with sums S.  All of the fit is exact: tasks add integer products, and
``M = n * sum(x x') - S S'`` is n*n times the covariance in integers.

Eigenvalues come from M's characteristic polynomial.  Its bound (a symmetric matrix without negative
eigenvalues has coefficients below ``(1 + trace / d) ** d``) says how many primes are needed; Spark deals the primes to
tasks, each of which reduces M modulo its prime to Hessenberg form and reads the polynomial from it; Chinese
remaindering gives the integer coefficients.  As all roots are real, the sign changes of the polynomial shifted by a
count the roots above a exactly, multiple ones included.  The largest roots are isolated by such counts
and then halved in on, to 2**-128 of the trace.

A component is the null space of ``M - e``: inverse iteration in fixed point of 256 bits (with integers), each
iterate made orthogonal to the components before it, so that roots which coincide get orthonormal components too.

Only numbers bounded by the dimension d reach the driver: d*d sums, and d coefficients for each prime.  Rows are
projected in Arrow functions with d * ``components`` numbers.

Nulls: vectors that are null or hold a null or a value that isn't finite are dropped; a null id stays.  Vectors of another
length than most have (of lengths as frequent, the longer) and empty ones take no part.  Repeated rows
are returned each, and fitted once.  Components without variance (fewer distinct vectors or dimensions than
``components``) aren't returned, so a table without rows, or of one vector, gives none.  Ties: equal eigenvalues have any
orthonormal components of their space, the same for all rows.  A deviation beyond 64 bits is null.
Components so large that ``scale`` times them exceeds 64 bits count as the nearest long.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

LIMB = 30
#: Bits of the trace, and of fixed-point numbers, that roots and components are found to.
ROOT_BITS, POINT_BITS = 128, 256


def integer_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """``vec_id`` and ``x``: the vectors that are whole and finite, as longs."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = rows.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    return whole.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64, copy=False)


def products(x: np.ndarray) -> np.ndarray:
    """``x' x`` of integers, exactly: in doubles or longs where the sums are small enough, else in Python's integers."""
    most = max(int(x.max()), -int(x.min()))
    if most * most * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    if most * most * len(x) < 1 << 63:
        return (x.T @ x).astype(object)
    y = x.astype(object)
    return y.T.dot(y)


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, their sums, and the sums of their products, all exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), d)
                wide = max(int(x.max()), -int(x.min())) * len(x) >= 1 << 63
                n, total, square = n + len(x), total + (x.astype(object) if wide else x).sum(axis=0), square + products(x)
        cells = [n, *total, *square[np.triu_indices(d)]] if n else []
        rows = []
        for cell, value in enumerate(cells):
            sign, value, limb = (-1 if value < 0 else 1), abs(int(value)), 0
            while value:
                rows.append((cell, limb, sign * (value & (1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "limb", "value"])

    sums = fit.mapInArrow(partial, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value"))
    cells = [0] * (1 + d + d * (d + 1) // 2)
    for r in sums.collect():
        cells[r.cell] += r.value << LIMB * r.limb
    square = [[0] * d for _ in range(d)]
    for value, i, j in zip(cells[1 + d :], *np.triu_indices(d)):
        square[i][j] = square[j][i] = value
    return cells[0], cells[1 : 1 + d], square


def primes_below(top: int, count: int) -> list[int]:
    small = np.ones(math.isqrt(top) + 1, bool)
    small[:2] = False
    for i in range(2, math.isqrt(len(small)) + 1):
        if small[i]:
            small[i * i :: i] = False
    small, found = np.flatnonzero(small), []
    while len(found) < count:
        top -= 1
        if np.all(top % small):
            found.append(top)
    return found


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial modulo a prime below 2**31."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k rows and columns
    leading[0, 0] = 1
    for k in range(1, d + 1):
        weights, run = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        leading[k, 1:] = leading[k - 1, :-1]
        leading[k] = (leading[k] - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first; primes are dealt to tasks, remainders put together here."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits = math.ceil(d * math.log2(1 + trace / d)) + 2 if trace < 1 << 1000 else d * trace.bit_length() + 2
    primes = primes_below((1 << 31) - 1, bits // 30 + 1)

    def remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [polynomial_mod(matrix, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "found"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    rows = dealt.mapInArrow(remainders, "p long, found array<long>").collect()
    whole = math.prod(primes)
    out = [0] * (d + 1)
    for r in rows:
        rest = whole // r.p
        unit = rest * pow(rest, -1, r.p)
        for k, value in enumerate(r.found):
            out[k] += value * unit
    out = [v % whole for v in out]
    return [v - whole if 2 * v > whole else v for v in out]


def roots_above(polynomial: list[int], a: int) -> int:
    """Number of roots greater than ``a``, if all roots are real: sign changes of the polynomial of x + a."""
    shifted = list(polynomial)
    for i in range(len(shifted) - 1):
        for k in range(len(shifted) - 2, i - 1, -1):
            shifted[k] += a * shifted[k + 1]
    signs = [v > 0 for v in shifted if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(polynomial: list[int], a: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * a + c
    return total


def largest_roots(polynomial: list[int], count: int, top: int) -> list[int]:
    """The largest roots, of which none is above ``top`` and all are real, each rounded up to an integer.

    Halving by counts ends when an interval holds one root; then the sign at its middle tells the side.
    """
    known: dict[int, int] = {}

    def above(a: int) -> int:
        if a not in known:
            known[a] = roots_above(polynomial, a)
        return known[a]

    found = []
    for j in range(1, count + 1):
        low, high = -1, top
        for a, n in known.items():
            low, high = (max(low, a), high) if n >= j else (low, min(high, a))
        while high - low > 1 and above(low) - above(high) > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) >= j else (low, middle)
        if high - low > 1:
            sign = value_at(polynomial, low) > 0
            while high - low > 1:
                middle = (low + high) // 2
                value = value_at(polynomial, middle)
                low, high = (middle, high) if value and (value > 0) == sign else (low, middle)
        found.append(high)
    return found


def eigenvalues(polynomial: list[int], trace: int, count: int) -> tuple[list[int], int]:
    """The largest eigenvalues in units of ``2**-bits``, and those bits."""
    d = len(polynomial) - 1
    bits = max(0, ROOT_BITS - trace.bit_length())
    finer = [c << bits * (d - k) for k, c in enumerate(polynomial)]
    return largest_roots(finer, min(count, d), trace << bits), bits


def null_vectors(matrix: list[list[int]], values: list[int], bits: int) -> list[list[float]]:
    """Unit eigenvectors for eigenvalues in units of ``2**-bits``, by inverse iteration in fixed point."""
    d, trace, one = len(matrix), sum(matrix[i][i] for i in range(len(matrix))), 1 << POINT_BITS
    whole = np.array([[(v << bits + POINT_BITS) // (trace << bits) for v in row] for row in matrix], object).reshape(d, d)
    found: list[np.ndarray] = []
    for value in values:
        a = whole.copy()
        a[np.diag_indices(d)] -= (value << POINT_BITS) // (trace << bits)
        order = np.arange(d)
        for k in range(d):
            r = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, r]], order[[k, r]] = a[[r, k]], order[[r, k]]
            if not a[k, k]:
                a[k, k] = 1
            a[k + 1 :, k] = (a[k + 1 :, k] << POINT_BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k][:, None] * a[k, k + 1 :]) >> POINT_BITS
        v = np.array([((i + 1) * 2654435761 + len(found) * 40503) % (1 << 32) - (1 << 31) for i in range(d)], object) << POINT_BITS - 32
        for _ in range(4):
            y = v[order]
            for k in range(d):
                y[k + 1 :] -= (a[k + 1 :, k] * y[k]) >> POINT_BITS
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] << POINT_BITS) // a[k, k]
                y[:k] -= (a[:k, k] * y[k]) >> POINT_BITS
            for _ in range(2):
                for u in found:
                    y = y - ((u * (int((u * y).sum()) >> POINT_BITS)) >> POINT_BITS)
            length = math.isqrt(int((y * y).sum())) or 1
            v = (y << POINT_BITS) // length
        found.append(v)
    return [[int(c) / one for c in v] for v in found]


class Whitening:
    """What a fit gives: ``n``, ``sums``, ``components`` (rows of unit vectors), ``values`` (n*n times eigenvalues), ``explained``."""

    def __init__(self, n: int, sums: list[int], components: list[list[float]], values: list[float], explained: list[float]):
        self.n, self.sums, self.components, self.values, self.explained = n, sums, components, values, explained

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` in longs if they fit with room for the sum of their squares, else in Python's integers."""
        most = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.sums))
        wide = most * most * len(self.sums) >= 1 << 63
        x = x.astype(object) if wide else x
        return x * self.n - np.array(self.sums, object if wide else np.int64)

    def project(self, y: np.ndarray) -> np.ndarray:
        return y.astype(np.float64) @ np.array(self.components).T / np.sqrt(np.array(self.values))


def common_length(vectors: DataFrame) -> int:
    row = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def fit(vectors: DataFrame, d: int, components: int) -> tuple[Whitening | None, DataFrame]:
    """The whitening of rows ``x`` of length ``d``, None if none has variance, and the fit list."""
    spark = vectors.sparkSession
    distinct = keep(vectors.distinct(), "fit")
    n, sums, square = moments(distinct, d) if d else (0, [], [])
    matrix = [[n * square[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return None, distinct
    values, bits = eigenvalues(characteristic_polynomial(spark, matrix), trace, components)
    values = [v for v in values if v > 0]
    vectors_of = null_vectors(matrix, values, bits)
    return Whitening(n, sums, vectors_of, [v / (1 << bits) for v in values], [v / (trace << bits) for v in values]), distinct


def identity_error(distinct: DataFrame, white: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the list."""
    d, r = len(white.sums), len(white.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(r), np.zeros((r, r))
        for batch in batches:
            if batch.num_rows:
                w = white.project(white.centred(matrix_of(batch.column(0), d)))
                total, square = total + w.sum(axis=0), square + w.T @ w
        cells = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "value"])

    sums = distinct.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(r + r * r)
    for row in sums.collect():
        cells[row.cell] = row.value
    mean, square = cells[:r] / white.n, cells[r:].reshape(r, r) / white.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(r)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, *, scale: float = 256.0, components: int = 4) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    found = integer_vectors(rows, scale)
    d = common_length(found)
    found = found.where(F.size("x") == d)
    white, distinct = fit(found.select("x"), d, components)
    if white is None:
        return rows.sparkSession.createDataFrame([], OUT)
    error, r = identity_error(distinct, white), len(white.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = white.centred(matrix_of(batch.column(1), d))
            deviation = [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]
            m = len(y)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), r))), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)),
                pa.array(np.full(m * r, white.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), r))),
                pa.array(white.project(y).ravel()), pa.array(np.tile(white.explained, m)), pa.array(np.full(m * r, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return found.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, OUT)
