"""Positions to tables: clusters of lines, words to columns, wrapped lines to rows, page fits, patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def gap_clusters(points: DataFrame, key: str, value: str, gap: float, tie: str) -> DataFrame:
    """Adds ``cluster``: a new one wherever the step from the value before exceeds ``gap`` (single linkage)."""
    own = W.partitionBy(key).orderBy(value, tie)
    starts = F.when(F.col(value) - F.lag(value).over(own) > gap, 1).otherwise(0)
    return points.withColumn("_new", starts).withColumn("cluster", F.sum("_new").over(own)).drop("_new")


def mean_clusters(points: DataFrame, key: str, value: str, reach: float) -> DataFrame:
    """``key, cluster, n, mean, low, high``: values in order join the running cluster while within ``reach`` of its mean.

    The mean moves with each value, so this is a fold.  Equal values join together and are counted first.  Values stream
    past in order, and a task holds the open cluster only, so a dense key costs no more than its values.
    """
    values = points.groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    names = [key, "cluster", "n", "mean", "low", "high"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cluster, n, total, low, high, begun = None, 0, 0, 0.0, 0.0, 0.0, False

        def rows_of(closed: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
            kinds = [keys, pa.int32(), pa.int64(), *[pa.float64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in closed], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            closed, keys = [], batch.schema.field(0).type
            for k, v, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if begun and k == at and abs(v - total / n) <= reach:
                    n, total, high = n + m, total + v * m, v
                    continue
                if begun:
                    closed.append((at, cluster, n, total / n, low, high))
                at, cluster, begun = k, cluster + 1 if begun and k == at else 0, True
                n, total, low, high = m, v * m, v, v
            yield rows_of(closed, keys)
        if begun:
            yield rows_of([(at, cluster, n, total / n, low, high)], keys)

    schema = StructType([values.schema[key], *StructType.fromDDL("cluster int, n bigint, mean double, low double, high double")])
    return values.where("v is not null").repartition(key).sortWithinPartitions(key, "v").mapInArrow(fold, schema)


def mean_lines(points: DataFrame, keys: tuple[str, ...], value: str, reach: float) -> DataFrame:
    """Adds ``line``: the place of a row's cluster, as ``mean_clusters`` forms them, among those of its keys.

    Rows must lie in partitions by their keys; they stream past in order and leave with their cluster's number, so nothing is counted or joined.
    Rows without a value are left out.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, last, many, n, total = None, 0, 0.0, 0, 0, 0.0
        for batch in batches:
            lines = []
            for *k, v in zip(*(batch.column(c).to_pylist() for c in (*keys, value))):
                if k != at:
                    at, line, last, many, n, total = k, 0, v, 1, 0, 0.0
                elif v == last or v != v and last != last:
                    many += 1
                else:
                    n, total = n + many, total + last * many
                    if not abs(v - total / n) <= reach:
                        line, n, total = line + 1, 0, 0.0
                    last, many = v, 1
                lines.append(line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int32())], [*batch.schema.names, "line"])

    schema = StructType([*points.schema.fields, *StructType.fromDDL("line int")])
    return points.where(F.col(value).isNotNull()).sortWithinPartitions(*keys, value).mapInArrow(numbered, schema)


#: A column's name, lower end, upper end and place among overlapping ones.
Range = tuple[str, float, float, int]


def to_columns(words: DataFrame, columns: list[Range]) -> DataFrame:
    """Adds ``column``: that whose range holds a word's centre (lower end in, upper end out), NULL outside every range.

    Of overlapping ranges the first by place counts.  A projection: no join, and no word is lost or merged.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    found = [F.when((centre >= lo) & (centre < hi), name) for name, lo, hi, _ in sorted(columns, key=lambda c: c[3])]
    return words.withColumn("column", F.coalesce(*found))


def to_own_columns(words: DataFrame, layouts: DataFrame, key: str) -> DataFrame:
    """The same with a layout for each ``key`` as rows: ``columns``, an array of ``name, lo, hi`` by place.  Keys without one are left out."""
    centre = (F.col("x0") + F.col("x1")) / 2
    own = F.filter("columns", lambda c: (centre >= c["lo"]) & (centre < c["hi"]))
    return words.join(layouts, key).withColumn("column", F.get(own, F.lit(0))["name"]).drop("columns")


def wrap_within(lines: DataFrame, reach: str | float, ends: Column | None = None, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Lines that aren't rows -> the row above them on their page, while each line is within ``reach`` of the line before.

    ``reach`` is a number or a column; a NULL reach bounds nothing.  Lines for which ``ends`` holds are no text of the row above.  Adds ``row_line``.
    """
    own = W.partitionBy(*keys).orderBy("y", "line")
    limit = F.col(reach) if isinstance(reach, str) else F.lit(reach)
    apart = F.coalesce(F.col("y") - F.lag("y").over(own) > limit, F.lit(False))
    ended = F.lit(False) if ends is None else F.coalesce(ends, F.lit(False))
    d = lines.withColumn("_run", F.sum((F.col("is_row") | apart | ended).cast("int")).over(own))
    first = F.first(F.when(F.col("is_row"), F.col("line"))).over(W.partitionBy(*keys, "_run").orderBy("y", "line"))
    return d.withColumn("row_line", first).drop("_run")


def settle_wrapped(lines: DataFrame, reach: float, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Lines that aren't rows -> the nearest row above or below within ``reach``, the upper one on a tie.

    Lines: ``keys`` (a page's), ``line, y, is_row``.  Adds ``row_line`` (NULL: none near enough; a row's own line).
    """
    own = W.partitionBy(*keys).orderBy("y", "line")
    at = F.when(F.col("is_row"), F.struct("y", "line"))
    d = lines.withColumn("_a", F.last(at, ignorenulls=True).over(own)).withColumn("_b", F.first(at, ignorenulls=True).over(own.rowsBetween(0, W.unboundedFollowing)))
    up, down = F.col("y") - F.col("_a.y"), F.col("_b.y") - F.col("y")
    near = F.when(F.col("is_row"), F.col("line")).when((up <= reach) & (F.coalesce(up <= down, F.lit(True))), F.col("_a.line")).when(down <= reach, F.col("_b.line"))
    return d.withColumn("row_line", near).drop("_a", "_b")


def wrap_to_previous(lines: DataFrame) -> DataFrame:
    """Adds ``row_line``: the last row at or above a line on its page."""
    own = W.partitionBy("page").orderBy("y", "line")
    return lines.withColumn("row_line", F.last(F.when(F.col("is_row"), F.col("line")), ignorenulls=True).over(own))


def stop_at_footer(lines: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Lines of each page before its first footer that isn't a row."""
    own = W.partitionBy(*keys).orderBy("y", "line").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("_stop", F.max((F.col("is_footer") & ~F.col("is_row")).cast("int")).over(own)).where("_stop = 0").drop("_stop")


def deskew(points: DataFrame, key: str, most_deg: float = 5.0, steps: int = 201, bin_size: float = 2.0) -> DataFrame:
    """``key, angle``: the turn that gathers the points' heights in fewest bins (largest sum of squares), the middle of equals.

    Angles are a fixed list of ``steps``; each point gives a row for each, summed before the shuffle.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")
    angle = (F.col("k") - (steps - 1) / 2) * (2 * most_deg / (steps - 1))
    turned = points.select(key, "x", "y", at).withColumn("angle", F.round(angle, 6))
    height = F.col("y") * F.cos(F.radians("angle")) - F.col("x") * F.sin(F.radians("angle"))
    counted = turned.groupBy(key, "k", "angle", F.floor(height / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("n")).groupBy(key, "k", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("score"))
    best = W.partitionBy(key)
    return counted.withColumn("top", F.max("score").over(best)).where("score = top").groupBy(key).agg(F.round((F.min("angle") + F.max("angle")) / 2, 6).alias("angle"), F.max("score").alias("score"))


def upper_median(name: str) -> Column:
    """The upper middle of a column's values, as an aggregate over counts of equal values."""
    return F.expr(f"percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY `{name}`)")


def with_upper_median(rows: DataFrame, keys: tuple[str, ...], name: str, value: str) -> DataFrame:
    """Adds ``name``: the ``upper_median`` of ``value`` among rows of the same keys, by their places in a sort instead of a table of values in memory."""
    own = W.partitionBy(*keys)
    d = rows.withColumn("_nth", F.row_number().over(own.orderBy(F.col(value).asc_nulls_last()))).withColumn("_of", F.count(value).over(own))
    return d.withColumn(name, F.max(F.when(F.col("_nth") == F.floor(F.col("_of") / 2) + 1, F.col(value))).over(own)).drop("_nth", "_of")


def correlation(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two arrays of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def best_with_margin(scores: DataFrame, key: str) -> DataFrame:
    """key, best, score, margin over the runner-up (by ``score``, then ``candidate``)."""
    own = W.partitionBy(key).orderBy(F.col("score").desc(), "candidate")
    top = scores.withColumn("r", F.row_number().over(own)).where("r <= 2")
    return top.groupBy(key).agg(
        F.max(F.when(F.col("r") == 1, F.col("candidate"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"),
        (F.max(F.when(F.col("r") == 1, F.col("score"))) - F.max(F.when(F.col("r") == 2, F.col("score")))).alias("margin"),
    )
