"""Selection of the most different items of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import let
from ..scratch import kept


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def unit_vector(v: Column) -> Column:
    """A vector less its mean, of length 1, so that products are correlations; NULL if it holds a NULL or doesn't vary."""
    whole = F.when(F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0), F.transform(v, lambda x: x.cast("double")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    centred = let(whole, lambda a: let(mean(a), lambda m: F.transform(a, lambda x: x - m)))
    return let(centred, lambda a: let(F.sqrt(_dot(a, a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n))))


def farthest_first(items: DataFrame, key: str, order: str, vector: str, most: int = 12) -> DataFrame:
    """``key, rank, order`` of up to ``most`` items of each key, as different as can be.

    The first in order comes first; then again and again the item whose largest correlation with those chosen is
    smallest (the first of equals).  Each item keeps that largest correlation, so a round is one product for each item and one aggregate;
    no pairs are formed.  Rounds are written down, as each reads the one before.  Items with a NULL key or order, and vectors that don't vary, take no part.
    """
    rows = items.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, unit_vector(F.col(vector)).alias("_unit")).where("_unit is not null")
    left = kept(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_near", F.lit(-2.0)), "apart")
    chosen = None
    for rank in range(most):
        picked = left.groupBy(key).agg(F.min(F.struct("_near", order, "_row")).alias("_p"), F.min_by("_unit", F.struct("_near", order, "_row")).alias("_other"))
        picked = kept(picked.select(key, F.lit(rank).alias("rank"), F.col(f"_p.{order}").alias(order), F.col("_p._row").alias("_row"), "_other"), "picked")
        if picked.isEmpty():
            break
        found = picked.select(key, "rank", order)
        chosen = found if chosen is None else chosen.unionAll(found)
        if rank + 1 < most:
            beside = left.join(picked.select(key, F.col("_row").alias("_taken"), "_other"), key).where("_row <> _taken")
            left = kept(beside.select(key, order, "_row", "_unit", F.greatest("_near", _dot(F.col("_unit"), F.col("_other"))).alias("_near")), "apart")
    return chosen if chosen is not None else rows.select(key, F.lit(0).alias("rank"), order)
