"""Daily roll-up, and its calendar without gaps, balances carried through quiet days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def daily(rows: DataFrame) -> DataFrame:
    """Per account and day: count, flagged, withdrawn, deposited, last known balance."""
    known = F.when(F.col("balance").isNotNull(), F.col("seq"))
    return rows.where("day is not null").groupBy("stmt_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("verified"), 1)).alias("flagged"),
        F.coalesce(F.sum("withdrawal"), F.lit(0)).alias("withdrawn"), F.coalesce(F.sum("deposit"), F.lit(0)).alias("deposited"), F.max_by("balance", known).alias("balance"),
    )


def densify(days: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every day of each account's period; ``accounts``: stmt_id, opening, period_from, period_to.

    Quiet days carry the balance of the last day that has one, or the opening; active days outside
    the period follow it.
    """
    calendar = accounts.select("stmt_id", "opening", "period_from", "period_to", F.explode(F.sequence("period_from", "period_to")).alias("day"))
    inside = calendar.join(days, ["stmt_id", "day"], "left")
    carried = F.last("balance", ignorenulls=True).over(W.partitionBy("stmt_id").orderBy("day"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "flagged", "withdrawn", "deposited")]
    dense = inside.select("stmt_id", "day", *zero, F.coalesce(carried, "opening").alias("balance"), F.lit(False).alias("outside"))
    beyond = days.join(accounts, "stmt_id").where("not (day between period_from and period_to)").select("stmt_id", "day", "n", "flagged", "withdrawn", "deposited", "balance", F.lit(True).alias("outside"))
    return dense.unionByName(beyond)


def grand_total(days: DataFrame) -> DataFrame:
    """The days and a total row with a null day, by rollup."""
    return days.rollup("stmt_id", "day").agg(F.sum("n").alias("n"), F.sum("withdrawn").alias("withdrawn"), F.sum("deposited").alias("deposited")).where("stmt_id is not null")
