"""The balance chain: every row proved against the printed running balance, by windows over a statement.

Input rows: ``stmt_id, seq, amount, balance, tax, x1`` (BIGINT minor units; ``x1`` is the right edge
of the printed amount, which tells its column) and ``opening``.  A statement is bounded by what the
readers admit (100,000 rows), so a window over one fits a task; all windows share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..functions.money import fmt_money, sum_text

#: Notes that name no figure, as the reports print them.
NO_BALANCE = "no balance was printed after this row, so it could not be checked against one"
SIDE = "the balance says this is a {}, but it is printed in the {} column - the balance was believed"


def statement() -> WindowSpec:
    """A statement's rows in order."""
    return W.partitionBy("stmt_id").orderBy("seq")


def above() -> WindowSpec:
    """The rows above in the statement."""
    return statement().rowsBetween(W.unboundedPreceding, -1)


def drop_zero_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with ``moves_nothing``: amount 0, no tax, and the balance is the last known one."""
    known = F.coalesce(F.last("balance", ignorenulls=True).over(above()), F.col("opening"))
    idle = (F.col("amount") == 0) & (F.coalesce("tax", F.lit(0)) == 0) & (F.col("balance") == known)
    return rows.withColumn("moves_nothing", F.coalesce(idle, F.lit(False)))


def in_withdrawal_column(x1: Column, split: Column, deposit_first: bool = False) -> Column:
    return x1 >= split if deposit_first else x1 < split


def verify_chain(rows: DataFrame, split: float | None = None, deposit_first: bool = False, keep: bool = False) -> DataFrame:
    """Adds ``running`` (balance before the row's group), ``grp, grp_size, verified, withdrawal, deposit, note, side_note``.

    Rows up to a printed balance are a group.  A single row is proved by the balance's change (less
    its tax); a larger group by its columns' net; rows after the last balance can't be.  Rows
    without an amount take no part in the chain; ``keep`` leaves them, and rows of no statement, among the others, unproved
    and without a note.
    """
    there = F.col("amount").isNotNull() & F.col("stmt_id").isNotNull() if keep else F.lit(True)
    chained = rows if keep else rows.where("amount is not null")
    balance = F.when(there, F.col("balance")) if keep else F.col("balance")
    side = in_withdrawal_column(F.col("x1"), F.lit(split).cast("double"), deposit_first)
    signed = F.when(side, -F.col("amount")).when(~side, F.col("amount"))
    group = W.partitionBy("stmt_id", "grp")
    in_order = group.orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    gap = F.when(signed.isNull() & there, F.col("seq"))
    known = F.max(gap).over(group).isNull()
    d = (
        chained.withColumn("running", F.coalesce(F.last(balance, ignorenulls=True).over(above()), F.col("opening")))
        .withColumn("grp", F.count(balance).over(above()))
        .withColumn("grp_size", F.count("amount").over(group)).withColumn("closing", F.max(balance).over(group))
        .withColumn("first_gap", F.min(gap).over(group))
        .withColumn("net", F.sum(signed).over(group)).withColumn("sides_known", known)
        .withColumn("net_told", F.sum(F.when(F.col("first_gap").isNull() | (F.col("seq") < F.col("first_gap")), signed)).over(group))
        .withColumn("terms", F.count(F.when(F.col("first_gap").isNull() | (F.col("seq") < F.col("first_gap")), signed)).over(in_order))
    )
    single, ended = F.col("grp_size") == 1, F.col("closing").isNotNull()
    delta = F.col("closing") - F.col("running")
    moved = delta + F.coalesce("tax", F.lit(0))
    proved = single & ended & (moved != 0) & (F.abs(moved) == F.col("amount"))
    grouped = there & ~single & ended & F.col("sides_known") & (F.col("net") == delta)
    note = (
        F.when(~there, F.lit(None).cast("string")).when(~ended, NO_BALANCE)
        .when(proved | grouped, F.lit(None).cast("string"))
        .when(single & (delta == 0), F.concat(F.lit("the balance did not change, so whether "), fmt_money(F.col("amount")), F.lit(" went in or out cannot be determined - check this row by hand")))
        .when(single, F.concat(F.lit("balance chain broken: "), fmt_money(F.col("running")), F.lit(" -> "), fmt_money(F.col("closing")), F.lit(" is a change of "), fmt_money(delta), F.lit(", but the amount printed is "), fmt_money(F.col("amount")), F.coalesce(F.concat(F.lit(" (tax "), fmt_money(F.nullif("tax", F.lit(0))), F.lit(")")), F.lit(""))))
        .otherwise(F.concat(F.lit("these "), F.col("grp_size").cast("string"), F.lit(" rows share one printed balance, and they do not add up to it: "), fmt_money(F.col("running")), F.lit(" -> "), fmt_money(F.col("closing")), F.lit(" is a change of "), fmt_money(delta), F.lit(", the rows net "), sum_text(F.col("net_told"), F.col("terms"))))
    )
    withdrawal = F.when((proved & (moved < 0)) | (grouped & side), F.col("amount"))
    deposit = F.when((proved & (moved > 0)) | (grouped & ~side), F.col("amount"))
    d = d.withColumn("verified", F.coalesce(proved | grouped, F.lit(False))).withColumn("withdrawal", withdrawal).withColumn("deposit", deposit).withColumn("note", note)
    actual_out = F.coalesce("withdrawal", F.lit(0)) != 0
    told = there & single & ended & side.isNotNull() & (actual_out | (F.coalesce("deposit", F.lit(0)) != 0)) & (actual_out != side)
    said = F.when(actual_out, SIDE.format("withdrawal", "deposit")).otherwise(SIDE.format("deposit", "withdrawal"))
    return d.withColumn("side_note", F.when(told, said)).drop("first_gap", "net_told", "terms", "sides_known")


def split_tax(proved: DataFrame) -> DataFrame:
    """Each proved row with tax becomes two: itself with the balance before the tax, then the tax as a withdrawal."""
    own = F.struct(
        F.lit(0).alias("part"), "amount", (F.col("balance") + F.when(F.col("taxed"), F.col("tax")).otherwise(0)).alias("balance"), "withdrawal", "deposit", F.lit(False).alias("is_tax")
    )
    tax = F.struct(F.lit(1).alias("part"), F.col("tax").alias("amount"), "balance", F.col("tax").alias("withdrawal"), F.lit(None).cast("bigint").alias("deposit"), F.lit(True).alias("is_tax"))
    taxed = proved.withColumn("taxed", F.col("verified") & (F.coalesce("tax", F.lit(0)) != 0))
    return taxed.select("stmt_id", "seq", "verified", F.explode(F.when(F.col("taxed"), F.array(own, tax)).otherwise(F.array(own))).alias("r")).select("stmt_id", "seq", "verified", "r.*")


def derive_opening(rows: DataFrame) -> DataFrame:
    """stmt_id, opening: worked back from the first row that prints both amount and balance, by its column's side."""
    first = F.min_by(F.struct("amount", "balance", "is_withdrawal"), "seq")
    r = rows.where("amount is not null and balance is not null").groupBy("stmt_id").agg(first.alias("f"))
    return r.select("stmt_id", (F.col("f.balance") + F.when(F.col("f.is_withdrawal"), F.col("f.amount")).otherwise(-F.col("f.amount"))).alias("opening"))
