"""Control totals, the ordered list of checks of a statement, and its status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import fmt_money, sum_text
from .chain import statement

#: Statuses, best first.
STATUSES = ("green", "yellow", "partial", "red")


def totals(rows: DataFrame) -> DataFrame:
    """One row per statement: sums and counts by direction (tax apart), proved rows, dates out of order, closing."""
    d = rows.withColumn("_above", F.lag("day").over(statement()))
    for name in ("period_from", "period_to"):
        d = d if name in rows.columns else d.withColumn(name, F.lit(None).cast("date"))
    own = ~F.col("is_tax")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")

    def listed(condition, said):
        """Texts of the rows that it holds for, in order."""
        entries = F.sort_array(F.collect_list(F.when(condition, F.struct("seq", said.alias("said")))))
        return F.nullif(F.array_join(F.transform(entries, lambda e: e["said"]), "; "), F.lit(""))

    figure = F.coalesce(F.nullif("withdrawal", F.lit(0)), F.nullif("deposit", F.lit(0)), "amount") if "amount" in rows.columns else F.coalesce("withdrawal", "deposit")
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("verified")).alias("verified_rows"), n(F.col("day") < F.col("_above")).alias("backwards"),
        F.coalesce(F.sum(F.when(own, F.col("withdrawal"))), F.lit(0)).alias("withdrawn"), n(own & F.col("withdrawal").isNotNull()).alias("withdrawals"),
        F.coalesce(F.sum("deposit"), F.lit(0)).alias("deposited"), n(F.col("deposit").isNotNull()).alias("deposits"),
        F.coalesce(F.sum(F.when(F.col("is_tax"), F.col("withdrawal"))), F.lit(0)).alias("tax"), n(F.col("is_tax")).alias("tax_rows"),
        F.max_by(F.when(F.col("balance").isNotNull(), F.col("balance")), F.when(F.col("balance").isNotNull(), F.col("seq"))).alias("closing"),
        n(F.col("verified") & F.col("has_notes")).alias("anomalies"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        listed(F.col("day") < F.col("_above"), F.concat(day("day"), F.lit(" comes after "), day("_above"))).alias("backwards_said"),
        listed(~F.col("day").between(F.col("period_from"), F.col("period_to")), F.concat_ws(" ", day("day"), F.coalesce(fmt_money(figure), F.lit("None")))).alias("outside_said"),
        F.max("period_from").alias("period_from"), F.max("period_to").alias("period_to"),
    )


def checks(statement_totals: DataFrame, facts: DataFrame) -> DataFrame:
    """``stmt_id, ord, label, passed, detail``: only checks whose printed figure is known; ``facts`` holds those figures.

    Labels and details are what reports print.  ``facts`` may also hold ``opening_derived, opening`` and ``zero_lines``
    (how many lines of 0.00 were left out).
    """
    d = statement_totals.join(facts, "stmt_id", "left")
    for name, kind in (("opening_derived", "boolean"), ("opening", "bigint"), ("zero_lines", "int")):
        d = d if name in d.columns else d.withColumn(name, F.lit(None).cast(kind))

    def row(ord_: int, label: str, shown, passed, detail):
        return F.when(shown, F.struct(F.lit(ord_).alias("ord"), F.lit(label).alias("label"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail")))

    known = lambda c: F.col(c).isNotNull()
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    count = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    unproved = F.col("rows") - F.col("verified_rows")
    zeros = F.coalesce("zero_lines", F.lit(0))

    def counted(ord_: int, side: str, found: str, printed: str):
        """A bank may count its lines of 0.00 among its items."""
        with_zeros = (zeros > 0) & (F.col(found) != F.col(printed)) & (F.col(found) + zeros == F.col(printed))
        detail = text("found ", count(found), F.when(with_zeros, text(" + ", count(zeros), " line(s) of 0.00")).otherwise(""), " vs printed ", count(printed))
        return row(ord_, f"Number of {side} matches the bank's own count", known(printed), (F.col(found) == F.col(printed)) | with_zeros, detail)

    def summed(ord_: int, side: str, total: str, n: str, printed: str):
        return row(ord_, f"Total {side} matches the bank's own total", known(printed), F.col(total) == F.col(printed), text("computed ", sum_text(F.col(total), F.col(n)), " vs printed ", fmt_money(F.col(printed))))

    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    head = F.when(F.datediff("first_day", "period_from") >= 28, text("no lines ", day("period_from"), " to ", day(F.date_sub("first_day", 1))))
    tail = F.when(F.datediff("period_to", "last_day") >= 28, text("no lines ", day(F.date_add("last_day", 1)), " to ", day("period_to")))
    confirmed = F.when(known("withdraw_total") | known("deposit_total"), "confirmed only through the totals checks above").otherwise("the bank printed no totals to confirm it - the balance chain proves every line after the first")
    all_ = F.array(
        row(1, "Every row agrees with the running balance", F.lit(True), unproved == 0, text(count("verified_rows"), " of ", count("rows"), " rows verified", F.when(unproved > 0, text("; ", count(unproved), " could not be")).otherwise(""))),
        row(2, "Dates never go backwards", F.lit(True), F.col("backwards") == 0, F.coalesce("backwards_said", F.lit("in order"))),
        row(3, "Final balance matches the closing balance the bank printed", known("closing_stated"), F.col("closing") == F.col("closing_stated"), text("computed ", F.coalesce(fmt_money(F.col("closing")), F.lit("none")), " vs printed ", fmt_money(F.col("closing_stated")))),
        summed(4, "withdrawals", "withdrawn", "withdrawals", "withdraw_total"), counted(5, "withdrawals", "withdrawals", "withdraw_count"),
        summed(6, "deposits", "deposited", "deposits", "deposit_total"), counted(7, "deposits", "deposits", "deposit_count"),
        row(8, "Tax the bank withheld, written as its own withdrawal rows", F.col("tax_rows") > 0, F.lit(True), text(count("tax_rows"), " row(s), total ", fmt_money(F.col("tax")))),
        row(9, "Opening balance (not printed by the bank) worked back from row 1", F.coalesce("opening_derived", F.lit(False)), F.lit(True), text(fmt_money(F.coalesce("opening", F.lit(0))), "; ", confirmed)),
        row(10, "Rows dated outside the statement period (allowed, listed)", known("outside_said"), F.lit(True), F.col("outside_said")),
        row(11, "A month or more of the statement period has no lines (allowed, listed)", head.isNotNull() | tail.isNotNull(), F.lit(True), text(F.concat_ws("; ", head, tail), " - if the account was used then, this file may be cut short")),
        row(12, "Lines of 0.00 left out - nothing to post (allowed, listed)", zeros > 0, F.lit(True), text(count(zeros), " line(s)")),
        row(13, "No other anomalies on any row", F.lit(True), F.col("anomalies") == 0, F.when(F.col("anomalies") > 0, text(count("anomalies"), " row(s) carry a warning")).otherwise("clean")),
    )
    return d.select("stmt_id", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("c")).select("stmt_id", "c.*")


def status(check_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """stmt_id, status: red if a check fails; green needs a figure that the bank printed; photos and untested layouts stay yellow."""
    ok = check_rows.groupBy("stmt_id").agg(F.bool_and("passed").alias("ok"))
    anchored = F.coalesce("closing_stated", "withdraw_total", "deposit_total", "withdraw_count", "deposit_count").isNotNull()
    return ok.join(facts, "stmt_id", "left").select(
        "stmt_id", "ok",
        F.when(~F.col("ok"), "red").when(F.coalesce("from_photo", F.lit(False)) | F.coalesce("untested", F.lit(False)), "yellow").when(anchored, "green").otherwise("yellow").alias("status"),
    )


def rank(c):
    return F.array_position(F.array(*map(F.lit, STATUSES)), c)


def worst(rows: DataFrame, *keys: str) -> DataFrame:
    """The worst status of each group, and how many of each there are."""
    return rows.groupBy(*keys).agg(
        F.max_by("status", rank(F.col("status"))).alias("worst"), F.count(F.lit(1)).alias("statements"), F.count(F.when(F.col("status") == "green", 1)).alias("green"), F.count(F.when(F.col("status") == "red", 1)).alias("red")
    )


def outside_period(rows: DataFrame) -> DataFrame:
    return rows.where("day is not null and not (day between period_from and period_to)")


def empty_ends(rows: DataFrame, days: int = 28) -> DataFrame:
    """Statements whose period has ``days`` or more without lines at an end: stmt_id, first_day, last_day, empty_head, empty_tail."""
    d = rows.where("day is not null").groupBy("stmt_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.first("period_from").alias("period_from"), F.first("period_to").alias("period_to"))
    d = d.withColumn("empty_head", F.datediff("first_day", "period_from") >= days).withColumn("empty_tail", F.datediff("period_to", "last_day") >= days)
    return d.where("empty_head or empty_tail")
