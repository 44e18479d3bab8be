"""The review workbook of each statement as rows of sheets: what a reader of a proved statement gets to see.

Spark makes the sheets' rows; a writer only puts each account's rows into a file (``sinks.workbooks.sheet_files``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: The sheets and their headings, and what the last one says.
SHEETS = ("Transactions", "Daily", "Proof")
TRANSACTIONS = ("Date", "Time", "Description", "Withdrawal", "Deposit", "Balance", "Channel", "Details", "Check")
DAYS = ("Date", "Transactions", "Withdrawals", "Deposits", "Net change", "Closing balance", "Check")
CHECKED, RULE = "How this file was checked", "The rule every row is tested against"
RULE_TEXT = "this row's balance = last row's balance + deposit - withdrawal"
CELL = "struct<s:string,n:double>"


def _text(v: Column | str) -> Column:
    return F.struct((F.lit(v) if isinstance(v, str) else v).cast("string").alias("s"), F.lit(None).cast("double").alias("n")).cast(CELL)


def _number(v: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("s"), v.cast("double").alias("n")).cast(CELL)


def _money(v: Column) -> Column:
    return _number(v / 100)


def _date(day: Column) -> Column:
    """A real date as its serial number."""
    return _number(dates.excel_serial(day))


def _line(sheet: str, part: int, order: Column, *cells: Column) -> Column:
    return F.struct(F.lit(sheet).alias("sheet"), F.lit(part).alias("part"), order.cast("bigint").alias("place"), F.array(*cells).alias("cells"))


def _sheet(rows: DataFrame, sheet: str, part: int, order: Column, *cells: Column) -> DataFrame:
    return rows.select("stmt_id", _line(sheet, part, order, *cells).alias("line")).select("stmt_id", "line.*")


def sheets(rows: DataFrame, days: DataFrame, accounts: DataFrame, checks: DataFrame) -> DataFrame:
    """``stmt_id, sheet, part, place, cells``: all lines of the three sheets, in order of part and place.

    Rows: ``stmt_id, seq, day, time, description, withdrawal, deposit, balance, channel, details, verified, note``.  Days (see ``daily.densify``):
    ``day, n, flagged, withdrawn, deposited, balance``.  Accounts: ``source, bank, account_name, account_no, branch, opening, closing,
    period_from, period_to, caveat``.  Checks: ``ord, label, passed, detail``.  What isn't known is an empty cell; a quiet day has nothing to check.
    """
    none = _text("")
    zero, heads = F.lit(0), lambda names: [_text(n) for n in names]
    bound = lambda label, day, figure: [_date(F.col(day)), none, _text(label), none, none, _money(F.col(figure)), none, none, none]
    said = F.when(F.col("verified"), "OK").otherwise(F.coalesce("note", F.lit("")))
    line = [_date(F.col("day")), *[_text(F.coalesce(c, F.lit(""))) for c in ("time", "description")], *[_money(F.col(c)) for c in ("withdrawal", "deposit", "balance")], *[_text(F.coalesce(c, F.lit(""))) for c in ("channel", "details")], _text(said)]
    own = [
        _line(SHEETS[0], 0, zero, *heads(TRANSACTIONS)), _line(SHEETS[0], 1, zero, *bound("Opening balance", "period_from", "opening")),
        _line(SHEETS[0], 3, zero, *bound("Closing balance", "period_to", "closing")), _line(SHEETS[1], 0, zero, *heads(DAYS)),
    ]
    flagged = F.when(F.col("n") == 0, "").when(F.col("flagged") > 0, F.concat(F.col("flagged").cast("string"), F.lit(" row(s) flagged"))).otherwise("OK")
    net = F.col("deposited") - F.col("withdrawn")
    day = [_date(F.col("day")), _number(F.col("n")), *[_money(F.col(c)) for c in ("withdrawn", "deposited")], _money(net), _money(F.col("balance")), _text(flagged)]
    sums = days.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("_days"), F.count(F.when(F.col("n") > 0, 1)).alias("_active"), *[F.sum(c).alias(f"_{c}") for c in ("n", "withdrawn", "deposited")]
    )
    spans = _text(F.concat(F.col("_days").cast("string"), F.lit(" days, "), F.col("_active").cast("string"), F.lit(" active")))
    summed = _line(SHEETS[1], 2, zero, spans, _number(F.col("_n")), _money(F.col("_withdrawn")), _money(F.col("_deposited")), _money(F.col("_deposited") - F.col("_withdrawn")), _money(F.col("closing")), none)
    counted = rows.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("_rows"))
    unread = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(not read)"))
    stamp = lambda c: F.coalesce(dates.printed(F.col(c)), F.lit("None"))
    facts = [
        ("Source PDF", F.regexp_extract("source", r"([^/\\]*)\z", 1)), ("Bank", F.col("bank")), ("Account name", unread("account_name")), ("Account number", unread("account_no")), ("Branch", unread("branch")),
        ("Statement period", F.concat(stamp("period_from"), F.lit(" to "), stamp("period_to"))), ("Transactions read", F.coalesce("_rows", F.lit(0)).cast("string")),
    ]
    result = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    own += [
        F.when(F.col("_days").isNotNull(), summed), F.when(F.col("caveat").isNotNull(), _line(SHEETS[2], 0, zero, _text(F.col("caveat")))), _line(SHEETS[2], 1, zero, _text(CHECKED)), _line(SHEETS[2], 2, zero, none),
        *[_line(SHEETS[2], 3, F.lit(i), _text(label), none, _text(value)) for i, (label, value) in enumerate(facts)], _line(SHEETS[2], 4, zero, none),
        _line(SHEETS[2], 5, zero, *heads(("Check", "Result", "Detail"))), _line(SHEETS[2], 7, zero, none), _line(SHEETS[2], 8, zero, _text(RULE)), _line(SHEETS[2], 9, zero, _text(RULE_TEXT)),
    ]
    # An account's own lines are made from one row, so that accounts are read once and not once a line.
    whole = accounts.join(counted, "stmt_id", "left").join(sums, "stmt_id", "left").select("stmt_id", F.explode(F.array_compact(F.array(*own))).alias("line")).select("stmt_id", "line.*")
    for more in (
        _sheet(rows, SHEETS[0], 2, F.col("seq"), *line), _sheet(days, SHEETS[1], 1, dates.excel_serial(F.col("day")), *day),
        _sheet(checks, SHEETS[2], 6, F.col("ord"), _text(F.col("label")), _text(result), _text(F.col("detail"))),
    ):
        whole = whole.unionAll(more)
    return whole
