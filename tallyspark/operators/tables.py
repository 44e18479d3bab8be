"""Rows of table files to lines of a statement: what each row is, the bank's own totals at a file's foot, evidence of date order.

Windows span one file, which the readers bound; a set's figures are aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import date_cell
from ..functions.money import let, money_cell
from ..functions.text import squash
from ..scratch import kept as written
from .statements import lines_statement, table_zero_lines
from .trust import newest_first

#: What rows that aren't transactions are called, without blanks and in small letters.
OPENING = "ยอดยกมา|ยกมา|b/f|broughtforward|balanceforward|openingbalance|ยอดคงเหลือยกมา|beginningbalance"
TOTALS = "^(รวม|total|ยอดรวม|grandtotal|sum)"
CARRIED = "ยอดยกไป|ยกไป|c/f|carriedforward|closingbalance|ยอดคงเหลือปลายงวด|endingbalance|summary|สรุป"

AMOUNTS = ("withdrawal", "deposit", "amount", "amount2")


def table_rows(rows: DataFrame, today: str) -> DataFrame:
    """What each row of a table is, and what it says: ``kind, day, amount, sign, balance, note, totals`` beside ``set_id, file_no, row, description``.

    Rows: ``set_id, file_no, row, header`` (the heading's row, -1: none), ``opening`` (known before the file, or null), ``cells`` (all its
    texts) and the texts of the columns ``date, description, withdrawal, deposit, amount, amount2, balance``, null where there is no such column.

    Kinds: heading, above, blank, repeated, totals, text, brought_forward, carried_forward, line.  Brought forward are rows with a balance
    and no amount before any line, if named so, or, where no opening is known yet, if the first of all has no date.  Carried forward is a named row that
    repeats the balance above it; with another balance it is a line.  ``totals`` holds both figures of a line that may be the bank's own totals.
    """
    file = W.partitionBy("set_id", "file_no")
    upto = file.orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    above = file.orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    text = lambda c: F.coalesce(c, F.lit(""))

    d = rows.withColumn("_cells", F.transform("cells", lambda c: squash(text(c)))).withColumn("_date", date_cell(F.col("date"), today))
    d = d.withColumns({f"_{r}": money_cell(F.col(r)) for r in (*AMOUNTS, "balance")})
    d = d.withColumn("_words", F.array_join("_cells", " ")).withColumn("_all", F.array_join("_cells", "|"))
    blank, cents = lambda r: F.col(f"_{r}.blank"), lambda r: F.col(f"_{r}.cents")
    no_date, no_amount, some = F.trim(text(F.col("date"))) == "", F.lit(True), F.lit(False)
    for r in AMOUNTS:
        no_amount, some = no_amount & blank(r), some | cents(r).isNotNull()

    named = lambda p: F.col("_words").rlike(p)
    summary = named(OPENING) | named(CARRIED) | F.exists("_cells", lambda c: c.rlike(TOTALS))
    first = text(F.get(F.filter("_cells", lambda c: c != ""), 0))
    total = blank("balance") & (squash(text(F.col("description"))).rlike(TOTALS) | (first.rlike(TOTALS) & F.col("_date.date").isNull()))
    heading = F.max(F.when(F.col("row") == F.col("header"), F.col("_all"))).over(file)
    d = d.withColumn(
        "_kind",
        F.when(F.col("row") == F.col("header"), "heading")
        .when((F.col("row") < F.col("header")) & ~(~summary & F.col("_date.date").isNotNull() & cents("balance").isNotNull() & some), "above")
        .when(F.forall("_cells", lambda c: c == ""), "blank").when(F.col("_all") == heading, "repeated").when(total, "totals")
        .when(no_amount & blank("balance") & no_date, "text").otherwise("line"),
    )

    line = F.col("_kind") == "line"
    d = d.withColumn("balance", F.when(F.col("_balance.sign") == "-", -cents("balance")).otherwise(cents("balance")))
    d = d.withColumn("_nth", F.sum(line.cast("int")).over(upto))
    begins = line & no_amount & F.col("balance").isNotNull() & (named(OPENING) | (no_date & F.col("opening").isNull() & (F.col("_nth") == 1)))
    d = d.withColumn("_begins", begins).withColumn("_begun", F.max(line & ~F.col("_begins")).over(upto))
    d = d.withColumn("_kind", F.when(F.col("_begins") & ~F.col("_begun"), "brought_forward").otherwise(F.col("_kind")))
    same = F.last(F.when(line, F.struct("balance")), ignorenulls=True).over(above)["balance"] == F.col("balance")
    carried = line & no_amount & no_date & named(CARRIED) & F.coalesce(same, F.lit(False))
    d = d.withColumn("kind", F.when(carried, "carried_forward").otherwise(F.col("_kind")))

    # One signed amount column: once it shows a minus, a figure without one is money in.
    signed = F.coalesce(F.max((F.col("row") > F.col("header")) & (F.col("_amount.sign") == "-")).over(file), F.lit(False))
    side = {"withdrawal": F.lit("-"), "deposit": F.lit("+"), "amount": F.coalesce("_amount.sign", F.when(signed, "+")), "amount2": F.col("_amount2.sign")}
    filled = F.filter(F.array(*(F.struct(blank(r).alias("blank"), cents(r).alias("cents"), F.col(f"_{r}.bad").alias("bad"), side[r].alias("sign")) for r in AMOUNTS)), lambda x: ~x["blank"])
    is_line = F.col("kind") == "line"

    def read(x):
        several = (F.size(x) > 1) & ~((F.size(x) == 2) & F.exists(x, lambda y: F.coalesce(y["cents"] == 0, F.lit(False))))
        one = F.coalesce(F.get(F.filter(x, lambda y: y["cents"].isNull() | (y["cents"] != 0)), 0), F.get(x, 0))
        return F.struct(several.alias("several"), F.when(~several, one).alias("one"))

    d = d.withColumn("_read", F.when(is_line, let(filled, read)))
    quoted = lambda bad, what: F.concat(F.lit('"'), bad, F.lit(f'" could not be read as {what}'))
    note = F.concat_ws("; ", F.when(F.col("_read.several"), "more than one amount on this line - check it"), quoted(F.col("_read.one.bad"), "an amount"), quoted(F.col("_balance.bad"), "a balance"))
    readable = lambda r: blank(r) | cents(r).isNotNull()
    own_totals = is_line & no_date & blank("balance") & ~(blank("withdrawal") & blank("deposit")) & blank("amount") & blank("amount2") & readable("withdrawal") & readable("deposit")
    return d.select(
        "set_id", "file_no", "row", "description", "kind", F.when(is_line, F.col("_date.date")).alias("day"), F.col("_read.one.cents").alias("amount"),
        F.when(F.col("_read.one.cents").isNotNull(), F.col("_read.one.sign")).alias("sign"), "balance", F.when(is_line & (note != ""), note).alias("note"),
        F.when(own_totals, F.struct(F.coalesce(cents("withdrawal"), F.lit(0)).alias("withdrawn"), F.coalesce(cents("deposit"), F.lit(0)).alias("deposited"))).alias("totals"),
    )


def table_lines(classified: DataFrame) -> DataFrame:
    """The lines among the rows of ``table_rows``, each with the text rows under it joined to its description."""
    own = W.partitionBy("set_id", "file_no").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = classified.withColumn("_line", F.count(F.when(F.col("kind") == "line", 1)).over(own)).where("_line > 0 and kind in ('line', 'text')")
    said = F.transform(F.sort_array(F.collect_list(F.struct("row", F.trim("description").alias("t")))), lambda x: x["t"])
    kept = F.struct("row", "day", "amount", "sign", "balance", "note", "totals")
    lines = d.groupBy("set_id", "file_no", "_line").agg(F.min(F.when(F.col("kind") == "line", kept)).alias("l"), said.alias("_said"))
    return lines.select("set_id", "file_no", "l.*", F.array_join(F.filter("_said", lambda t: t != ""), " ").alias("description"))


def foot_totals(lines: DataFrame) -> DataFrame:
    """Files whose last line is the bank's own totals: ``set_id, file_no, row, withdrawn, deposited``.

    It is, if both figures are exactly what the lines above it add up to; otherwise it stays a line.
    """
    side = lambda s: F.coalesce(F.sum(F.when(F.col("sign") == s, F.col("amount"))), F.lit(0))
    last = F.max(F.struct("row", "totals", "sign", "amount")).alias("last")
    d = lines.groupBy("set_id", "file_no").agg(F.count(F.lit(1)).alias("n"), last, side("-").alias("out"), side("+").alias("into")).where("n > 1 and last.totals is not null")
    own = lambda s: F.when(F.col("last.sign") == s, F.coalesce("last.amount", F.lit(0))).otherwise(0)
    d = d.where((F.col("out") - F.coalesce(own("-"), F.lit(0)) == F.col("last.totals.withdrawn")) & (F.col("into") - F.coalesce(own("+"), F.lit(0)) == F.col("last.totals.deposited")))
    return d.select("set_id", "file_no", F.col("last.row").alias("row"), "last.totals.*")


def carried_order(pages: DataFrame) -> DataFrame:
    """Adds ``day_first``: a page's own ``evidence`` of the order of its dates ('day' or 'month'), else that of the nearest page before it.

    Pages: ``set_id, page, evidence``.  Without any so far the order isn't known to be day first.
    """
    own = W.partitionBy("set_id").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages.withColumn("day_first", F.coalesce(F.last("evidence", ignorenulls=True).over(own) == "day", F.lit(False)))


def table_statement(rows: DataFrame, today: str) -> DataFrame:
    """Several table files of one account as one proved statement; rows as in ``table_rows``, ``set_id`` is the account.

    Rows get their kinds, a file's own totals at its foot go, the first balance brought forward opens the statement, files that run newest
    first are turned round, lines that move nothing are left out, and the balance proves the rest.  Files follow one another by number.
    """
    classified = written(table_rows(rows, today), "classified")
    lines = written(table_lines(classified), "lines")
    lines = lines.join(foot_totals(lines).select("set_id", "file_no", "row"), ["set_id", "file_no", "row"], "left_anti")
    opened = classified.where("kind = 'brought_forward'").groupBy("set_id").agg(F.min_by("balance", F.struct("file_no", "row")).alias("stated_opening"))
    own = W.partitionBy("stmt_id")
    d = lines.join(opened, "set_id", "left").withColumnRenamed("set_id", "stmt_id").withColumn("seq", F.row_number().over(own.orderBy("file_no", "row")).cast("long"))
    turned = newest_first(d.select("stmt_id", "seq", "day", "amount", "balance")).select("stmt_id", "newest_first")
    place = F.when(F.col("newest_first"), -F.col("seq")).otherwise(F.col("seq"))
    d = written(d.join(turned, "stmt_id").withColumn("seq", F.row_number().over(own.orderBy(place)).cast("long")).drop("newest_first"), "ordered")
    undated = F.when(F.col("day").isNull(), "no date")
    idle = table_zero_lines(d.select("stmt_id", "seq", "day", "amount", "balance", F.col("stated_opening").alias("opening"), undated.alias("date_note")))
    return lines_statement(d.join(idle.select("stmt_id", "seq"), ["stmt_id", "seq"], "left_anti"))
