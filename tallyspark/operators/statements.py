"""Statements from lines and tables, what of them can be sent, and the import files they go to.

Windows span a statement, which the readers bound; everything else is an aggregate or a projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import fmt_comma
from . import chain
from .chain import statement

#: Checks whose failure leaves the other proved lines of a photographed statement safe.
COMPLETENESS = ("Every row agrees with the running balance", "Total withdrawals matches", "Total deposits matches", "Number of withdrawals matches", "Number of deposits matches")


def line_opening(lines: DataFrame) -> DataFrame:
    """Adds ``opening`` and ``opening_derived``: the opening that was read, else worked back from line 1 only, else 0.

    Lines: ``stmt_id, seq, amount, balance, sign, stated_opening``.  A later line would prove itself, so it isn't used.
    """
    own = statement().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c).over(own)
    back = first("balance") - F.when(first("sign") == "-", -first("amount")).otherwise(first("amount"))
    return lines.withColumn("opening_derived", F.col("stated_opening").isNull()).withColumn("opening", F.coalesce("stated_opening", back, F.lit(0)))


def lines_statement(lines: DataFrame) -> DataFrame:
    """Lines that another reader has read, proved: ``verified, withdrawal, deposit, reading, sign_note`` beside the chain's columns.

    Nothing but the balance tells directions; line 1 isn't proved by an opening worked back from it.  ``reading`` says
    what couldn't be read; ``sign_note`` where the source's own sign disagrees.  Lines without an amount stay, unproved.
    """
    d = line_opening(lines).withColumn("tax", F.lit(None).cast("bigint")).withColumn("x1", F.lit(None).cast("double")).withColumn("_place", F.row_number().over(statement()))
    proved = chain.verify_chain(d, keep=True).select("stmt_id", "seq", *[c for c in d.columns if c not in ("stmt_id", "seq")], "verified", "withdrawal", "deposit", "note")
    unproved = F.col("opening_derived") & (F.col("_place") == 1)
    reading = (
        F.when(F.col("amount").isNull() & F.col("balance").isNull(), "nothing on this line could be read").when(F.col("amount").isNull(), "the amount could not be read")
        .when(F.col("balance").isNull(), "the balance could not be read")
    )
    said, real = F.when(F.col("sign") == "-", "withdrawal").otherwise("deposit"), F.when(F.col("withdrawal").isNotNull(), "withdrawal").otherwise("deposit")
    verified = F.coalesce("verified", F.lit(False)) & ~unproved
    disagrees = verified & F.col("sign").isNotNull() & (said != real)
    return proved.withColumn("verified", verified).withColumn("reading", reading).withColumn(
        "sign_note", F.when(disagrees, F.concat(F.lit("shown as a "), said, F.lit(" but the balance says "), real, F.lit(" - check this line")))
    ).drop("_place", "tax", "x1")


def table_zero_lines(lines: DataFrame, label: Callable[[], Column] | None = None) -> DataFrame:
    """Lines of a table that move nothing, with ``dropped``, their label: amount 0, the balance unchanged, the date not in doubt."""
    known = F.coalesce(F.last("balance", ignorenulls=True).over(chain.above()), F.col("opening"))
    idle = (F.col("amount") == 0) & (F.col("balance") == known) & F.col("date_note").isNull()
    said = label() if label else F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), F.col("seq").cast("string"))
    return lines.withColumn("_idle", F.coalesce(idle, F.lit(False))).where("_idle").withColumn("dropped", said).drop("_idle")


def heading_fits(headings: DataFrame) -> DataFrame:
    """Adds ``fits``: whether a later file's heading is one for the columns of the first file of its set.

    Headings: ``set_id, file_no, text, roles`` (a map of roles to columns).  It fits if it repeats the first heading's text,
    or if all that it names sits where the first has it, and that is three roles, or all that the first has.
    """
    own = W.partitionBy("set_id").orderBy("file_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = headings.withColumn("_text", F.first("text").over(own)).withColumn("_roles", F.first("roles").over(own))
    same = F.forall(F.map_entries("roles"), lambda e: F.coalesce(F.try_element_at("_roles", e["key"]) == e["value"], F.lit(False)))
    enough = F.size("roles") >= F.least(F.lit(3), F.size("_roles"))
    return d.withColumn("fits", (F.col("text") == F.col("_text")) | (same & enough)).drop("_text", "_roles")


def warnings(lines: DataFrame) -> DataFrame:
    """``stmt_id, overdraft``: one amount column, no signs and no balance below 0, so an overdrawn stretch couldn't be told."""
    return lines.groupBy("stmt_id").agg((F.bool_and(F.col("sign").isNull()) & F.bool_and(F.col("balance").isNull() | (F.col("balance") >= 0))).alias("overdraft"))


def totals_line(words: DataFrame, split: float) -> DataFrame:
    """``doc, withdraw_total, deposit_total`` of lines with exactly two amounts, told apart by their side of ``split``."""
    out = F.col("x1") < split
    two = words.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(out, F.col("amount"))).alias("withdraw_total"), F.max(F.when(~out, F.col("amount"))).alias("deposit_total"))
    return two.where("n = 2").drop("n")


def partial_rows(check_rows: DataFrame, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Confirmed rows of photographed statements whose failed checks are all of completeness and that nothing contradicts: ``stmt_id, seq``."""
    allowed = F.lit(False)
    for label in COMPLETENESS:
        allowed = allowed | F.col("label").startswith(label)
    failed = check_rows.groupBy("stmt_id").agg(F.bool_or(~F.col("passed")).alias("red"), F.bool_and(F.col("passed") | allowed).alias("safe"))
    able = failed.where("red and safe").join(facts.where("from_photo and not contradicted"), "stmt_id").select("stmt_id")
    return rows.where("confirmed").join(able, "stmt_id", "left_semi").select("stmt_id", "seq")


def import_files(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """One import file for each group (or group and month): its name, rows and totals, or why there is none.

    Rows: ``group_id``, ``withdrawal, deposit`` and the ``keys``; groups: ``group_id, bank, account, name, period_from, period_to``.
    """
    sums = rows.groupBy("group_id", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("withdrawal"), F.lit(0)).alias("withdrawn"), F.coalesce(F.sum("deposit"), F.lit(0)).alias("deposited")
    )
    d = groups.join(sums, "group_id", "left")
    tail = F.when(F.coalesce("account", F.lit("")) != "", F.right(F.regexp_replace("account", "[^0-9xX*]", ""), F.lit(4))).otherwise(F.col("name"))
    ym = lambda c: F.date_format(c, "yyyyMM")
    span = F.coalesce(F.concat(ym("period_from"), F.lit("-"), ym("period_to")), F.lit("period-unknown"))
    span = F.regexp_replace(F.col(keys[0]), "-", "") if keys else span
    file = F.concat_ws("_", F.upper("bank"), tail, span, F.lit("BKTRN.xlsx"))
    empty = F.coalesce("n", F.lit(0)) == 0
    return d.select("group_id", *keys, F.when(~empty, file).alias("file"), F.coalesce("n", F.lit(0)).alias("n"), "withdrawn", "deposited", F.when(empty, F.concat(F.lit("nothing to import - "), F.col("name"), F.lit(": no rows"))).alias("refused"))


def batch_proof(files: DataFrame, statements: DataFrame, caveat: Column | None = None) -> DataFrame:
    """``group_id, ord, label, value``: the key figures of each import file, and before them the caveat of untested layouts.

    Files: ``group_id, n, withdrawn, deposited, untested``; statements: ``group_id, left_out``.
    """
    kept = statements.groupBy("group_id").agg(F.count(F.when(~F.col("left_out"), 1)).alias("kept"))
    row = lambda o, label, value: F.struct(F.lit(o).alias("ord"), F.lit(label).alias("label"), value.alias("value"))
    told = caveat if caveat is not None else F.lit("this layout is untested - check every line")
    rows = F.array(
        F.when(F.col("untested"), row(0, "Caveat", told)), row(1, "Statements in this file", F.coalesce("kept", F.lit(0)).cast("string")), row(2, "Rows in this file", F.col("n").cast("string")),
        row(3, "Withdrawals", fmt_comma(F.coalesce("withdrawn", F.lit(0)))), row(4, "Deposits", fmt_comma(F.coalesce("deposited", F.lit(0)))),
    )
    return files.join(kept, "group_id", "left").select("group_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("group_id", "r.*")


def dense_grid(cells: DataFrame) -> DataFrame:
    """Cells named by letters and a row (``sheet, ref, value``) as whole rows: ``sheet, row, values``, gaps '' and missing rows empty."""
    letters, digits = F.regexp_extract("ref", r"^([A-Z]+)(\d+)\z", 1), F.regexp_extract("ref", r"^([A-Z]+)(\d+)\z", 2)
    number = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1
    placed = cells.select("sheet", digits.cast("int").alias("row"), number.cast("int").alias("col"), "value")
    rows = placed.groupBy("sheet", "row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "value")))).alias("m"), F.max("col").alias("last"))
    whole = rows.select("sheet", "row", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("values"))
    every = rows.groupBy("sheet").agg(F.max("row").alias("n")).select("sheet", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("row"))
    return every.join(whole, ["sheet", "row"], "left").select("sheet", "row", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def set_lights(sheets: DataFrame, *keys: str) -> DataFrame:
    """Tallies of lights (green, yellow, red) and the set's: the worst, never better than yellow."""
    n = lambda s: F.count(F.when(F.col("light") == s, 1)).alias(s)
    d = sheets.groupBy(*keys).agg(n("green"), n("yellow"), n("red"))
    return d.withColumn("light", F.when(F.col("red") > 0, "red").otherwise("yellow"))


def banner(accounts: DataFrame, refusals: DataFrame, *keys: str) -> DataFrame:
    """The batch's summary by ``keys``: accounts, the worst status ('blocked' where there is no account), refusals."""
    worst = F.max_by("status", F.array_position(F.array(*map(F.lit, ("green", "yellow", "partial", "red"))), F.col("status")))
    own = accounts.groupBy(*keys).agg(F.count(F.lit(1)).alias("accounts"), worst.alias("banner"))
    refused = refusals.groupBy(*keys).agg(F.count(F.lit(1)).alias("refusals"))
    d = own.join(refused, list(keys), "full")
    return d.select(*keys, F.coalesce("accounts", F.lit(0)).alias("accounts"), F.coalesce("banner", F.lit("blocked")).alias("banner"), F.coalesce("refusals", F.lit(0)).alias("refusals"))


def fullest_columns(cells: DataFrame, most: int = 2) -> DataFrame:
    """``file, col, n``: the ``most`` columns with amounts in most rows, the leftmost on a tie."""
    n = cells.groupBy("file", "col").agg(F.countDistinct("row").alias("n"))
    own = W.partitionBy("file").orderBy(F.col("n").desc(), "col")
    return n.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most).drop("_r")


def told_reasons(reasons: DataFrame, key: str, most: int = 8) -> DataFrame:
    """``key, said``: the first ``most`` reasons of each key, and how many more there are."""
    own = W.partitionBy(key).orderBy("seq")
    d = reasons.withColumn("_r", F.row_number().over(own)).groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "reason")))).alias("first"), F.count(F.lit(1)).alias("n")
    )
    more = F.when(F.col("n") > most, F.concat(F.lit("; and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return d.select(key, F.concat(F.array_join(F.transform("first", lambda r: r["reason"]), "; "), more).alias("said"))


def best_cluster(clusters: DataFrame, key: str) -> DataFrame:
    """The cluster of each key with most dated lines, then most lines, then the first."""
    own = W.partitionBy(key).orderBy(F.col("dated").desc(), F.col("n").desc(), "cluster")
    return clusters.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def by_profile(profile: Column, value: Column, readers: dict[str, Callable[[Column], Column]]) -> Column:
    """A value read by its profile's own function, as it stands for profiles without one."""
    out = value
    for name, read in readers.items():
        out = F.when(profile == name, read(value)).otherwise(out)
    return out


def score_reading(read: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Per document: cells of the truth, cells read right, and proved rows that are silently wrong.

    Both: the ``keys`` and ``doc, value``; ``read`` also ``proved``.
    """
    d = truth.withColumnRenamed("value", "_true").join(read, ["doc", *keys], "full")
    same = F.coalesce(F.col("value") == F.col("_true"), F.lit(False))
    return d.groupBy("doc").agg(F.count("_true").alias("cells"), F.count(F.when(same, 1)).alias("right"), F.count(F.when(F.col("proved") & ~same, 1)).alias("silently_wrong"))
