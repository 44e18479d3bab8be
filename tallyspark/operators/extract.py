"""Positioned words to proved rows: lines, columns, transactions, wrapped text, opening, chain.

Words: ``doc, page, word, x0, x1, y, text``.  Pages hold a bounded number of words, so a page's lines are
one task's small work; a document's rows follow by page and height.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates, money
from . import layout

#: Fixed value: what a statement calls the balance brought forward.
BROUGHT_FORWARD = r"(?i)b/f|brought forward|ยอดยกมา"


def lines_of(words: DataFrame, reach: float = 4.0) -> DataFrame:
    """Adds ``line``: words whose heights stay within ``reach`` of their line's running mean."""
    return layout.mean_lines(words.withColumn("y", F.col("y").cast("double")).repartition("doc", "page"), ("doc", "page"), "y", reach)


def without_summaries(words: DataFrame, summaries: DataFrame) -> DataFrame:
    """Words of pages that may hold rows: ``summaries`` (``doc, page``) are read for the header alone."""
    return words.join(summaries.select("doc", "page").distinct(), ["doc", "page"], "left_anti")


def line_texts(words: DataFrame, reach: float = 4.0) -> DataFrame:
    """``doc, page, line, text``: each line's words from left to right."""
    return texts_of(lines_of(words, reach))


def texts_of(lines: DataFrame) -> DataFrame:
    """The same of words whose ``line`` is known."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "text"))), lambda w: w["text"]), " ")
    return lines.groupBy("doc", "page", "line").agg(text.alias("text"))


FIELDS = ("date", "description", "amount", "balance")


def cells_of(lines: DataFrame, columns: list[layout.Range] | None, fields: tuple[str, ...] = FIELDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per line: ``doc, page, line, y``, the columns' texts (words left to right), right edge of the amount.

    Without ``columns`` the words name their ``column`` themselves; ``carried`` are columns that a document has once.
    """
    placed = lines if columns is None else layout.to_columns(lines.withColumn("_x0", F.col("x0")), columns)
    words = F.sort_array(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("column", "x0", "word", "text")))).alias("_words")
    # Whole documents meet once; what follows, pages and a document's rows, needs no further exchange.
    d = placed.repartition("doc").groupBy("doc", "page", "line").agg(
        F.avg("y").alias("y"), words, F.max(F.when(F.col("column") == "amount", F.col("x1"))).alias("x1"), *[F.first(c).alias(c) for c in carried]
    )

    def joined(name: str):
        own = F.filter("_words", lambda w: w["column"] == name)
        return F.nullif(F.array_join(F.transform(own, lambda w: w["text"]), " "), F.lit("")).alias(name)

    return d.select("doc", "page", "line", "y", *[joined(n) for n in fields], "x1", *carried)


def transactions(
    cells: DataFrame, footer: str | None, reach: float, today: str, settle: Callable[[DataFrame], DataFrame] | None = None, brought: str = BROUGHT_FORWARD, more: tuple[str, ...] = ()
) -> DataFrame:
    """``doc, seq, page, day, description, amount, x1, balance, opening``: rows with a date and a balance or amount.

    A page ends at its first line that matches ``footer`` and isn't a row; other lines are text wrapped from the nearest
    row within ``reach``, or from that which ``settle`` names; the first line that brings a balance forward (its text has ``brought``) gives
    the opening.  ``more`` are further texts of a row's own line that are kept.
    """
    value = cells.select(
        "*", money.parse_amount(F.col("amount")).alias("_amount"), money.parse_signed(F.col("balance")).alias("_balance"), dates.date_cell(F.col("date"), today)["date"].alias("day")
    )
    said = F.concat_ws(" ", "date", "description", "amount", "balance")
    typed = value.withColumn("brought", F.coalesce(F.col("description").rlike(brought), F.lit(False)))
    typed = typed.withColumn("is_row", F.col("day").isNotNull() & ~F.col("brought") & (F.col("_balance").isNotNull() | F.col("_amount").isNotNull()))
    page = ("doc", "page")
    paged = typed.withColumn("is_footer", said.rlike(footer) if footer else F.lit(False))
    kept = layout.stop_at_footer(paged, page) if footer else paged
    settled = settle(kept) if settle else layout.settle_wrapped(kept, reach, page)
    # A row and the lines that belong to it are one group, balances brought forward are groups of their own: one aggregate, no join.
    row = F.when(F.col("is_row"), F.struct("line", "y", "day", F.col("_amount").alias("amount"), "x1", F.col("_balance").alias("balance"), *more))
    text = F.when(~F.col("brought") & F.col("description").isNotNull(), F.struct("y", "line", "description"))
    grouped = settled.where("brought or row_line is not null").groupBy("doc", "page", "brought", F.when(~F.col("brought"), F.col("row_line")).alias("row_line")).agg(
        F.max(row).alias("r"), F.collect_list(text).alias("_said"), F.min(F.when(F.col("brought"), F.struct("y", "line", "_balance"))).alias("_b")
    )
    opening = F.min(F.when(F.col("brought"), F.struct("page", "_b"))).over(W.partitionBy("doc"))["_b"]["_balance"]
    rows = grouped.withColumn("opening", opening).where("not brought and r is not null")
    seq = F.row_number().over(W.partitionBy("doc").orderBy("page", "r.y", "r.line")).cast("bigint")
    said = F.array_join(F.transform(F.sort_array("_said"), lambda d: d["description"]), " ")
    return rows.select(
        "doc", seq.alias("seq"), "page", "r.day", said.alias("description"), "r.amount", "r.x1", "r.balance", F.coalesce("opening", F.lit(0)).alias("opening"), *[f"r.{c}" for c in more]
    )
