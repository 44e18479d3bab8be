"""Which proved rows can be sent: trust between neighbours, runs from typed balances, repeats, date order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .chain import statement


def confirmed_rows(rows: DataFrame) -> DataFrame:
    """Adds ``confirmed``: good itself, checked against a proved balance, and its own balance chained on or the closing met.

    Rows: ``stmt_id, seq, verified, has_notes, is_tax, page_held``, and per statement
    ``opening_confirmed, closing_met, per_line``.  A tax row goes with the row before it.
    """
    good = F.col("verified") & ~F.col("has_notes")
    before = F.coalesce(F.lag("verified").over(statement()), F.col("opening_confirmed"))
    last = F.lead("verified").over(statement()).isNull()
    following = F.when(F.col("per_line"), F.lead("verified").over(statement())).otherwise(F.lead("good").over(statement()))
    d = rows.withColumn("good", good)
    d = d.withColumn("own", F.col("good") & ~F.col("page_held") & before & F.when(last, F.col("closing_met")).otherwise(following))
    tax = F.col("good") & ~F.col("page_held") & F.coalesce(F.lag("own").over(statement()), F.lit(False))
    return d.withColumn("confirmed", F.when(F.col("is_tax"), tax).otherwise(F.col("own"))).drop("good", "own")


def linked_rows(rows: DataFrame) -> DataFrame:
    """Adds ``linked``: in an unbroken run of proved rows from a confirmed opening or back from a met closing; a balance of 0 breaks."""
    link = F.when(F.col("verified") & ~F.coalesce(F.lag("balance").over(statement()) == 0, F.lit(False)), 1).otherwise(0)
    first = F.first("verified").over(statement().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    numbered = rows.withColumn("_link", link).withColumn("_place", F.row_number().over(statement())).withColumn("_inner", F.when(F.col("_place") > 1, F.col("_link")).otherwise(1))
    forward = F.col("opening_confirmed") & first & (F.min("_inner").over(statement().rowsBetween(W.unboundedPreceding, 0)) == 1)
    after = F.min("_link").over(statement().rowsBetween(1, W.unboundedFollowing))
    backward = F.col("closing_met") & (F.coalesce(after, F.lit(1)) == 1)
    return numbered.withColumn("linked", forward | backward).drop("_link", "_place", "_inner")


def dates_backwards(rows: DataFrame) -> DataFrame:
    """Rows dated before the dated row above: ``stmt_id, seq, day, above``."""
    dated = rows.where("day is not null").withColumn("above", F.lag("day").over(statement()))
    return dated.where("day < above").select("stmt_id", "seq", "day", "above")


def doubtful_dates(rows: DataFrame) -> DataFrame:
    """Adds ``too_early`` (before a date above; ``latest_above`` names the latest) and ``too_late`` (after a date below it)."""
    above = F.max("day").over(statement().rowsBetween(W.unboundedPreceding, -1))
    below = F.min("day").over(statement().rowsBetween(1, W.unboundedFollowing))
    dated = rows.where("day is not null").withColumn("latest_above", above).withColumn("earliest_below", below)
    early = F.coalesce(F.col("day") < F.col("latest_above"), F.lit(False))
    return dated.withColumn("too_early", early).withColumn("too_late", ~early & F.coalesce(F.col("earliest_below") < F.col("day"), F.lit(False)))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Lines with the date, amount and balance of an earlier one of the statement, and the first such line."""
    same = W.partitionBy("stmt_id", "day", "amount", "balance").orderBy("seq")
    return lines.withColumn("first_seq", F.first("seq").over(same)).where("first_seq < seq")


def overlapping_pages(lines: DataFrame) -> DataFrame:
    """Pages with a line whose amount and balance stand on an earlier page: ``stmt_id, page, held``."""
    same = W.partitionBy("stmt_id", "amount", "balance").orderBy("page", "seq")
    again = lines.withColumn("again", F.first("page").over(same) != F.col("page"))
    return again.groupBy("stmt_id", "page").agg(F.max("again").alias("held"))


def page_joins(rows: DataFrame) -> DataFrame:
    """First rows of a page that the chain doesn't carry on to: ``stmt_id, page, above``."""
    d = rows.withColumn("above", F.lag("page").over(statement()))
    return d.where("above <> page and not verified").select("stmt_id", "page", "above")


def newest_first(rows: DataFrame) -> DataFrame:
    """stmt_id, newest_first: dates fall more often than they rise, and balances link to the row below more than above."""
    up, down = F.lag("balance").over(statement()), F.lead("balance").over(statement())
    d = rows.withColumn("_day", F.lag("day").over(statement())).withColumn("_up", F.abs(F.col("balance") - up) == F.col("amount")).withColumn("_down", F.abs(F.col("balance") - down) == F.col("amount"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return d.groupBy("stmt_id").agg(
        n(F.col("day") < F.col("_day")).alias("falls"), n(F.col("day") > F.col("_day")).alias("rises"), n(F.col("_down")).alias("links_below"), n(F.col("_up")).alias("links_above")
    ).withColumn("newest_first", (F.col("falls") > F.col("rises")) & (F.col("links_below") > F.col("links_above")))
