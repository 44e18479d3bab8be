"""Statements of a bank without a profile: the columns are found from the words' places, then read as any other.

Words: ``doc, page, word, x0, y0, x1, y1, y, text``.  Each step is an aggregate over the one before:
the heading lines, the column of dates below them, columns of money by right edges, the balance (the column that nearly all dated lines
fill), a column of times, and what lies between.  Which amounts are withdrawals isn't guessed: the balance decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import money
from ..scratch import kept
from . import extract, layout, pages

#: How far edges of one column stray, the share of dated lines that have a balance or a time, and how many
#: line spacings a wrapped line may lie below the line before it.
CLUSTER_REACH, BALANCE_SHARE, TIME_SHARE, WRAP_SPACINGS, LINE_REACH = 6.0, 0.9, 0.5, 1.5, 4.0
#: A date and a time as words, two dates that make a period, what announces the opening balance.
DATE_WORD = r"^\d{1,2}[-/]\d{1,2}[-/](?:\d{2}|\d{4})\z"
TIME_WORD = r"^\d{1,2}:\d{2}\z"
PERIOD_PAIR = r"\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})\b"
OPENINGS = ("ยอดยกมา", "ยอดคงเหลือยกมา", "B/F", "BALANCE BROUGHT FORWARD", "Opening Balance")
FAR_RIGHT = 10000.0


def _members(points: DataFrame, key: str, value: str) -> DataFrame:
    """``points`` with the cluster (``cluster, size, mean``) that each one's value belongs to."""
    found = layout.mean_clusters(points, key, value, CLUSTER_REACH).withColumnRenamed("n", "size")
    return points.join(found, key).where(F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")


def _below_headings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words below their page's heading lines, and ``doc, period_text``: the nearest line above the first headings with two dates."""
    paged = lines.withColumn("page_no", F.col("page")).withColumn("page", F.struct("doc", "page_no"))
    bands = pages.header_bands(paged.select("page", "line", "y0", "y1", "text"))
    around = paged.join(bands, "page")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "text"))), lambda w: w["text"]), " ").alias("said")
    above = around.where("line_y < top").groupBy("doc", "page_no", "line", "line_y").agg(said)
    above = above.where(F.size(F.regexp_extract_all("said", F.lit(PERIOD_PAIR), F.lit(0))) >= 2)
    nearest = F.min_by("said", F.struct("page_no", -F.col("line_y"), -F.col("line"))).alias("period_text")
    return around.where("line_y > bottom").drop("top", "bottom", "page").withColumnRenamed("page_no", "page"), above.groupBy("doc").agg(nearest)


def _date_columns(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, date_lo, date_hi, n_dated, reach`` of the fullest column of first dates, and its lines ``doc, page, line``."""
    firsts = data.where(F.col("text").rlike(DATE_WORD)).groupBy("doc", "page", "line", "line_y").agg(F.min(F.struct("x0", "word", "x1")).alias("w"))
    points = firsts.select("doc", "page", "line", "line_y", F.col("w.x0").alias("x0"), F.col("w.x1").alias("x1"))
    ranked = _members(points, "doc", "x0").withColumn("_best", F.max(F.struct("size", -F.col("cluster"))).over(W.partitionBy("doc")))
    dated = ranked.where(F.struct("size", -F.col("cluster")) == F.col("_best"))
    gap = F.col("line_y") - F.lag("line_y").over(W.partitionBy("doc", "page").orderBy("line_y", "line"))
    dated = dated.withColumn("_gap", F.when(gap > LINE_REACH, gap))
    columns = dated.groupBy("doc").agg(
        (F.min("x0") - 1).alias("date_lo"), (F.max("x1") + 1).alias("date_hi"), F.count(F.lit(1)).alias("n_dated"), (F.min("_gap") * WRAP_SPACINGS).alias("reach")
    )
    return columns, dated.select("doc", "page", "line")


def _levelled(lines: DataFrame) -> DataFrame:
    """Adds ``line_y``, the mean of the centres on a line."""
    return lines.repartition("doc").withColumn("line_y", F.avg((F.col("y0") + F.col("y1")) / 2).over(W.partitionBy("doc", "page", "line")))


def layouts(lines: DataFrame) -> DataFrame:
    """``doc, refusal, columns, reach, period_text``, one row per document of words with their ``line``.

    ``refusal`` says why there are no ``columns``: no headings, no dates, no balance that is full enough, no amounts left of it,
    columns that overlap, or no line that brings a balance forward.
    """
    lines = lines if "line_y" in lines.columns else kept(_levelled(lines), "lines")
    data, periods = _below_headings(lines)
    data = kept(data, "below")
    dates, dated = _date_columns(data)
    rows = data.join(dated, ["doc", "page", "line"]).join(dates.select("doc", "date_hi", "n_dated"), "doc").where("x0 > date_hi")
    place = F.struct("page", "line")

    paid = rows.where(money.parse_amount(F.col("text")).isNotNull()).select("doc", "page", "line", "x0", "x1", "n_dated")
    groups = _members(paid, "doc", "x1").groupBy("doc", "cluster").agg(
        F.first("mean").alias("mean"), F.min("x0").alias("lo"), F.max("x1").alias("hi"), (F.count_distinct(place) >= BALANCE_SHARE * F.first("n_dated")).alias("full")
    )
    found = groups.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("mean", "cluster", "lo", "hi", "full"))).alias("groups"))
    found = found.withColumn("balance", F.try_element_at(F.filter("groups", lambda g: g["full"]), F.lit(-1)))
    found = found.withColumn("amounts", F.filter("groups", lambda g: g["cluster"] != F.col("balance.cluster"))).withColumn("last", F.try_element_at("amounts", F.lit(-1)))
    middle = F.when(F.col("last.hi") < F.col("balance.lo"), (F.col("last.hi") + F.col("balance.lo")) / 2).otherwise((F.col("last.mean") + F.col("balance.mean")) / 2)
    found = found.withColumn("split", middle).withColumn("first_lo", F.array_min(F.transform("amounts", lambda g: g["lo"])) - 0.5)

    timed = rows.where(F.col("text").rlike(TIME_WORD)).join(found.select("doc", "first_lo"), "doc").where("x1 < first_lo")
    hours = _members(timed.select("doc", "page", "line", "x0", "x1", "n_dated"), "doc", "x0").groupBy("doc", "cluster").agg(
        F.count_distinct(place).alias("rows"), (F.max("x1") + 1).alias("time_hi"), F.first("n_dated").alias("n_dated")
    )
    hours = hours.groupBy("doc").agg(F.max(F.struct("rows", -F.col("cluster"), "time_hi", "n_dated")).alias("t")).where(F.col("t.rows") >= TIME_SHARE * F.col("t.n_dated")).select("doc", "t.time_hi")

    texts = lines.groupBy("doc", "page", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "text"))), lambda w: w["text"]), " ").alias("said"))
    opened = texts.groupBy("doc").agg(F.bool_or(F.array_max(F.array(*[F.contains("said", F.lit(m)) for m in OPENINGS]))).alias("opened"))
    d = opened.join(data.select("doc").distinct().withColumn("headed", F.lit(True)), "doc", "left")
    for facts in (dates, found, hours, periods):
        d = d.join(facts, "doc", "left")
    refusal = (
        F.when(F.col("headed").isNull(), "no headings").when(F.col("n_dated").isNull(), "no dates").when(F.col("balance").isNull(), "no balance")
        .when((F.size("amounts") == 0) | (F.col("last.mean") > F.col("balance.mean")), "no amounts").when(F.col("first_lo") <= F.col("date_hi"), "columns overlap")
        .when(~F.col("opened"), "no opening")
    )
    text_lo, right = F.coalesce("time_hi", "date_hi"), F.col("balance.hi") + 2
    ranges = [("date", "date_lo", "date_hi"), ("time", "date_hi", "time_hi"), ("description", text_lo, "first_lo"), ("amount", "first_lo", "split"), ("balance", "split", right), ("channel", right, F.lit(FAR_RIGHT))]
    made = [F.struct(F.lit(n).alias("name"), (F.col(a) if isinstance(a, str) else a).alias("lo"), (F.col(b) if isinstance(b, str) else b).alias("hi")) for n, a, b in ranges]
    columns = F.filter(F.array(*made), lambda c: c["hi"].isNotNull())
    return d.select("doc", refusal.alias("refusal"), F.when(refusal.isNull(), columns).alias("columns"), "reach", "period_text")


def transactions(words: DataFrame, today: str) -> DataFrame:
    """Rows of documents whose layout is found, as ``extract.transactions`` gives them, and their ``channel`` text.

    Columns come from ``layouts`` as data.  A page's lines above its headings hold no rows; text wraps from the
    row above while lines without a date or balance follow within the document's ``reach``.
    """
    lines = kept(_levelled(extract.lines_of(words, LINE_REACH)), "words")
    found = layouts(lines).where("refusal is null").select("doc", "columns", "reach")
    placed = layout.to_own_columns(lines, found, "doc")
    cells = extract.cells_of(placed, None, (*extract.FIELDS, "channel"), carried=("reach",))
    brought = "|".join(m.replace("/", r"\/") for m in OPENINGS)
    return extract.transactions(cells, None, 0.0, today, settle=lambda d: layout.wrap_within(d, "reach", F.expr("day is not null or _balance is not null"), ("doc", "page")), brought=f"(?i){brought}", more=("channel",))
