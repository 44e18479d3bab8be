"""Words as a reader of pictures gives them: pieces of words put together, lines levelled, measures taken from many pages.

Words: ``page, word, x0, y0, x1, y1, text``.  A page's words are bounded, so what depends on the word before is
one page's small work; pages stream past in order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates, words as word_repairs
from ..scratch import kept
from . import layout

#: How far a word's centre may lie from its line's, in heights; Thai text; a Thai date, whole and as it begins.
LINE_HEIGHTS = 0.6
THAI = re.compile(r"[฀-๿]+")
THAI_DATE = re.compile(r"(\d{1,2})-?([ก-๎]{1,3}\.[ก-๎]{1,2}\.?)-?((?:25|20)\d{2})")
DATE_BEGINS = re.compile(r"\d{1,2}-?|\d{1,2}-[ก-๎].*", re.S)
#: Pieces of a date at most; share of a height by which pieces overlap or part at most.
DATE_PIECES, OVERLAP, PARTED = 9, 0.2, 0.35
THAI_MONTHS = [m for m in dates.MONTHS if "." in m]
#: How far above the first transaction headings are looked for, and what may be one.
HEADING_BAND, HEADING_WORD = 45.0, r"^(?!.*\d{3}).{4,}\z"
MONEY_WORD = r"^-?[\d,]+\.\d{2}\z"
DATED_WORD = r"^\d{1,2}[-/]\d{1,2}[-/](?:\d{2}|\d{4})\z|^\d{1,2} [A-Z][a-z]{2}\z"


def reading_order(words: DataFrame) -> DataFrame:
    """Adds ``line`` and ``place``: lines by words' centres (within 0.6 of the page's median height), each from left to right."""
    own = W.partitionBy("page")
    return _lined(words).withColumn("place", F.row_number().over(own.orderBy("line", "x0", "word")))


def _lined(words: DataFrame) -> DataFrame:
    """Adds ``line``; a page's words meet once for their median height and stream on to their lines."""
    sized = layout.with_upper_median(words.where("page is not null").withColumn("_h", F.col("y1") - F.col("y0")).repartition("page"), ("page",), "_m", "_h").drop("_h")
    sized = sized.withColumn("_v", ((F.col("y0") + F.col("y1")) / 2 / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).cast("double")).drop("_m")
    return layout.mean_lines(sized, ("page",), "_v", LINE_HEIGHTS * (1 - 1e-12)).drop("_v")


def level_lines(words: DataFrame) -> DataFrame:
    """Every word of a line gets the line's middle top and bottom: ``page, word, line, x0, y0, x1, y1, text``."""
    lines = _lined(words).repartition("page")
    for name, value in (("_top", "y0"), ("_bottom", "y1")):
        lines = layout.with_upper_median(lines, ("page", "line"), name, value)
    return lines.select("page", "word", "line", "x0", F.col("_top").alias("y0"), "x1", F.col("_bottom").alias("y1"), "text")


def _follows(last: dict, w: dict) -> bool:
    """Whether a Thai piece belongs to the word before it: it stands right behind it, or is a mark over or under it."""
    if not (THAI.fullmatch(last["text"]) and THAI.fullmatch(w["text"])):
        return False
    tall = max(w["y1"] - w["y0"], last["y1"] - last["y0"])
    off, middle = abs(last["y0"] + last["y1"] - w["y0"] - w["y1"]) / 2, (w["x0"] + w["x1"]) / 2
    is_mark = all(unicodedata.category(c).startswith("M") for c in w["text"])
    if is_mark and off < tall and last["x0"] - OVERLAP * tall <= middle <= last["x1"] + OVERLAP * tall:
        return True
    return off < (w["y1"] - w["y0"]) / 2 and -OVERLAP * tall < w["x0"] - last["x1"] < PARTED * tall


def _merged(parts: list[dict], text: str, x1: float) -> dict:
    return {**parts[0], "text": text, "x1": x1, "y0": min(p["y0"] for p in parts), "y1": max(p["y1"] for p in parts)}


def _letters(page: list[dict]) -> list[dict]:
    out: list[dict] = []
    for w in page:
        if out and _follows(out[-1], w):
            out[-1] = _merged([out[-1], w], out[-1]["text"] + w["text"], w["x1"])
        else:
            out.append(w)
    return out


def _month(text: str) -> str | None:
    return next((m for m in (text, f"{text}.") if m in THAI_MONTHS), None)


def _date_at(page: list[dict], i: int, gap: float) -> tuple[int, str] | None:
    """End and text of the longest date whose pieces begin at ``i``: a day, a Thai month and a year, side by side on one line."""
    if not DATE_BEGINS.fullmatch(page[i]["text"]):
        return None
    text, found = page[i]["text"], None
    for j in range(i + 1, min(len(page), i + DATE_PIECES)):
        if page[j]["line"] != page[i]["line"] or page[j]["x0"] - page[j - 1]["x1"] > gap:
            break
        text += page[j]["text"]
        shape = THAI_DATE.fullmatch(text)
        month = _month(shape[2]) if shape else None
        found = (j, f"{shape[1]}-{month}-{shape[3]}") if month else found
    return found


def _dates(page: list[dict], gap: float) -> list[dict]:
    out, i = [], 0
    while i < len(page):
        found = _date_at(page, i, gap)
        end = found[0] if found else i
        parts = page[i : end + 1]
        out.append(_merged(parts, found[1], max(p["x1"] for p in parts)) if found else page[i])
        i = end + 1
    return out


def join_thai(words: DataFrame, gap: float | None = None) -> DataFrame:
    """Words that a reader has cut into letters, put together: ``page, word, x0, y0, x1, y1, text``, each under its first piece.

    With ``gap``, pieces of Thai dates that stand no farther apart are joined first; only where the whole spells a day, a Thai
    month and a year.  NULL texts count as empty.
    """
    names = ["page", "word", "x0", "y0", "x1", "y1", "text"]
    placed = reading_order(words.withColumn("text", F.coalesce("text", F.lit("")))).select(*names, "line", "place")
    schema = placed.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(page: list[dict]) -> pa.RecordBatch:
            joined = _letters(_dates(page, gap) if gap is not None else page)
            return pa.RecordBatch.from_pylist([{n: w[n] for n in names} for w in joined], schema=kinds)

        page: list[dict] = []
        kinds = None
        for batch in batches:
            kinds = pa.schema([batch.schema.field(n) for n in names])
            for w in batch.to_pylist():
                if page and w["page"] != page[0]["page"]:
                    yield done(page)
                    page = []
                page.append(w)
        if page:
            yield done(page)

    return placed.repartition("page").sortWithinPartitions("page", "place").mapInArrow(run, schema)


def tidy_page(words: DataFrame, columns: list[layout.Range], kinds: dict[str, str], gap: float) -> DataFrame:
    """All repairs of a page's words: bars off, dates and letters joined, then money and dates put right in their columns.

    ``kinds`` says which columns hold money or dates.  Adds ``column``.
    """
    parts = F.posexplode(word_repairs.clean_edges(F.coalesce("text", F.lit("")), F.col("x0"), F.col("x1"))).alias("_part", "_w")
    clean = words.select("page", "word", "y0", "y1", parts).select("page", (F.col("word") * 1000 + F.col("_part")).alias("word"), "_w.x0", "y0", "_w.x1", "y1", "_w.text")
    placed = layout.to_columns(join_thai(clean, gap), columns)
    kind = F.coalesce(*[F.when(F.col("column") == c, k) for c, k in kinds.items()], F.lit("text"))
    return placed.withColumn("text", F.coalesce(word_repairs.tidy(F.col("text"), kind), F.col("text")))


def free_reading(fits: Column, symbols: Column) -> Column:
    """The symbol that fits best, whatever the shape of a figure asks for; the first of equals, NULL without fits."""
    return F.try_element_at(symbols, F.array_position(fits, F.array_max(fits)).cast("int"))


def pitch_of(groups: DataFrame, key: str, least: float = 25.0, step: float = 0.02) -> DataFrame:
    """``key, pitch``: the box width by which all groups' widths are nearest to whole numbers of boxes; the smallest of equals.

    Groups: ``key, width, size`` (what the printer's own proportions make a box's width).  Widths of 7 in 100 to either
    side of that are tried.  Equal widths are counted first, so a key costs its distinct widths times the grid.
    Without a group of ``least`` width the pitch is the first that is tried.
    """
    counted = groups.groupBy(key, "size", "width").agg(F.count(F.lit(1)).alias("n"))
    tried = F.transform(F.sequence(F.lit(0), F.floor(F.col("size") * 0.14 / step + 1e-9).cast("int")), lambda i: F.col("size") * 0.93 + i * step)
    boxes = (F.col("width") + 2) / F.col("p")
    d = counted.withColumn("p", F.explode(tried)).withColumn("e", F.when(F.col("width") >= least, F.abs(boxes - F.floor(boxes + 0.5)) * F.col("n")).otherwise(0.0))
    scored = d.groupBy(key, "p").agg(F.sum("e").alias("e"))
    return scored.groupBy(key).agg(F.min(F.struct(F.round("e", 9).alias("e"), "p"))["p"].alias("pitch"))


def anchor_words(lines: DataFrame, support: float = 0.5) -> DataFrame:
    """``bank, text, n, x``: words that stand once above the first transaction on at least ``support`` of a bank's documents, and where.

    Lines: words with ``bank, doc, page, line``.  A transaction is a line with a date and a figure; of each document the first page
    that has one counts.  The result is the dimension that ``lookups.fit_anchors`` takes.
    """
    line, doc = W.partitionBy("doc", "page", "line"), W.partitionBy("doc")
    has = lambda p: F.max(F.col("text").rlike(p)).over(line)
    d = lines.select("bank", "doc", "page", "line", "text", "x0", "y0", "y1").repartition("doc")
    d = d.withColumn("_row", has(DATED_WORD) & has(MONEY_WORD)).withColumn("_ly", F.avg((F.col("y0") + F.col("y1")) / 2).over(line))
    d = d.withColumn("_f", F.min(F.when(F.col("_row"), F.struct("page", "_ly", "line"))).over(doc))
    d = d.withColumn("_top", F.min(F.when((F.col("page") == F.col("_f.page")) & (F.col("line") == F.col("_f.line")), F.col("y0"))).over(doc))
    head = (F.col("page") == F.col("_f.page")) & (F.col("_ly") < F.col("_f._ly")) & (F.col("y0") > F.col("_top") - HEADING_BAND)
    # A document's few heading words in one row, written once: both counts are taken from it.
    each = kept(d.groupBy("bank", "doc").agg(F.collect_list(F.when(head, F.struct("text", "x0"))).alias("_words")), "headings")
    words = each.select("bank", "doc", F.inline("_words")).where(F.col("text").rlike(HEADING_WORD))
    once = words.groupBy("bank", "doc", "text").agg(F.count(F.lit(1)).alias("n"), F.first("x0").alias("x")).where("n = 1")
    docs = each.groupBy("bank").agg(F.count_distinct("doc").alias("docs"))
    found = once.groupBy("bank", "text").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))
    return found.join(docs, "bank").where(F.col("n") >= support * F.col("docs")).select("bank", "text", "n", "x")
