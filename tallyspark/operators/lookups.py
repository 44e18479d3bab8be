"""Join-shaped lookups of statements: legends, labels and their values, anchors, totals, matches, hints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.words import bare


def legend(texts: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """Code-name pairs printed in a text: ``keys, code, name``; the first definition of a code counts.

    ``pattern`` has two groups: code and name.
    """
    codes, names = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2))
    pairs = texts.select(*keys, F.posexplode(F.arrays_zip(codes.alias("code"), names.alias("name"))).alias("at", "p")).select(*keys, "at", "p.code", "p.name")
    return pairs.groupBy(*keys, "code").agg(F.min_by("name", "at").alias("name"))


def with_legend(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Blank ``details`` are filled with the legend's name of ``code``."""
    joined = rows.join(names, [*keys, "code"], "left")
    return joined.withColumn("details", F.coalesce(F.nullif(F.trim("details"), F.lit("")), "name")).drop("name")


def after_mark(words: DataFrame, is_mark: Column, most_gap: float = 40.0) -> DataFrame:
    """``page, line, value``: the words right of a line's last mark, up to the first gap wider than ``most_gap``."""
    own = W.partitionBy("page", "line").orderBy("x0", "word")
    d = words.withColumn("_mark", F.max(F.when(is_mark, F.col("x1"))).over(W.partitionBy("page", "line")))
    d = d.where("x0 >= _mark").withColumn("_gap", F.col("x0") - F.coalesce(F.lag("x1").over(own), F.col("_mark")))
    d = d.withColumn("_broken", F.max((F.col("_gap") > most_gap).cast("int")).over(own)).where("_broken = 0")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "text"))), lambda w: w["text"])
    return d.groupBy("page", "line").agg(F.array_join(ordered, " ").alias("value"))


def _cells(v: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.nan_to_num(v / cell), -(2.0**52), 2.0**52)).astype(np.int64)


def _touching(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a word and a word that touches it on its right, in order of the word, then from left to right.  ``page`` are running numbers, -1 for none."""
    n, h, yc = len(page), y1 - y0, (y0 + y1) / 2
    tall = np.full(page.max() + 2, 1.0)
    np.maximum.at(tall, page, np.nan_to_num(h, nan=0.0))
    cell = tall[page]
    held = np.flatnonzero(np.isfinite(x0 + yc + h) & (page >= 0))
    asked = np.flatnonzero(np.isfinite(x1 + yc + h) & (page >= 0))
    mixed = lambda g, x, y: g * 0x9E3779B97F4A7 + y * 0x1000003 + x
    hx, hy = _cells(x0, cell), _cells(yc, cell)
    keys = mixed(page[held], hx[held], hy[held])
    order = np.argsort(keys, kind="stable")
    held, keys = held[order], keys[order]
    left, right, low, high = _cells(x1 - 0.2 * cell, cell), _cells(x1 + 0.5 * cell, cell), _cells(yc - 0.3 * cell, cell), _cells(yc + 0.3 * cell, cell)
    ones, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # No range is wider than 0.7 cells, so two cells across and two down hold it.
    for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1)):
        a = asked[(left[asked] + dx <= right[asked]) & (low[asked] + dy <= high[asked])]
        cx, cy = left[a] + dx, low[a] + dy
        at = mixed(page[a], cx, cy)
        first = np.searchsorted(keys, at, "left")
        many = np.searchsorted(keys, at, "right") - first
        i = np.repeat(np.arange(len(a)), many)
        j = held[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(i))]
        same = (page[a[i]] == page[j]) & (hx[j] == cx[i]) & (hy[j] == cy[i])
        ones.append(a[i[same]])
        others.append(j[same])
    i, j = np.concatenate(ones), np.concatenate(others)
    taller, gap = np.maximum(h[i], h[j]), x0[j] - x1[i]
    near = (i != j) & (np.abs(yc[j] - yc[i]) < 0.3 * taller) & (gap > -0.2 * taller) & (gap < 0.5 * taller)
    i, j = i[near], j[near]
    order = np.lexsort((j, x0[j], i)) if n else np.empty(0, np.int64)
    return i[order], j[order]


def _grown(i: np.ndarray, j: np.ndarray, n: int, most: int) -> list[np.ndarray]:
    """Runs of 1 to ``most`` words by length, a row each: every run goes on to the leftmost touching word that it doesn't hold yet."""
    ends = np.searchsorted(i, np.arange(n), "right")
    starts = np.searchsorted(i, np.arange(n), "left")
    out = [np.arange(n).reshape(-1, 1)]
    for _ in range(most - 1):
        runs = out[-1]
        at, end = starts[runs[:, -1]], ends[runs[:, -1]]
        while True:
            more = at < end
            taken = np.zeros(len(runs), bool)
            taken[more] = (runs[more] == j[at[more]].reshape(-1, 1)).any(axis=1)
            if not taken.any():
                break
            at = at + taken
        out.append(np.column_stack([runs[more], j[at[more]]]))
    return out


def heading_runs(words: DataFrame, most: int = 4) -> DataFrame:
    """``page, word, n, text, x0, y0``: every word, and runs of up to ``most`` touching words on its line, as bare text at the first word's place.

    Words: ``page, word`` (reading order), ``x0, y0, x1, y1, text``.  The next word's centre is less than 0.3 and its gap more than -0.2
    and less than 0.5 of the taller one's height away; of several the leftmost.  Neighbours are found by
    cells of the page's tallest word, so that only near words meet.  Pages meet in one shuffle and stream past in order, many of them
    in one step; a task holds a batch and the page that is open.
    """
    places = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    d = words.select("page", "word", *places, F.coalesce(bare(F.col("text")), F.lit("")).alias("text"))
    schema = StructType([d.schema["page"], d.schema["word"], *StructType.fromDDL("n int, text string, x0 double, y0 double")])

    def runs_of(held: list[pa.RecordBatch], pages: list) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        new = np.fromiter((a != b for a, b in zip(pages[1:], pages)), bool, len(pages) - 1)
        page = np.concatenate([[0], np.cumsum(new)])
        page[np.fromiter((p is None for p in pages), bool, len(pages))] = -1
        x0, y0, x1, y1 = (t[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        for run in _grown(*_touching(page, x0, y0, x1, y1), len(page), most):
            if len(run):
                parts = [t["text"].take(pa.array(run[:, k])).combine_chunks() for k in range(run.shape[1])]
                text = pc.binary_join_element_wise(*parts, "") if len(parts) > 1 else parts[0]
                first = t.take(pa.array(run[:, 0])).combine_chunks()
                yield from pa.table([first["page"], first["word"], pa.array(np.full(len(run), run.shape[1], np.int32)), text, first["x0"], first["y0"]], schema.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pages: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_pylist()
            cut = next((k for k in range(len(own) - 1, -1, -1) if own[k] != own[-1]), -1) + 1
            if cut or (pages and pages[-1] != own[0]):
                yield from runs_of([*held, batch.slice(0, cut)], pages + own[:cut])
                held, pages = [], []
            held.append(batch.slice(cut))
            pages += own[cut:]
        if held:
            yield from runs_of(held, pages)

    return d.repartition("page").sortWithinPartitions("page", "word").mapInArrow(run, schema)


def fit_anchors(found: DataFrame, anchors: DataFrame, near: float, least: int = 3) -> DataFrame:
    """``doc_id, scale, shift, n``: each pair of found headings proposes a scale and shift; the one that most headings agree with.

    ``found``: doc_id, name, x (a page's few headings); ``anchors``: name, at (a fixed list, broadcast).  A tie
    goes to the pair that stands widest apart.  Below ``least`` agreeing headings there is no fit.  A page's headings meet in one row, where they
    make their pairs and count who agrees.
    """
    f = found.join(F.broadcast(anchors), "name").where("doc_id is not null")
    held = f.groupBy("doc_id").agg(F.collect_list(F.struct("name", "x", "at")).alias("_f")).where(F.size("_f") >= 2)
    pairs = held.select("doc_id", "_f", F.explode("_f").alias("a")).select("*", F.explode("_f").alias("b")).where("a.at < b.at")
    pairs = pairs.withColumn("scale", F.try_divide(F.col("b.at") - F.col("a.at"), F.col("b.x") - F.col("a.x"))).where("scale is not null")
    pairs = pairs.withColumn("shift", F.col("a.at") - F.col("scale") * F.col("a.x"))
    agree = F.size(F.filter("_f", lambda h: F.abs(F.col("scale") * h["x"] + F.col("shift") - h["at"]) <= near))
    scored = pairs.groupBy("doc_id", F.col("a.name").alias("an"), F.col("b.name").alias("bn"), "scale", "shift", (F.col("b.at") - F.col("a.at")).alias("span")).agg(F.sum(agree).alias("n"))
    best = W.partitionBy("doc_id").orderBy(F.col("n").desc(), F.col("span").desc(), "an", "bn")
    return scored.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("n") >= least)).select("doc_id", "scale", "shift", "n")


def bank_totals(lines: DataFrame) -> DataFrame:
    """Files whose last line has no date and repeats the sums above it: ``stmt_id, withdrawn, deposited``."""
    own = W.partitionBy("stmt_id").orderBy("seq")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    d = lines.withColumn("_last", F.lead("seq").over(own).isNull())
    d = d.withColumn("withdrawn", F.coalesce(F.sum("withdrawal").over(before), F.lit(0))).withColumn("deposited", F.coalesce(F.sum("deposit").over(before), F.lit(0)))
    same = (F.coalesce("withdrawal", F.lit(0)) == F.col("withdrawn")) & (F.coalesce("deposit", F.lit(0)) == F.col("deposited"))
    return d.where(F.col("_last") & F.col("day").isNull() & same & (F.col("seq") > 1)).select("stmt_id", "withdrawn", "deposited")


def same_day_around(lines: DataFrame) -> DataFrame:
    """Undated lines between two sure lines of one day get that day as ``day_offered``."""
    own = W.partitionBy("stmt_id").orderBy("seq")
    dated = F.when(F.col("day").isNotNull(), F.struct("day", "sure"))
    up = F.last(dated, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    down = F.first(dated, ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))
    d = lines.withColumn("_u", up).withColumn("_d", down)
    agree = F.col("day").isNull() & F.col("_u.sure") & F.col("_d.sure") & (F.col("_u.day") == F.col("_d.day"))
    return d.withColumn("day_offered", F.when(agree, F.col("_u.day"))).drop("_u", "_d")


def match_occurrences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One-to-one matches: the n-th row of a key on the left with the n-th on the right (by ``seq``); ``left_seq, right_seq``, NULL if unmatched."""

    def numbered(d: DataFrame, name: str) -> DataFrame:
        return d.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("seq")).alias("nth"), F.col("seq").alias(name))

    return numbered(left, "left_seq").join(numbered(right, "right_seq"), [*keys, "nth"], "full").select(*keys, "left_seq", "right_seq")


def balance_column(cells: DataFrame) -> DataFrame:
    """``file, col, hits``: the column whose steps from row to row most often equal another figure of the row, the rightmost on a tie.

    Cells: ``file, row, col, cents``.
    """
    own = W.partitionBy("file", "col").orderBy("row")
    steps = cells.withColumn("step", F.abs(F.col("cents") - F.lag("cents").over(own)))
    others = cells.select("file", "row", F.col("col").alias("other"), F.col("cents").alias("figure"))
    hits = steps.join(others, ["file", "row"]).where("other <> col and step = figure and step > 0").groupBy("file", "col").agg(F.countDistinct("row").alias("hits"))
    return hits.groupBy("file").agg(F.max_by(F.struct("col", "hits"), F.struct("hits", "col")).alias("b")).select("file", "b.col", "b.hits")


def proved_both_sides(lines: DataFrame) -> DataFrame:
    """Lines whose balance follows from the line above and leads to the line below (an end of the page counts as a side)."""
    own = W.partitionBy("stmt_id").orderBy("seq")
    chained = F.abs(F.col("balance") - F.lag("balance").over(own)) == F.col("amount")
    d = lines.withColumn("_c", chained)
    return d.withColumn("proved", F.coalesce(F.col("_c"), F.lit(False)) & F.coalesce(F.lead("_c").over(own), F.lit(True))).drop("_c")


def wrap_reach(lines: DataFrame, factor: float = 1.5) -> DataFrame:
    """``doc, reach``: ``factor`` times the least distance of neighbouring rows on any page."""
    gap = F.col("y") - F.lag("y").over(W.partitionBy("doc", "page").orderBy("y"))
    return lines.withColumn("_g", gap).where("_g > 0").groupBy("doc").agg((F.min("_g") * factor).alias("reach"))


def rebuilt_dates(lines: DataFrame) -> DataFrame:
    """A day read without its separators (``digits``, ddmmyyyy) is rebuilt where it falls between its readable neighbours."""
    own = W.partitionBy("stmt_id").orderBy("seq")
    up = F.last("day", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    down = F.first("day", ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))
    d = lines.withColumn("_u", up).withColumn("_d", down).withColumn("_new", F.try_to_date("digits", "ddMMyyyy"))
    fits = F.col("day").isNull() & F.col("_new").between(F.col("_u"), F.col("_d"))
    return d.withColumn("rebuilt", F.when(fits, F.col("_new"))).drop("_u", "_d", "_new")


def spread_of_best(rows: DataFrame, key: str, score: str, most: int, floor_: float) -> DataFrame:
    """Of each key the ``most`` least familiar rows, none at or above ``floor_``: what a recogniser should learn from."""
    own = W.partitionBy(key).orderBy(score, "id")
    return rows.where(F.col(score) < floor_).withColumn("place", F.row_number().over(own)).where(F.col("place") <= most)


def translate_clauses(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Texts of clauses joined by '; ', each looked up in a dictionary (``clause, meaning``, a fixed list) or left as it is."""
    parts = texts.select("id", F.posexplode(F.split("text", "; ")).alias("at", "clause"))
    said = parts.join(F.broadcast(dictionary), "clause", "left").withColumn("said", F.coalesce("meaning", "clause"))
    return said.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "; ").alias("text"))


def header_facts(lines: DataFrame) -> DataFrame:
    """Figures of a header, line by line (``doc, line, kind, value``): the first period and account count, the last closing and totals."""
    firsts = ("account", "period")
    d = lines.where("value is not null")
    pick = [F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("line"))).alias(k) for k in firsts]
    pick += [F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("line"))).alias(k) for k in ("closing", "total")]
    return d.groupBy("doc").agg(*pick)


def reasons_to_check(rows: DataFrame) -> DataFrame:
    """Why a row isn't sent, the first that holds: left out, undated, held page, own note, unproved, neighbour."""
    reason = (
        F.when(F.col("left_out"), "its statement was left out").when(F.col("day").isNull(), "no readable date").when(F.col("page_held"), "its page doesn't carry on")
        .when(F.col("note").isNotNull(), F.col("note")).when(~F.col("verified"), "not proved").otherwise("a row beside it isn't proved")
    )
    return rows.where(~F.col("confirmed")).withColumn("reason", reason)


def import_rows(rows: DataFrame) -> DataFrame:
    """Rows for an accounting import: positive amount, direction apart, serial date or blank."""
    from ..functions.dates import excel_serial

    return rows.select(
        "stmt_id", "seq", excel_serial(F.col("day")).alias("serial"), F.coalesce(F.nullif("withdrawal", F.lit(0)), "deposit").alias("amount"),
        F.when(F.coalesce("withdrawal", F.lit(0)) != 0, "out").otherwise("in").alias("direction"),
    )
