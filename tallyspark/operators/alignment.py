"""Pages as a reader sees them - turned, scaled, shifted - put where the bank's own page has its words."""

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
from ..scratch import kept
from . import lookups

#: How far from its place a heading may land; the turns that are tried, in degrees to either side, and how many.
NEAR, MOST_DEG, TURNS = 4.0, 5.0, 201


def page_tilts(words: DataFrame, bin_size: float = 2.0) -> DataFrame:
    """``page, tilt``: ``layout.deskew`` of the words' centres, a page at a time in the task that holds it.

    Of each turn only the counts of one page's heights exist, so nothing is multiplied by the number of turns before a shuffle.
    Words without a place are left out, pages without any give no row.
    """
    centres = words.select("page", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")).where("x is not null and y is not null")
    turns = np.round((np.arange(TURNS) - (TURNS - 1) / 2) * (2 * MOST_DEG / (TURNS - 1)), 6)
    cos, sin = np.cos(np.radians(turns)), np.sin(np.radians(turns))

    def tilt(x: np.ndarray, y: np.ndarray) -> float:
        score, n = np.empty(TURNS), len(x)
        step = max(1, 2**18 // n)
        for k in range(0, TURNS, step):
            bins = np.sort(np.floor((y * cos[k : k + step, None] - x * sin[k : k + step, None]) / bin_size), axis=1)
            new = np.ones(bins.shape, bool)
            new[:, 1:] = (bins[:, 1:] != bins[:, :-1]) & ~(np.isnan(bins[:, 1:]) & np.isnan(bins[:, :-1]))
            at = np.flatnonzero(new)
            size = np.diff(at, append=bins.size).astype(float)
            score[k : k + step] = np.bincount(at // n, size * size)
        best = turns[score == score.max()]
        return round((best[0] + best[-1]) / 2, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            x, y = (np.concatenate([np.asarray(p.column(c)) for p in held]) for c in (1, 2))
            return pa.RecordBatch.from_arrays([held[0].column(0).slice(0, 1), pa.array([tilt(x, y)])], ["page", "tilt"])

        for batch in batches:
            if not batch.num_rows:
                continue
            changes = pc.fill_null(pc.not_equal(batch.column(0).slice(1), batch.column(0).slice(0, batch.num_rows - 1)), False)
            cuts = [0, *(np.flatnonzero(np.asarray(changes)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, stop - start)
                if held and held[0].column(0)[0] != part.column(0)[0]:
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    return centres.where("page is not null").repartition("page").sortWithinPartitions("page").mapInArrow(run, StructType([words.schema["page"], *StructType.fromDDL("tilt double")]))


def straighten(words: DataFrame, bin_size: float = 2.0) -> DataFrame:
    """``words`` with their upper left corners turned back by the page's tilt; widths and heights stay.  Adds ``tilt``."""
    d = words.join(page_tilts(words, bin_size), "page")
    c, s = F.cos(F.radians("tilt")), F.sin(F.radians("tilt"))
    x, y = F.col("x0") * c + F.col("y0") * s, F.col("y0") * c - F.col("x0") * s
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return d.withColumns({"x0": x, "y0": y, "x1": x + wide, "y1": y + tall})


def headings_read(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """``page, text, x, y, ax, ay``: headings found once on a page, whole or as a run of touching pieces, beside their places."""
    named = anchors.select(bare(F.col("text")).alias("text"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    runs = lookups.heading_runs(words).join(F.broadcast(named), "text").groupBy("page", "text", "ax", "ay").agg(F.count_distinct("word").alias("n"), F.first("x0").alias("x"), F.first("y0").alias("y"))
    return runs.where("n = 1 and page is not null").select("page", "text", "x", "y", "ax", "ay")


def _apart(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def fit_places(read: DataFrame, near: float = NEAR) -> DataFrame:
    """``page, scale, dx, dy, n``: the scale and shift that most headings of a page agree with.

    Every two headings propose one; of proposals with as many followers the pair that stands widest apart counts.  Two followers are
    enough only where no other heading was read.  The scale is that of the followers that stand widest apart, the shift their
    mean; a page where one of them is then farther than ``near`` from its place has no fit.  A page's
    headings are as few as the anchors, so its pairs are bounded.
    """
    a = read.select("page", *[F.col(c).alias(f"{c}_a") for c in ("text", "x", "y", "ax", "ay")])
    b = read.select("page", *[F.col(c).alias(f"{c}_b") for c in ("text", "x", "y", "ax", "ay")])
    pairs = a.join(b, "page").where("text_a < text_b").withColumn("_read", _apart(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))).where("_read >= 1")
    pairs = pairs.withColumn("span", _apart(F.col("ax_a") - F.col("ax_b"), F.col("ay_a") - F.col("ay_b"))).withColumn("_s", F.try_divide("span", "_read"))
    mean = lambda v: (F.col(f"a{v}_a") + F.col(f"a{v}_b") - F.col("_s") * (F.col(f"{v}_a") + F.col(f"{v}_b"))) / 2
    pairs = pairs.select("page", "text_a", "text_b", "span", "_s", mean("x").alias("_dx"), mean("y").alias("_dy"))
    off = lambda v: F.abs(F.col(v) * F.col("_s") + F.col(f"_d{v}") - F.col(f"a{v}")) <= near
    votes = pairs.join(read, "page").where(off("x") & off("y"))
    voted = votes.groupBy("page", "text_a", "text_b", "span").agg(F.collect_list(F.struct("text", "x", "y", "ax", "ay")).alias("agree"))
    best = W.partitionBy("page").orderBy(F.size("agree").desc(), F.col("span").desc(), "text_a", "text_b")
    top = voted.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(read.groupBy("page").agg(F.count(F.lit(1)).alias("_found")), "page")
    top = top.withColumn("n", F.size("agree")).where("n >= 3 or (n = 2 and _found = 2)")
    apart = F.flatten(F.transform("agree", lambda p: F.transform("agree", lambda q: F.struct(_apart(p["ax"] - q["ax"], p["ay"] - q["ay"]).alias("span"), _apart(p["x"] - q["x"], p["y"] - q["y"]).alias("read")))))
    top = top.withColumn("_w", F.array_max(apart)).withColumn("scale", F.try_divide("_w.span", "_w.read"))
    shift = lambda v: F.aggregate("agree", F.lit(0.0), lambda s, h: s + h[f"a{v}"] - h[v] * F.col("scale")) / F.col("n")
    top = top.withColumn("dx", shift("x")).withColumn("dy", shift("y"))
    lands = lambda h, v: F.abs(h[v] * F.col("scale") + F.col(f"d{v}") - h[f"a{v}"]) <= near
    return top.where(F.forall("agree", lambda h: lands(h, "x") & lands(h, "y"))).select("page", "scale", "dx", "dy", "n")


def align_pages(words: DataFrame, anchors: DataFrame, width: float, summary_marks: tuple[str, ...] = (), bin_size: float = 2.0) -> DataFrame:
    """``page, word, x0, y0, x1, y1, text, summary``: each page's words at the places of the plain page, ``width`` wide.

    Words: ``page, word`` (reading order), their boxes and ``text`` as read, and ``page_width`` in the same unit.  Anchors: ``text, x, y``, a
    profile's fixed list.  A page whose headings don't fit is kept only if its text (without blanks) holds a summary mark: it is scaled
    by its width, for the facts of its header (``summary``).  Others give no rows.  NULL texts count as empty; a page without
    places has no tilt and gives no rows.
    """
    # Written once: headings, marks and the words themselves are read from it, and the search for tilts is most of the work.
    straight = kept(straighten(words.withColumn("text", F.coalesce("text", F.lit(""))), bin_size), "straight-words")
    read = kept(headings_read(straight, anchors), "headings-read")
    fits = fit_places(read).select("page", "scale", "dx", "dy", F.lit(False).alias("summary"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: F.regexp_replace(w["text"], r"\s+", "")), "")
    marked = [F.contains(whole, F.lit("".join(m.split()))) for m in summary_marks]
    pages = straight.groupBy("page").agg(F.max("page_width").alias("_wide"), (F.greatest(*marked, F.lit(False)) if marked else F.lit(False)).alias("_marked"))
    plain = pages.where("_marked").join(fits, "page", "left_anti").select("page", F.try_divide(F.lit(width), F.col("_wide")).alias("scale"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(True).alias("summary"))
    put = straight.join(fits.unionByName(plain), "page")
    at = lambda v, d: (F.col(v) * F.col("scale") + F.col(d)).alias(v)
    return put.select("page", "word", at("x0", "dx"), at("y0", "dy"), at("x1", "dx"), at("y1", "dy"), "text", "summary")
