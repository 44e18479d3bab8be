"""Pages as read, put in the places of the plain page."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import alignment, layout

KIND = "page string, word int, x0 double, y0 double, x1 double, y1 double, text string, page_width double"
ANCHORS = [("Date", 60.0, 40.0), ("Withdrawal", 180.0, 40.0), ("Deposit", 300.0, 44.0), ("Balance", 440.0, 40.0)]


def page(name, heads=ANCHORS, deg=0.0, scale=1.0, shift=(0.0, 0.0), rows=20, first=()):
    """Headings and rows of three words, turned about the corner, scaled and shifted."""
    said = [*heads, *first] + [(t, x, 60.0 + 14 * i) for i in range(rows) for t, x in ((f"{i:02d}/01/2026", 60.0), (f"{i}.00", 185.0), (f"{i}1.00", 445.0))]
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    out = []
    for k, (text, x, y) in enumerate(said):
        px, py = x * scale + shift[0], y * scale + shift[1]
        tx, ty = px * c - py * s, py * c + px * s
        out.append((name, k, tx, ty, tx + 30 * scale, ty + 8 * scale, text, 600.0 * scale))
    return out, {k: (x, y) for k, (_, x, y) in enumerate(said)}


def aligned(spark, rows, marks=()):
    words, anchors = spark.createDataFrame(rows, KIND), spark.createDataFrame(ANCHORS, "text string, x double, y double")
    return alignment.align_pages(words, anchors, 600.0, marks).collect()


def test_turned_and_scaled_pages_land_on_the_plain_one(spark):
    rows, places = [], {}
    for name, deg, scale, shift in (("a", 0.0, 1.0, (0, 0)), ("b", 1.0, 2.0, (13, -8)), ("c", -2.5, 1.3, (0, 40)), ("d", 4.0, 0.85, (5, 5))):
        more, at = page(name, deg=deg, scale=scale, shift=shift)
        rows += more
        places |= {(name, k): p for k, p in at.items()}
    got = aligned(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        x, y = places[r.page, r.word]
        assert abs(r.x0 - x) < 4 and abs(r.y0 - y) < 4 and not r.summary, r


def test_pages_without_a_fit(spark):
    """One heading, a heading read twice beside one other, two against one: refused; a summary mark, its blanks ignored, scales by width."""
    one, _ = page("one", ANCHORS[:1])
    twice, _ = page("twice", ANCHORS[:2], first=[("Date", 60.0, 500.0)])
    split, _ = page("split", [*ANCHORS[:2], ("Balance", 380.0, 90.0)])
    plain, places = page("sum", [], scale=2.0, first=[("Account", 20.0, 20.0), ("Sum mary", 120.0, 20.0)])
    got = aligned(spark, one + twice + split + plain, ("Account Summary",))
    assert {(r.page, r.summary) for r in got} == {("sum", True)}
    assert all(abs(r.x0 - places[r.word][0]) < 3 for r in got) and len(got) == len(plain)


def test_a_heading_in_the_wrong_place_is_outvoted(spark):
    rows, places = page("p", [*ANCHORS[:3], ("Balance", 300.0, 120.0)], scale=1.5)
    got = aligned(spark, rows)
    assert len(got) == len(rows) and all(abs(r.x0 - places[r.word][0]) < 1 for r in got)


def test_two_followers_suffice_alone_and_pieces_count_as_a_heading(spark):
    rows, places = page("p", [ANCHORS[0]], first=[("Bal", 440.0, 40.0), ("ance", 471.0, 40.0)], scale=1.2)
    got = aligned(spark, rows)
    assert len(got) == len(rows) and all(abs(r.x0 - places[r.word][0]) < 1 for r in got)


def test_nulls_and_nothing(spark):
    rows, _ = page("p", scale=2.0)
    rows.append(("p", 999, 10.0, 900.0, 20.0, 910.0, None, 1200.0))
    got = {r.word: r.text for r in aligned(spark, [*rows, ("q", 1, None, None, None, None, "x", 100.0)])}
    assert len(got) == len(rows) and got[999] == ""
    assert alignment.align_pages(spark.createDataFrame([], KIND), spark.createDataFrame(ANCHORS, "text string, x double, y double"), 600.0).collect() == []


@pytest.mark.parametrize("deg", [-3.0, 0.5])
def test_straighten_finds_the_tilt(spark, deg):
    rows, _ = page("p", deg=deg, scale=2.0)
    tilt = alignment.straighten(spark.createDataFrame(rows, KIND)).agg(F.max("tilt")).first()[0]
    assert abs(tilt - deg) <= 0.2


def test_tilts_equal_the_aggregate_over_all_turns(spark):
    rows = [r for k, deg in enumerate((-3.0, 0.0, 0.5, 2.2)) for r in page(f"p{k}", deg=deg, scale=1.0 + k / 4)[0]]
    words = spark.createDataFrame(rows, KIND)
    centres = words.select("page", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    assert {(r.page, r.tilt) for r in alignment.page_tilts(words).collect()} == {(r.page, r.angle) for r in layout.deskew(centres, "page").collect()}
