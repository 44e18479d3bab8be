"""Lookups, extraction from words, periods: small cases."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tallyspark.functions import dates
from tallyspark.operators import chain, extract, lookups, selection
from tallyspark.sources import tables


def test_legend_first_definition_counts_and_fills_blanks(spark):
    texts = spark.createDataFrame([("d", "TR = Transfer, FE = Fee, TR = Other")], "doc string, text string")
    names = lookups.legend(texts, r"([A-Z]{2}) = (\w+)", "doc")
    assert {(r.code, r.name) for r in names.collect()} == {("TR", "Transfer"), ("FE", "Fee")}
    rows = spark.createDataFrame([("d", 1, "TR", " "), ("d", 2, "FE", "own"), ("d", 3, "XX", None)], "doc string, i int, code string, details string")
    assert [r.details for r in lookups.with_legend(rows, names, "doc").orderBy("i").collect()] == ["Transfer", "own", None]


def test_value_after_a_mark_ends_at_a_wide_gap(spark):
    words = [(1, 1, 0, 0.0, 30.0, "Account"), (1, 1, 1, 35.0, 60.0, "123"), (1, 1, 2, 65.0, 80.0, "456"), (1, 1, 3, 200.0, 220.0, "Branch"), (1, 2, 4, 0.0, 9.0, "none")]
    d = spark.createDataFrame(words, "page int, line int, word int, x0 double, x1 double, text string")
    assert [(r.line, r.value) for r in lookups.after_mark(d, F.col("text") == "Account").collect()] == [(1, "123 456")]


def test_anchors_refuse_without_agreement(spark):
    anchors = spark.createDataFrame([("a", 0.0), ("b", 100.0), ("c", 300.0)], "name string, at double")
    found = [("good", "a", 10.0), ("good", "b", 60.0), ("good", "c", 160.0), ("bad", "a", 0.0), ("bad", "b", 100.0), ("same", "a", 5.0), ("same", "b", 5.0)]
    (r,) = lookups.fit_anchors(spark.createDataFrame(found, "doc_id string, name string, x double"), anchors, 1.0).collect()
    assert (r.doc_id, r.scale, r.shift, r.n) == ("good", 2.0, -20.0, 3)


def test_matches_use_each_row_once(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "k string, seq long")
    right = spark.createDataFrame([("k", 9), ("n", 8)], "k string, seq long")
    got = {(r.k, r.left_seq, r.right_seq) for r in lookups.match_occurrences(left, right, "k").collect()}
    assert got == {("k", 1, 9), ("k", 2, None), ("m", 3, None), ("n", None, 8)}


def test_same_day_and_rebuilt_dates(spark):
    rows = [(1, 1, "2026-01-05", True, None), (1, 2, None, False, "05012026"), (1, 3, "2026-01-05", True, None), (1, 4, None, False, "09092026"), (1, 5, "2026-01-07", False, None)]
    d = spark.createDataFrame(rows, "stmt_id long, seq long, day string, sure boolean, digits string").withColumn("day", F.to_date("day"))
    assert {r.seq: r.day_offered for r in lookups.same_day_around(d).collect() if r.day is None} == {2: date(2026, 1, 5), 4: None}
    assert {r.seq: r.rebuilt for r in lookups.rebuilt_dates(d).collect() if r.day is None} == {2: date(2026, 1, 5), 4: None}


def test_bank_totals_and_reasons(spark):
    lines = [(1, 1, "2026-01-01", 5, None), (1, 2, "2026-01-02", None, 7), (1, 3, None, 5, 7), (2, 1, "2026-01-01", 5, None), (2, 2, None, 6, None)]
    d = spark.createDataFrame(lines, "stmt_id long, seq long, day string, withdrawal long, deposit long").withColumn("day", F.to_date("day"))
    assert [(r.stmt_id, r.withdrawn, r.deposited) for r in lookups.bank_totals(d).collect()] == [(1, 5, 7)]
    kind = "seq int, left_out boolean, day string, page_held boolean, note string, verified boolean, confirmed boolean"
    rows = [(1, True, None, True, "n", False, False), (2, False, None, True, "n", False, False), (3, False, "x", True, "n", False, False), (4, False, "x", False, "n", False, False), (5, False, "x", False, None, False, False), (6, False, "x", False, None, True, False), (7, False, "x", False, None, True, True)]
    got = [r.reason for r in lookups.reasons_to_check(spark.createDataFrame(rows, kind)).orderBy("seq").collect()]
    assert got == ["its statement was left out", "no readable date", "its page doesn't carry on", "n", "not proved", "a row beside it isn't proved"]


def test_words_to_a_proved_statement(spark):
    """A page with an opening, two rows (one wrapped), a totals line that ends it, and text below that isn't read."""
    said = [
        (40, [(70, 90, "B/F"), (380, 420, "100.00")]), (60, [(10, 50, "09/06/2026"), (70, 110, "paid"), (170, 200, "30.00"), (380, 420, "70.00")]), (66, [(70, 100, "rent")]),
        (90, [(10, 50, "10/06/2569"), (70, 110, "in"), (270, 300, "1,000.50"), (380, 420, "1,070.50")]), (120, [(70, 110, "TOTALS")]), (130, [(10, 50, "11/06/2026"), (380, 420, "5.00")]),
    ]
    words = [("d", 0, float(x0), float(x1), y + (0.9 if k % 2 else 0.0), t) for y, line in said for k, (x0, x1, t) in enumerate(line)]
    d = spark.createDataFrame([(*w[:2], i, *w[2:]) for i, w in enumerate(words)], "doc string, page int, word int, x0 double, x1 double, y double, text string")
    columns = [("date", 0.0, 60.0, 0), ("description", 60.0, 160.0, 1), ("amount", 160.0, 320.0, 2), ("balance", 320.0, 500.0, 3)]
    rows = extract.transactions(extract.cells_of(extract.lines_of(d), columns), "TOTALS", 10.0, "2026-10-02")
    got = rows.orderBy("seq").collect()
    assert [(r.seq, str(r.day), r.description, r.amount, r.balance, r.opening) for r in got] == [(1, "2026-06-09", "paid rent", 3000, 7000, 10000), (2, "2026-06-10", "in", 100050, 107050, 10000)]
    proved = chain.verify_chain(rows.withColumnRenamed("doc", "stmt_id").withColumn("tax", F.lit(None).cast("bigint")), 250.0).orderBy("seq").collect()
    assert [(r.verified, r.withdrawal, r.deposit) for r in proved] == [(True, 3000, None), (True, None, 100050)]


def test_periods(spark):
    cases = {
        "01/10/2568 - 30/09/2569": ("2025-10-01", "2026-09-30"), "Jan 2026 - Mar 2026": ("2026-01-01", "2026-03-31"), "Feb 2024": ("2024-02-01", "2024-02-29"),
        "31/02/2026 to 01/03/2026": None, "nothing": None, None: None, "": None, "01/06/26 - 30/06/69": ("2026-06-01", "2026-06-30"), "01/06/2026": None,
        "1/6/06 to 2/6/06": ("2006-06-01", "2006-06-02"), "1/6/05 to 2/6/2006": "refused", "01/06/30 - 30/06/30": "refused", "01/06/71": "refused", "1/6/27 - 1/7/27": ("2027-06-01", "2027-07-01"), "1/6/28 - 1/7/28": "refused",
        "01 Sep 2026 - 3 October 2026": ("2026-09-01", "2026-10-03"), "01 sep 2026": None, "04/2026,05/2026,06/2026": ("2026-04-01", "2026-06-30"), "02/2568": ("2025-02-01", "2025-02-28"), "13/2026,01/2026": None,
        "05/2026 and 01/06/2026 02/06/2026 03/06/2026": ("2026-06-01", "2026-06-02"), "02/06/2026 to 01 May 2026": ("2026-06-02", "2026-05-01"), "Foo 2026 - Mar 2026": None,
    }
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", dates.period(F.col("c"), "2026-10-02").alias("p")).orderBy("i")
    got = ["refused" if r.p.refused else (str(r.p.period_from), str(r.p.period_to)) if r.p.period_from else None for r in d.collect()]
    assert got == list(cases.values())


def test_runs_of_touching_words(spark):
    # A heading in four pieces, a word too far, one too low, a flat piece beside a tall one, two words on one place.
    said = [(0, 10, 0, 8, "ยอด"), (11, 14, 0, 8, "ค"), (15, 20, 5, 8, "ง"), (21, 40, 0, 8, "เหลือ"), (41, 50, 0, 8, "Paid"), (56, 60, 0, 8, "far"), (61, 70, 3, 11, "low"), (100, 110, 0, 8, "A"), (100, 110, 0, 8, "B"), (111, 120, 0, 8, "C D")]
    d = spark.createDataFrame([("p", i, float(x0), float(y0), float(x1), float(y1), t) for i, (x0, x1, y0, y1, t) in enumerate(said)] + [("q", 0, 1.0, 1.0, 1.0, 1.0, None)], "page string, word int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.page, r.word, r.n): r.text for r in lookups.heading_runs(d).collect()}
    assert got[("p", 0, 1)] == "ยอด" and got[("p", 0, 2)] == "ยอดค" and got[("p", 1, 1)] == "ค" and ("p", 5, 2) not in got and got[("p", 7, 2)] == "AC D".replace(" ", "") and got[("p", 8, 2)] == "BCD"
    assert got[("p", 3, 2)] == "เหลอPaid" and ("p", 3, 3) not in got and ("q", 0, 1) in got
    assert len([k for k in got if k[0] == "p" and k[2] == 1]) == len(said) and lookups.heading_runs(d.limit(0)).collect() == []


def brute_farthest(items, most):
    units = []
    for order, v in items:
        a = np.array(v) - np.mean(v)
        if np.linalg.norm(a) > 0:
            units.append((order, a / np.linalg.norm(a)))
    units.sort(key=lambda x: x[0])
    kept = units[:1]
    while units and len(kept) < min(most, len(units)):
        rest = [u for u in units if all(u is not k for k in kept)]
        kept.append(min(rest, key=lambda u: (round(max(float(u[1] @ k[1]) for k in kept), 12), u[0])))
    return [u[0] for u in kept]


def test_the_most_different_items(spark):
    rng = np.random.default_rng(4)
    groups = {"a": [(i, rng.normal(size=6).tolist()) for i in range(40)], "b": [(i, rng.normal(size=6).tolist()) for i in range(3)], "one": [(5, [1.0, 2.0, 3.0, 1.0, 1.0, 1.0])], "flat": [(1, [2.0] * 6)]}
    rows = [(k, i, v) for k, items in groups.items() for i, v in items] + [("b", 9, None), ("b", 10, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (None, 1, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]), ("b", 11, [])]
    got = selection.farthest_first(spark.createDataFrame(rows, "k string, i int, v array<double>"), "k", "i", "v", 5).collect()
    assert {k: [r.i for r in sorted(got, key=lambda r: r.rank) if r.k == k] for k in groups} == {k: brute_farthest(items, 5) for k, items in groups.items()}
    assert selection.farthest_first(spark.createDataFrame([], "k string, i int, v array<double>"), "k", "i", "v").collect() == []


def test_own_and_locked_files_are_refused(spark):
    shut = tables.COMPOUND + b"x" * 600 + tables.ENCRYPTION
    files = {"own.csv": b"Date,Withdrawal,Deposit,Balance,Check\n1,2,3,4,OK", "bank.csv": b"Date,Withdrawal,Deposit,Balance,Check\n1,2,3,4,55", "shut.xlsx": shut, "shut.xls": shut, "short.xls": tables.COMPOUND + tables.ENCRYPTION, "none.csv": b"", "no.pdf": b"1"}
    d = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in files.items()], "path string, length bigint, content binary")
    found = tables.without_own_files(tables.cells(d))
    assert {r.file: r.error for r in found.where("error is not null").collect()} == {
        "own.csv": "this tool's own file: own-review-file", "shut.xlsx": "locked with a password", "shut.xls": "locked with a password", "short.xls": "the old binary spreadsheet kind isn't read", "no.pdf": "not a table file",
    }
    assert {r.file for r in found.where("error is null").collect()} == {"bank.csv"}


def test_value_after_mark_rounds_to_the_nearest_second_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tallyspark.plans.queries import ORACLES, QUERIES
    from tallyspark.plans import lookups as _  # noqa: F401  (adds its queries)

    rows = "(0, 7, 'signup', TIMESTAMP '2024-01-01 08:00:00.4'), (1, 7, 'view', TIMESTAMP '2024-01-01 08:08:20.6'), (2, 7, 'error', TIMESTAMP '2024-01-01 15:14:00.5')"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}, (3, 8, 'signup', TIMESTAMP '2024-01-01 00:00:00.6'), (4, 8, 'view', TIMESTAMP '2024-01-01 00:08:20.4')) t(event_id, user_id, event_type, ts)) TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.execute(ORACLES["value_after_mark"]).fetchall()
    found = [tuple(r) for r in QUERIES["value_after_mark"](spark, str(tmp_path)).select("page", "line", "value").collect()]
    assert sorted(found) == sorted(expected) and len(found) == 1


def test_headings_are_fitted_without_a_join_of_words(spark):
    words = spark.createDataFrame([(1, 0, 10.0, 0.0, 20.0, 8.0, "Da"), (1, 1, 21.0, 0.0, 30.0, 8.0, "te"), (1, 2, 60.0, 0.0, 90.0, 8.0, "Left"), (None, 3, 0.0, 0.0, 9.0, 8.0, "x"), (None, 4, 9.5, 0.0, 19.0, 8.0, "y")], "page long, word int, x0 double, y0 double, x1 double, y1 double, text string")
    runs = lookups.heading_runs(words)
    assert {(r.page, r.word, r.n, r.text) for r in runs.collect()} == {(1, 0, 1, "Da"), (1, 0, 2, "Date"), (1, 1, 1, "te"), (1, 2, 1, "Left"), (None, 3, 1, "x"), (None, 4, 1, "y")}
    anchors = spark.createDataFrame([("Date", 10.0), ("Left", 60.0)], "name string, at double")
    fits = lookups.fit_anchors(runs.select(F.col("page").alias("doc_id"), F.col("text").alias("name"), F.col("x0").alias("x")), anchors, 1.0, 2)
    assert fits._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [tuple(r) for r in fits.collect()] == [(1, 1.0, 0.0, 2)]
