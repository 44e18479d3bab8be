"""Line statements, import files, grids, repairs: small cases."""

import zipfile
from datetime import date
from io import BytesIO

from pyspark.sql import functions as F

from tallyspark.functions import repair
from tallyspark.operators import checks, statements
from tallyspark.sinks import workbooks
from tallyspark.sources import tables

LINE = "stmt_id long, seq long, amount long, balance long, sign string, stated_opening long"


def values(spark, cells, f):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in d.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_line_one_is_not_proved_by_an_opening_worked_back_from_it(spark):
    rows = [(1, 1, 10, 90, "-", None), (1, 2, 40, 130, "-", None), (1, 3, None, 130, None, None), (2, 1, 10, 90, "-", 100), (3, 1, None, None, None, None)]
    got = {(r.stmt_id, r.seq): r for r in statements.lines_statement(spark.createDataFrame(rows, LINE)).collect()}
    assert not got[1, 1].verified and got[1, 1].opening == 100 and got[2, 1].verified and got[2, 1].withdrawal == 10
    assert got[1, 2].verified and got[1, 2].deposit == 40 and got[1, 2].sign_note == "shown as a withdrawal but the balance says deposit - check this line"
    assert got[1, 3].reading == "the amount could not be read" and got[3, 1].reading == "nothing on this line could be read" and not got[3, 1].verified


def test_a_statement_of_lines_is_worked_out_once_and_lines_without_an_amount_stay(spark, tmp_path):
    """Proved lines were joined with the lines they came from, which were read and sorted twice for it."""
    lines = [
        (1, 1, 100, 900, "-", 1000), (1, 2, None, 777, "-", 1000), (1, 3, 50, None, "+", 1000), (1, 4, None, None, None, 1000), (1, 5, 50, 800, "-", 1000), (1, 6, 25, 825, "-", 1000),
        (2, 1, 10, 10, "+", None), (2, 2, None, 30, "+", None), (2, 3, 20, 30, "+", None), (2, 4, None, 99, "+", None), (None, 1, 10, 110, "+", 100),
    ]
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lines")
    d = statements.lines_statement(spark.read.parquet(f"{tmp_path}/lines"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.stmt_id, r.seq): (r.verified, r.withdrawal, r.deposit, r.reading, r.sign_note is not None) for r in d.collect()}
    amount, balance = "the amount could not be read", "the balance could not be read"
    assert got == {
        (1, 1): (True, 100, None, None, False), (1, 2): (False, None, None, amount, False), (1, 3): (False, None, None, balance, False),
        (1, 4): (False, None, None, "nothing on this line could be read", False), (1, 5): (False, None, None, None, False), (1, 6): (True, None, 25, None, True),
        (2, 1): (False, None, 10, None, False), (2, 2): (False, None, None, amount, False), (2, 3): (True, None, 20, None, False), (2, 4): (False, None, None, amount, False),
        (None, 1): (False, None, None, None, False),
    }


def test_heading_fits(spark):
    rows = [("s", 1, "a|b|c", {"date": 0, "amount": 1, "balance": 2}), ("s", 2, "x", {"date": 0, "amount": 1, "balance": 2}), ("s", 3, "y", {"date": 0}), ("s", 4, "a|b|c", {"date": 5}), ("s", 5, "z", {"date": 0, "amount": 2, "balance": 2})]
    d = statements.heading_fits(spark.createDataFrame(rows, "set_id string, file_no int, text string, roles map<string,int>"))
    assert [r.fits for r in d.orderBy("file_no").collect()] == [True, True, False, True, False]


def test_import_files_and_refusals(spark):
    rows = spark.createDataFrame([(1, 500, None), (1, None, 70)], "group_id long, withdrawal long, deposit long")
    groups = spark.createDataFrame([(1, "kb", "012-3-45678-9", "a", date(2026, 1, 1), date(2026, 2, 28)), (2, "kb", None, "b", None, None)], "group_id long, bank string, account string, name string, period_from date, period_to date")
    got = [tuple(r) for r in statements.import_files(rows, groups).orderBy("group_id").collect()]
    assert got == [(1, "KB_6789_202601-202602_BKTRN.xlsx", 2, 500, 70, None), (2, None, 0, None, None, "nothing to import - b: no rows")]


def test_grid_and_summary(spark):
    cells = spark.createDataFrame([("s", "B2", "x"), ("s", "AA4", "y")], "sheet string, ref string, value string")
    got = {r.row: r["values"] for r in statements.dense_grid(cells).collect()}
    assert got == {1: [], 2: ["", "x"], 3: [], 4: [""] * 26 + ["y"]}
    accounts = spark.createDataFrame([("a", "green"), ("a", "partial"), ("b", "green")], "k string, status string")
    refused = spark.createDataFrame([("a",), ("c",)], "k string")
    assert {tuple(r) for r in statements.banner(accounts, refused, "k").collect()} == {("a", 2, "partial", 1), ("b", 1, "green", 0), ("c", 0, "blocked", 1)}


def test_checks_print_the_reports_words(spark):
    rows = spark.createDataFrame(
        [(1, 1, date(2026, 1, 5), True, False, False, 100, None, 100, 900), (1, 2, date(2026, 1, 3), False, False, False, None, None, 40, None), (1, 3, date(2026, 1, 9), True, False, True, 5, None, 5, 895)],
        "stmt_id long, seq long, day date, verified boolean, has_notes boolean, is_tax boolean, withdrawal long, deposit long, amount long, balance long",
    ).withColumn("period_from", F.lit("2026-01-04").cast("date")).withColumn("period_to", F.lit("2026-03-01").cast("date"))
    facts = spark.createDataFrame([(1, 896, 100, 1, None, None, True, 1000, 2)], "stmt_id long, closing_stated long, withdraw_total long, withdraw_count long, deposit_total long, deposit_count long, opening_derived boolean, opening long, zero_lines int")
    got = {r.label: (r.passed, r.detail) for r in checks.checks(checks.totals(rows), facts).collect()}
    assert got == {
        "Every row agrees with the running balance": (False, "2 of 3 rows verified; 1 could not be"), "Dates never go backwards": (False, "2026-01-03 comes after 2026-01-05"),
        "Final balance matches the closing balance the bank printed": (False, "computed 8.95 vs printed 8.96"), "Total withdrawals matches the bank's own total": (True, "computed 1.00 vs printed 1.00"),
        "Number of withdrawals matches the bank's own count": (True, "found 1 vs printed 1"), "Tax the bank withheld, written as its own withdrawal rows": (True, "1 row(s), total 0.05"),
        "Opening balance (not printed by the bank) worked back from row 1": (True, "10.00; confirmed only through the totals checks above"),
        "Rows dated outside the statement period (allowed, listed)": (True, "2026-01-03 0.40"),
        "A month or more of the statement period has no lines (allowed, listed)": (True, "no lines 2026-01-10 to 2026-03-01 - if the account was used then, this file may be cut short"),
        "Lines of 0.00 left out - nothing to post (allowed, listed)": (True, "2 line(s)"), "No other anomalies on any row": (True, "clean"),
    }


def test_repairs(spark):
    dates = {"01/07/25": "01/07/25", "01710725": "01/10/25", "01707125": "01/07/25", "01/1025": "01/10/25", "1710/25": None, "31|12|2025": "31/12/2025", "45/0125": None, "soon": None}
    assert dict(zip(dates, values(spark, list(dates), repair.repair_date), strict=True)) == dates
    fixes = {"1.286,398.63": "1,286,398.63", "1,234.56": None, "12.5": None, "1.234.56": "1,234.56"}
    assert dict(zip(fixes, values(spark, list(fixes), repair.separator_fix), strict=True)) == fixes
    assert values(spark, ["1,234.56(Shop", "8,765.43!", "word", "11.02-26"], repair.split_glued) == [["1,234.56", "Shop"], ["8,765.43"], ["word"], ["11.02-26"]]
    assert values(spark, ["a -120, 000.00 b", "1, 2"], lambda c: repair.join_split_money(F.split(c, " "))) == [["a", "-120,000.00", "b"], ["1,", "2"]]
    assert [tuple(v) for v in values(spark, ["biz one out via biz one", "x y x", "a b"], repair.lead_channel)] == [("biz one", "out via biz one"), ("x", "y x"), (None, "a b")]
    assert values(spark, ["ab", "abc", "axc", "ab"], lambda c: repair.first_difference(c, F.lit("ab"))) == [None, 3, 2, None]
    assert values(spark, ["รวม 3 รายการ 4", "n 7 x", "1 2", "x"], repair.count_in) == [3, 7, None, None]
    assert [tuple(v) for v in values(spark, ["1,000.50", "", "x", "-2.00"], repair.typed_balance)] == [(100050, None), (None, None), (None, "not an amount: x"), (-200, None)]


def test_review_workbook_is_the_same_each_time_and_holds_a_table(spark):
    rows = spark.createDataFrame([(1, 1, 2, "2026-01-02", 30, True), (1, 1, 1, "2026-01-01", 20, False)], "book long, stmt_id long, seq long, day string, amount long, verified boolean")
    a, b = (workbooks.review_files(d, "book", ["stmt_id", "seq"]).collect()[0] for d in (rows, rows.orderBy("seq")))
    assert a.content == b.content
    parts = zipfile.ZipFile(BytesIO(a.content))
    assert b'ref="A1:D3"' in parts.read("xl/tables/table1.xml") and b"tablePart" in parts.read("xl/worksheets/sheet1.xml")
    sheets = tables.workbook(bytes(a.content))
    assert sheets["Transactions"][1:] == [[1.0, 1.0, "2026-01-01", 20.0], [1.0, 2.0, "2026-01-02", 30.0]] and sheets["Proof"] == [["what", "lines"], ["proved", 1.0], ["to check", 1.0]]


def test_column_names_agree(spark):
    from tallyspark.functions.text import column_letter

    d = spark.range(0, 1500, 7).select("id", column_letter(F.col("id")).alias("n"))
    assert all(workbooks.column_name(r.id) == r.n for r in d.collect()) and [workbooks.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
