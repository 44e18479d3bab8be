"""Rows of table files: what each is, lines with their wrapped text, the bank's totals at the foot, evidence of date order."""

from pyspark.sql import functions as F

from tallyspark.operators import tables

ROW = "set_id long, file_no long, row long, header long, opening long, date string, description string, withdrawal string, deposit string, amount string, amount2 string, balance string"


def rows(spark, *given, header=0, opening=None):
    """Each: date, description, withdrawal, deposit, amount, balance."""
    d = spark.createDataFrame([(1, 1, i, header, opening, *r[:5], None, r[5]) for i, r in enumerate(given)], ROW)
    return d.withColumn("cells", F.array("date", "description", "withdrawal", "deposit", "amount", "balance"))


def kinds(spark, *given, **more):
    return [(r.kind, r.amount, r.sign, r.balance) for r in tables.table_rows(rows(spark, *given, **more), "2026-10-02").orderBy("row").collect()]


HEAD = ("Date", "Description", "Out", "In", None, "Balance")


def test_kinds_of_rows(spark):
    got = kinds(
        spark, HEAD, ("", "Start", "", "", None, "100.00"), ("", "b/f", "", "", None, "100.00"), ("2026-01-02", "shop", "40.00", "", None, "60.00"), ("", "more", "", "", None, ""), ("", "", None, "", None, " "), HEAD,
        ("2026-01-03", "TOTAL ACCESS", "", "5.00", None, "65.00"), ("", "Carried forward", "", "", None, "65.00"), ("", "c/f", "", "", None, "66.00"), ("", "Total", "40.00", "5.00", None, ""), ("", "T", "40.00", "5.00", None, ""),
    )
    assert [k for k, *_ in got] == ["heading", "brought_forward", "brought_forward", "line", "text", "blank", "repeated", "line", "carried_forward", "line", "totals", "line"]
    assert got[3] == ("line", 4000, "-", 6000) and got[7] == ("line", 500, "+", 6500) and got[9] == ("line", None, None, 6600)


def test_a_known_opening_leaves_rows_without_a_name_as_lines(spark):
    assert [k for k, *_ in kinds(spark, HEAD, ("", "Start", "", "", None, "1.00"), ("", "b/f", "", "", None, "1.00"), opening=100)] == ["heading", "line", "line"]
    assert [k for k, *_ in kinds(spark, HEAD, ("", "b/f", "", "", None, "1.00"), ("", "Start", "", "", None, "1.00"), opening=100)] == ["heading", "brought_forward", "line"]


def test_above_the_heading_only_dated_rows_with_money_count(spark):
    got = kinds(spark, ("", "Bank", "", "", None, ""), ("2026-01-01", "page break", "5.00", "", None, "95.00"), ("2026-01-01", "opening balance", "5.00", "", None, "95.00"), HEAD, header=3)
    assert [k for k, *_ in got] == ["above", "line", "above", "heading"]


def test_amounts(spark):
    got = tables.table_rows(rows(spark, HEAD, ("2026-01-01", "a", "1.00", "2.00", None, "1.00"), ("2026-01-01", "b", "0.00", "2.00", None, "x"), ("2026-01-01", "c", "1.2.3", "", None, "1.00"), ("2026-01-01", "d", "", "", "-3.00", "1.00"), ("2026-01-01", "e", "", "", "4.00", "-1.00")), "2026-10-02").orderBy("row").collect()
    assert [(r.amount, r.sign) for r in got[1:]] == [(None, None), (200, "+"), (None, None), (300, "-"), (400, "+")]
    assert [r.note for r in got[1:]] == ["more than one amount on this line - check it", '"x" could not be read as a balance', '"1.2.3" could not be read as an amount', None, None]
    assert got[5].balance == -100


def test_wrapped_text_and_foot_totals(spark):
    given = [HEAD, ("", "title", "", "", None, ""), ("2026-01-01", "a", "1.00", "", None, "9.00"), ("", "b ", "", "", None, ""), ("", "c", "", "", None, ""), ("2026-01-01", "d", "", "2.00", None, "11.00"), ("", "T", "1.00", "2.00", None, "")]
    d = tables.table_lines(tables.table_rows(rows(spark, *given), "2026-10-02"))
    assert [(r.row, r.description) for r in d.orderBy("row").collect()] == [(2, "a b c"), (5, "d"), (6, "T")]
    assert [tuple(r) for r in tables.foot_totals(d).collect()] == [(1, 1, 6, 100, 200)]
    given[-1] = ("", "T", "1.01", "2.00", None, "")
    assert tables.foot_totals(tables.table_lines(tables.table_rows(rows(spark, *given), "2026-10-02"))).count() == 0


def test_empty_tables_and_null_cells(spark):
    assert tables.table_rows(rows(spark, HEAD).limit(0), "2026-10-02").count() == 0
    assert kinds(spark, HEAD, (None,) * 6) == [("heading", None, None, None), ("blank", None, None, None)]


def test_date_order_is_carried_until_a_page_speaks_against_it(spark):
    pages = [(1, 1, None), (1, 2, "day"), (1, 3, None), (1, 4, "month"), (1, 5, None), (2, 1, None)]
    got = tables.carried_order(spark.createDataFrame(pages, "set_id long, page long, evidence string")).orderBy("set_id", "page").collect()
    assert [r.day_first for r in got] == [False, True, True, False, False, False]


def test_files_of_one_account_become_one_proved_statement_also_newest_first(spark):
    head = ["Date", "Description", "Withdrawal", "Deposit", "Balance"]
    first = [head, ["", "Brought forward", "", "", "100.00"], ["2026-01-01", "a", "", "20.00", "120.00"], ["2026-01-02", "idle", "", "0.00", "120.00"], ["2026-01-03", "b", "50.00", "", "70.00"], ["", "Total", "50.00", "20.00", ""]]
    second = [head, ["2026-02-01", "c", "", "5.00", "75.00"], ["2026-02-02", "d", "10.00", "", "65.00"]]
    turned = [head, *reversed(second[1:]), *reversed(first[2:5])]
    rows = [("fwd", 1, k, c) for k, c in enumerate(first)] + [("fwd", 2, k, c) for k, c in enumerate(second)] + [("rev", 1, k, c) for k, c in enumerate(turned)]
    d = spark.createDataFrame(rows, "set_id string, file_no int, row long, cells array<string>")
    names = ["date", "description", "withdrawal", "deposit", "balance"]
    d = d.withColumns({n: F.get("cells", F.lit(k)) for k, n in enumerate(names)} | {"header": F.lit(0), "opening": F.lit(None).cast("long"), "amount": F.lit(None).cast("string"), "amount2": F.lit(None).cast("string")})
    got = tables.table_statement(d, "2026-10-02").orderBy("stmt_id", "seq").collect()
    assert [(r.description, r.verified) for r in got if r.stmt_id == "fwd"] == [("a", True), ("b", True), ("c", True), ("d", True)]
    assert [(r.description, r.verified) for r in got if r.stmt_id == "rev"] == [("a", False), ("b", True), ("c", True), ("d", True)]
