"""Money, dates, text, headings: golden cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text
from tallyspark.operators import infer


def values(spark, cases, f, kind="string"):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r.v for r in d.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_parse_amount(spark):
    assert values(spark, ["10,000.00", "1,23.00", "10,000", "12.3", "0.05", None, "1.00\n", "1234567.89"], money.parse_amount) == [1000000, None, None, None, 5, None, None, 123456789]
    assert values(spark, ["-10.00", "10.00", "--1.00"], money.parse_signed) == [-1000, 1000, None]


def test_formats(spark):
    assert values(spark, [9945956, -5, 0, 10**15], money.fmt_money, "long") == ["99459.56", "-0.05", "0.00", "10000000000000.00"]
    assert values(spark, [123456789, -5], money.fmt_comma, "long") == ["1,234,567.89", "-0.05"]
    assert values(spark, [150, 200, 199], money.shortest, "long") == ["1.5", "2.0", "1.99"]


@pytest.mark.parametrize(
    ("cell", "cents", "sign", "bad", "blank"),
    [
        ("(1,234.50)", 123450, "-", False, False), ("1,234.50-", 123450, "-", False, False), ("฿ 99 Cr", 9900, "+", False, False), ("12,34.5x", None, None, True, False),
        ("*1,234.50", 123450, None, False, False), ("THB 5 dr", 500, "-", False, False), ("-", None, None, False, True), ("", None, None, False, True), (None, None, None, False, True),
        ("1 2 3 4.50", None, None, True, False), ("๑๒.๕", 1250, None, False, False), ("+7.00", 700, "+", False, False), ("1.234", None, None, True, False), (" 8.10 ", 810, None, False, False),
    ],
)
def test_money_cell(spark, cell, cents, sign, bad, blank):
    (r,) = values(spark, [cell], money.money_cell)
    assert (r.cents, r.sign, r.bad is not None, r.blank) == (cents, sign, bad, blank)


def test_date_cell(spark):
    cases = {
        "45658": "2025-01-01", "25/05/68": "2025-05-25", "25/05/25": "2025-05-25", "25 พ.ค. 2568": "2025-05-25", "05/25/2025": "2025-05-25", "31/02/2025": None, "2025-01-31": "2025-01-31",
        "01 Jun 2026": "2026-06-01", "01-มิ.ย.-2569": "2026-06-01", "": None, "soon": None, "05/06/1968": "1968-06-05", "01 Jun": None,
    }
    got = dict(zip(cases, values(spark, list(cases), lambda c: dates.date_cell(c, "2026-10-02")), strict=True))
    assert {k: v.date and str(v.date) for k, v in got.items()} == cases
    assert got["05/25/2025"].note == "only makes sense month first" and got["05/06/1968"].note == "an unlikely year" and got["31/02/2025"].note == "not a real date"
    assert got["25/05/68"].day_over_12 and not got["25/05/68"].either_way and got[""].note is None


def test_years_and_serials(spark):
    d = spark.createDataFrame([(26, "2026-03-01"), (69, "2026-03-01"), (99, "2026-03-01"), (26, None)], "yy int, p string").withColumn("p", F.to_date("p"))
    got = [r.v for r in d.select(dates.resolve_year(F.col("yy"), F.col("p"), F.col("p")).alias("v")).collect()]
    assert [g.year for g in got] == [2026, 2026, None, None] and got[2].note and got[3].note == "no period to place the year by"
    assert values(spark, ["25/05/68", "31/02/68"], dates.passbook_date) == [date(2025, 5, 25), None]
    assert values(spark, ["2026-06-09"], lambda c: dates.excel_serial(F.to_date(c))) == [46182]
    place = lambda c: dates.day_month(c, F.lit("2025-09-01").cast("date"), F.lit("2025-09-30").cast("date"))
    assert values(spark, ["01 Oct", "15 Mar", "31 Sep"], place) == [date(2025, 10, 1), None, None]


def test_text(spark):
    assert values(spark, ["123-4-56789-0", "1234567890", "123456789", "xxx-x-x5678-9", "12xxxx7890"], text.looks_like_account) == [True, True, False, False, True]
    assert values(spark, ["123-4-56789-0", "XXX-1234"], text.mask_account) == ["7890", "1234"]
    assert values(spark, [0, 25, 26, 27, 701, 702], text.column_letter, "long") == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    assert values(spark, ["a/b\\c.csv", "x"], text.basename) == ["c.csv", "x"]
    assert values(spark, [["ab", "cd"], ["กา", "รข"], ["กา", "x"]], text.glue, "array<string>") == ["ab cd", "การข", "กา x"]
    assert values(spark, ["  ", "é" * 60], lambda c: text.remark(c, F.lit("other"))) == ["other", "é" * 50]


def test_headings(spark):
    cases = {"Balance (THB)": "balance", "รายการถอน": "withdrawal", "Dr": "withdrawal", "Dr.": "withdrawal", "Address": None, "Debit/Credit": "amount", "วันที่": "date", "Transaction Code": "description", "x" * 50: None, "รายละเอียดเพิ่มเติม": "details"}
    assert dict(zip(cases, values(spark, list(cases), infer.role_of), strict=True)) == cases


def test_find_columns(spark):
    sheet = [["My bank"], ["Date", "Currency Code", "Description", "Withdrawal", "Deposit", "Balance"], ["1", "THB", "x", "2", "", "3"]]
    cells = spark.createDataFrame([("f", i, j, v) for i, row in enumerate(sheet) for j, v in enumerate(row)], "file string, row int, col int, text string")
    (r,) = infer.find_columns(cells).collect()
    assert r.header == 1 and r.roles == {"date": 0, "description": 2, "withdrawal": 3, "deposit": 4, "balance": 5}
