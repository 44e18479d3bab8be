"""Words of a picture's reader: letters and dates joined, lines levelled, pitch, anchors."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reading

KIND = "page string, word int, x0 double, y0 double, x1 double, y1 double, text string"


def frame(spark, said, page="p"):
    return spark.createDataFrame([(page, i, float(x0), float(y0), float(x1), float(y1), t) for i, (x0, x1, y0, y1, t) in enumerate(said)], KIND)


def test_thai_letters_join_and_others_stay(spark):
    said = [
        (0, 6, 0, 10, "ก"), (7, 12, 0, 10, "ข"), (8, 12, -4, 0, "้"), (20, 26, 0, 10, "ค"), (26.5, 40, 0, 10, "Latin"), (40.5, 46, 0, 10, "ง"), (45, 50, 0, 10, "จ"), (40, 44, 0, 10, "ฉ"),
        (0, 6, 40, 50, "น"), (2, 5, 38, 43, "้"), (6, 12, 40, 50, "ำ"), (30, 34, 40, 50, None), (34, 39, 40, 50, "ที่"),
    ]
    got = [(r.word, r.text, r.x0, r.x1, r.y0) for r in reading.join_thai(frame(spark, said)).orderBy("word").collect()]
    texts = {w: t for w, t, *_ in got}
    assert texts[0] == "กข" and texts[3] == "ค" and texts[4] == "Latin" and texts[8] == "น้ำ" and texts[11] == "" and texts[12] == "ที่"
    assert next(g[2:] for g in got if g[0] == 8) == (0.0, 12.0, 38.0)
    assert reading.join_thai(frame(spark, [])).collect() == []


def test_thai_dates_join_only_where_they_are_whole(spark):
    def line(y, parts, step=2.0):
        x, out = 0.0, []
        for p in parts:
            out.append((x, x + 5, y, y + 9, p))
            x += 5 + step
        return out

    said = line(0, ["01-", "ม", "ิ", ".", "ย", ".-2569", "x"]) + line(40, ["02-ก", ".พ.", "-2569"]) + line(80, ["03-", "ม", ".", "ย", ".-2569"]) + line(120, ["04-", "ธ", ".", "ค", ".-2569"], 9.0) + line(160, ["5", "ต.ค", "2026"])
    got = [r.text for r in reading.join_thai(frame(spark, said), 4.0).orderBy("word").collect()]
    assert got[:3] == ["01-มิ.ย.-2569", "x", "02-ก.พ.-2569"] and "5-ต.ค.-2026" in got and "03-ม.ย.-2569" not in got and "04-" in got and not [t for t in got if "ธ.ค" in t]
    assert [r.text for r in reading.join_thai(frame(spark, said)).orderBy("word").collect()][0] == "01-"


def test_all_repairs_of_a_page(spark):
    said = [(0, 20, 0, 10, "01|02/2026|"), (60, 70, 0, 10, "ฝ"), (70.5, 80, 0, 10, "าก"), (160, 200, 0, 10, "1.234.56"), (300, 330, 0, 10, "|")]
    columns = [("date", 0.0, 50.0, 0), ("text", 50.0, 150.0, 1), ("amount", 150.0, 250.0, 2)]
    got = reading.tidy_page(frame(spark, said), columns, {"date": "date", "amount": "money"}, 4.0).orderBy("word").collect()
    assert [(r.text, r.column) for r in got] == [("01", "date"), ("02/2026", "date"), ("ฝาก", "text"), ("1,234.56", "amount")]


def test_lines_get_their_middle_edges(spark):
    said = [(0, 5, 0, 12, "tall"), (6, 9, 5, 6, "flat"), (10, 15, 1, 10, "plain"), (20, 22, 2, 9, "low"), (0, 5, 30, 40, "next")]
    got = {r.text: (r.line, r.y0, r.y1) for r in reading.level_lines(frame(spark, said)).collect()}
    assert got == {"tall": (0, 2.0, 10.0), "flat": (0, 2.0, 10.0), "plain": (0, 2.0, 10.0), "low": (0, 2.0, 10.0), "next": (1, 30.0, 40.0)}


@pytest.mark.parametrize("size", [9.6, 12.3])
def test_pitch_is_that_of_the_grid(spark, size):
    widths = [round(n * size * 1.03) - 2 for n in (3, 5, 8, 8, 11)] + [10.0]
    best = None
    for i in range(math.floor(size * 0.14 / 0.02 + 1e-9) + 1):
        p = size * 0.93 + i * 0.02
        err = sum(abs((w + 2) / p - math.floor((w + 2) / p + 0.5)) for w in widths if w >= 25)
        if best is None or err < best[1] - 1e-9:
            best = (p, err)
    d = spark.createDataFrame([("a", float(w), size) for w in widths] + [("small", 3.0, size)], "k string, width double, size double")
    got = {r.k: r.pitch for r in reading.pitch_of(d, "k").collect()}
    assert got == {"a": pytest.approx(best[0]), "small": pytest.approx(size * 0.93)}


def test_anchors_stand_once_above_the_first_transaction(spark):
    def doc(name, extra=(), first="01/02/2026"):
        words = [(10, 60, "Date"), (50, 60, "Balance"), (90, 60, "Twin"), (120, 60, "Twin"), (10, 10, "Above"), (60, 60, "No"), (70, 60, "Nr.12345"), *extra, (10, 100, first), (90, 100, "1,000.00"), (10, 120, "Below")]
        return [("b", name, 0, int(y), i, float(x), y - 4.0, float(x + 5), y + 4.0, t) for i, (x, y, t) in enumerate(words)]

    rows = doc("1") + doc("2", [(200, 60, "Rare")]) + doc("3") + doc("4", first="none")
    d = spark.createDataFrame(rows, "bank string, doc string, page int, line int, word int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.bank, r.text): (r.n, r.x) for r in reading.anchor_words(d).collect()}
    assert got == {("b", "Date"): (3, 10.0), ("b", "Balance"): (3, 50.0)}


def test_free_reading(spark):
    d = spark.createDataFrame([([0.1, 0.5, 0.5],), ([],), (None,)], "f array<double>")
    assert [r[0] for r in d.select(reading.free_reading(F.col("f"), F.array(*map(F.lit, "abc")))).collect()] == ["b", None, None]


def test_review_sheets_of_quiet_days_failed_checks_and_unknowns(spark):
    from tallyspark.operators import review
    from tallyspark.sinks import workbooks
    from tallyspark.sources import tables

    rows = spark.createDataFrame(
        [(1, 2, "2026-01-03", "10:00", "b", None, 50, None, "ATM", None, False, None), (1, 1, None, None, "a", 20, None, 980, None, "x", True, None)],
        "stmt_id long, seq long, day string, time string, description string, withdrawal long, deposit long, balance long, channel string, details string, verified boolean, note string",
    ).withColumn("day", F.to_date("day"))
    days = spark.createDataFrame([(1, "2026-01-03", 1, 1, 0, 50, 1030), (1, "2026-01-02", 0, 0, 0, 0, 980)], "stmt_id long, day string, n long, flagged long, withdrawn long, deposited long, balance long").withColumn("day", F.to_date("day"))
    accounts = spark.createDataFrame(
        [(1, "C:\\in\\a.pdf", "B", None, "", "X", 1000, 1030, None, None, None), (2, "b.pdf", "B", "N", "9", "X", 0, 0, None, None, "look")],
        "stmt_id long, source string, bank string, account_name string, account_no string, branch string, opening long, closing long, period_from date, period_to date, caveat string",
    )
    checks = spark.createDataFrame([(1, 2, "late", False, "no"), (1, 1, "first", True, "yes")], "stmt_id long, ord int, label string, passed boolean, detail string")
    files = {r.path: r.content for r in workbooks.sheet_files(review.sheets(rows, days, accounts, checks), "stmt_id", review.SHEETS).collect()}
    sheets = tables.workbook(bytes(files["1.xlsx"]))
    assert list(sheets) == list(review.SHEETS) and sheets["Transactions"][0] == list(review.TRANSACTIONS)
    assert sheets["Transactions"][1] == ["", "", "Opening balance", "", "", 10.0] and sheets["Transactions"][2] == ["", "", "a", 0.2, "", 9.8, "", "x", "OK"]
    assert sheets["Transactions"][3] == [46025.0, "10:00", "b", "", 0.5, "", "ATM"] and sheets["Transactions"][4] == ["", "", "Closing balance", "", "", 10.3]
    assert sheets["Daily"][1:] == [[46024.0, 0.0, 0.0, 0.0, 0.0, 9.8], [46025.0, 1.0, 0.0, 0.5, 0.5, 10.3, "1 row(s) flagged"], ["2 days, 1 active", 1.0, 0.0, 0.5, 0.5, 10.3]]
    proof = sheets["Proof"]
    assert proof[0] == ["How this file was checked"] and ["Source PDF", "", "a.pdf"] in proof and ["Account name", "", "(not read)"] in proof and ["Statement period", "", "None to None"] in proof
    at = proof.index(["Check", "Result", "Detail"])
    assert proof[at + 1 : at + 3] == [["first", "PASS", "yes"], ["late", "FAIL", "no"]] and proof[-1] == [review.RULE_TEXT]
    other = tables.workbook(bytes(files["2.xlsx"]))
    assert other["Proof"][0] == ["look"] and ["Transactions read", "", "0"] in other["Proof"] and len(other["Transactions"]) == 3


def test_joined_letters_of_nations_whose_page_numbers_meet(spark, tmp_path):
    import duckdb

    from tallyspark.plans import reading as _  # noqa: F401  (adds its queries)
    from tallyspark.plans.queries import ORACLES, QUERIES

    duckdb.sql(f"COPY (SELECT * FROM (VALUES (200005::BIGINT, 0::INTEGER, 'BUILDING'), (5::BIGINT, 1::INTEGER, 'MACHINERY'), (6::BIGINT, 1::INTEGER, 'FURNITURE')) t(c_custkey, c_nationkey, c_mktsegment)) TO '{tmp_path}/customer.parquet' (FORMAT PARQUET)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    expected = con.execute(ORACLES["joined_letters"]).fetchall()
    found = [tuple(r) for r in QUERIES["joined_letters"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected) and len(found) == 9


def test_levelling_joins_nothing_and_holds_no_table_of_values(spark):
    d = frame(spark, [(0, 9, 0, 8, "a"), (12, 20, 1, 9, "b"), (0, 9, 40, 48, None)])
    plan = reading.level_lines(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan.lower()
    assert sorted((r.word, r.y0, r.y1) for r in reading.level_lines(d).collect()) == [(0, 1.0, 9.0), (1, 1.0, 9.0), (2, 40.0, 48.0)]


def test_review_sheets_read_each_table_a_few_times_at_most(spark, tmp_path):
    """An account's own lines came from a reading of its table each: 25 scans in all."""
    from tallyspark.operators import review

    tables = {
        "rows": "1L as stmt_id, 1L as seq, date '2024-01-01' as day, '' as time, 'x' as description, 5L as withdrawal, cast(null as bigint) as deposit, 9L as balance, '' as channel, '' as details, true as verified, '' as note",
        "days": "1L as stmt_id, date '2024-01-01' as day, 1L as n, 0L as flagged, 5L as withdrawn, 0L as deposited, 9L as balance",
        "accounts": "1L as stmt_id, 's' as source, 'b' as bank, 'a' as account_name, 'n' as account_no, '' as branch, 0L as opening, 9L as closing, date '2024-01-01' as period_from, date '2024-01-31' as period_to, 'eye' as caveat",
        "checks": "1L as stmt_id, 1 as ord, 'first' as label, true as passed, 'yes' as detail",
    }
    for name, columns in tables.items():
        spark.sql(f"select {columns}").write.parquet(f"{tmp_path}/{name}")
    lines = review.sheets(*(spark.read.parquet(f"{tmp_path}/{name}") for name in tables))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6
    assert lines.count() == 23
