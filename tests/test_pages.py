"""Words and pages: small cases, with nulls, ties and what must stay as it is."""

from pyspark.sql import functions as F

from tallyspark.functions import words
from tallyspark.operators import pages


def test_words_lose_rules_labels_and_marks(spark):
    d = spark.createDataFrame([("10.00|PromptPay", 0.0, 15.0), ("|", 0.0, 1.0), ("(13:38", 0.0, 6.0), ("", 0.0, 1.0), (None, 0.0, 1.0)], "t string, x0 double, x1 double")
    got = [r[0] for r in d.select(words.clean_edges(F.col("t"), F.col("x0"), F.col("x1"))).collect()]
    assert [[tuple(w) for w in g] if g is not None else None for g in got] == [[("10.00", 0.0, 5.0), ("PromptPay", 6.0, 15.0)], [], [("13:38", 0.0, 6.0)], [], None]
    t = spark.createDataFrame([("Ref: A  Ref: B",), (None,)], "t string")
    assert [r[0] for r in t.select(words.without_labels(F.col("t"), ["Ref:"])).collect()] == ["A B", None]
    t = spark.createDataFrame([("é ช่อง ",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(words.bare(F.col("t"))).collect()] == ["éชอง", None, ""]


def test_words_are_repaired_by_their_column_only(spark):
    d = spark.createDataFrame([("1.234.56", "money"), ("123456", "money"), ("1.234.56", "text"), ("01|09|2026", "date"), ("soon", "date")], "t string, k string")
    assert [r[0] for r in d.select(words.tidy(F.col("t"), F.col("k"))).collect()] == ["1,234.56", "1,234.56", "1.234.56", "01/09/2026", "soon"]
    said = ["1/9/26", "01-มิ.ย.-2569", "01-9.0.-2569", "01/09/", "12.00", ""]
    d = spark.createDataFrame([(s,) for s in said], "t string")
    assert [r[0] for r in d.select(words.is_date_word(F.col("t"))).collect()] == [True, True, True, False, False, False]


def test_own_files_are_known_below_added_rows_but_not_by_numbers(spark):
    head = ["Date", "Deposit", "Balance", "Check"]
    files = {"own": [["added"], head, ["1", "2", "3", "OK"]], "cheques": [head, ["1", "2", "3", "12345"]], "late": [["x"]] * 25 + [head, ["", "", "", "OK"]], "thai": [["รูป", "สถานะ", "เหตุผล"]], "none": [[None]]}
    rows = [(f, 0, r, c, t) for f, cells in files.items() for r, row in enumerate(cells) for c, t in enumerate(row)]
    got = pages.own_file_kind(spark.createDataFrame(rows, "file string, sheet int, row int, col int, text string")).collect()
    assert {tuple(r) for r in got} == {("own", "own-review-file"), ("thai", "own-picture-file")}


def test_sheets_are_pages_once_and_no_more_than_allowed(spark):
    d = spark.createDataFrame([(1, k, t, b) for k, (t, b) in enumerate([("a", False), ("", True), ("a", False), ("b", False), ("c", False), ("a", False)])], "batch int, place int, key string, blank boolean")
    got = [(r.place, r.state, r.page) for r in pages.sheet_pages(d, most=2).orderBy("place").collect()]
    assert got == [(0, "page", 1), (2, "same-file", None), (3, "page", 2), (4, "too-many", None), (5, "too-many", None)]


def test_headings_are_given_again_only_where_they_change(spark):
    d = spark.createDataFrame([(1, 1, None, [["a"], ["1"]]), (1, 2, "bad", [["z"], ["9"]]), (1, 3, None, [["a"], ["2"]]), (1, 4, None, [["b"], ["3"]]), (1, 5, None, [])], "set_id int, page int, error string, rows array<array<string>>")
    got = [(r.page, r.kind, r.cells[0]) for r in pages.heading_rows(d).orderBy("page", "line").collect()]
    assert got == [(1, "heading", "a"), (1, "line", "1"), (3, "line", "2"), (4, "heading", "b"), (4, "line", "3")]


def test_header_band_takes_two_printed_lines(spark):
    w = [(1, 1, 0.0, 8.0, "dated"), (1, 2, 50.0, 58.0, "วันที่"), (1, 3, 60.0, 68.0, "Balance"), (1, 4, 90.0, 98.0, "Date"), (2, 1, 0.0, 8.0, "Date")]
    got = pages.header_bands(spark.createDataFrame(w, "page int, line int, y0 double, y1 double, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 50.0, 68.0)]


def test_passbook_opens_with_what_was_brought_forward_and_only_suggests_days(spark):
    lines = [(1, 1, 1, None, None, "*100.00", None), (1, 1, 2, "01/09/68", "+25.00", "*125.00", None), (1, 1, 3, "", "-5.00", "*120.00", None), (1, 1, 4, None, None, None, None), (1, 2, 1, "01/09/68", "+1.00", "*121.00", 0.5), (1, 2, 2, "02/09/68", "+1.00", "*122.00", 0.01)]
    d = spark.createDataFrame(lines, "book int, page int, line int, date string, amount string, balance string, margin double")
    rows = pages.passbook_rows(d).orderBy("page", "row").collect()
    assert [(r.page, r.row, r.description, r.balance) for r in rows] == [(1, 1, "B/F", "100.00"), (1, 2, "", "125.00"), (1, 3, "", "120.00"), (2, 1, "", "121.00"), (2, 2, "", "122.00")]
    assert [r.hint is not None for r in rows] == [False, False, True, False, False] and [r.doubt is not None for r in rows] == [False] * 4 + [True]
    got = pages.passbook_lines(d).orderBy("seq").collect()
    assert [(r.seq, r.amount, r.balance, r.sign, r.stated_opening) for r in got if r.balance] == [(2, 2500, 12500, "+", 10000), (3, 500, 12000, "-", 10000), (5, 100, 12100, "+", 10000), (6, 100, 12200, "+", 10000)]


def test_hints_say_what_the_balance_agrees_with_and_change_nothing(spark):
    kinds = "stmt_id int, seq int, opening long, opening_derived boolean, amount long, balance long, amount_text string, balance_text string, light string"
    lines = [(1, 1, 0, False, 425000, 25000, None, None, "red"), (1, 2, 0, False, None, 30000, None, None, "red"), (1, 3, 0, False, None, 153456, "1.234,56", None, "red"), (1, 4, 0, False, 100, 153556, None, None, "green")]
    got = [r.hints for r in pages.line_hints(spark.createDataFrame(lines, kinds)).orderBy("seq").collect()]
    assert got[0].startswith('this may be +250.00 with the "+" read as a 4') and got[1].startswith("the balance changed by +50.00")
    assert got[2].startswith('"1.234,56" may be 1,234.56') and got[3] == ""
