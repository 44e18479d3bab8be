"""Pages on their way to statements: whose file it is, which sheets count, bands, roles by content, passbook lines, hints, labels.

Windows span a page, a book or a statement, which the readers bound; everything else is an aggregate or a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import fmt_comma, let, money_cell
from ..functions.repair import separator_fix
from ..functions.dates import passbook_date
from .chain import statement
from .infer import role_of

#: Rows in which marks of the tool's own files are looked for, those marks, and the headings of its own sheets.
OWN_WINDOW = 25
PICTURE_MARK = r"^Light · (?:ไฟ|สถานะ)\z|^ไฟ\z|^Read from statement pictures on this computer|^อ่านจากรูปใบแจ้งยอดในเครื่องนี้"
PICTURE_HEADS = ("รูป", "สถานะ", "เหตุผล")
REVIEW_MARK = r"^(?:How this file was checked|ไฟล์นี้ตรวจอย่างไร|The rule every row is tested against|กฎที่ใช้ตรวจทุกรายการ)\z"
REVIEW_HEADS = {
    "Check": ("Date", "Time", "Description", "Withdrawal", "Deposit", "Balance", "Channel", "Details", "Transactions", "Withdrawals", "Deposits", "Net change", "Closing balance"),
    "ผลตรวจ": ("วันที่", "เวลา", "รายการ", "ถอน", "ฝาก", "ยอดคงเหลือ", "ช่องทาง", "รายละเอียด", "จำนวนรายการ", "เปลี่ยนแปลงสุทธิ", "ยอดคงเหลือปลายงวด"),
}
#: Labels of a heading line, how far (points) a heading reaches, the certainty of a date, pages at a time.
DATE_LABELS, BALANCE_LABELS, HEADER_REACH = ("วันที่", "date"), ("คงเหลือ", "balance"), 12.0
DATE_SURE, MOST_PAGES = 0.05, 30
#: Headings of tax columns, and of one column for both directions.
TAX, BOTH = "(?iu)ภาษี|tax|wht|vat", "(?iu)ถอน.*ฝาก|ฝาก.*ถอน|debit.*credit|credit.*debit|dr.*cr"
OUT_WORDS, IN_WORDS = ("ถอน", "debit", "dr"), ("ฝาก", "credit", "cr")


def own_file_kind(cells: DataFrame) -> DataFrame:
    """``file, kind`` of the tool's own outputs: own-picture-file or own-review-file, by the first mark; other files give no row.

    Cells: ``file, sheet, row, col, text``.  A Check column counts beside three of its neighbours if words stand below it.
    """
    said = cells.select("file", "sheet", "row", "col", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    words = said.where(F.col("text").rlike(r"[^\d\s.,-]")).groupBy("file", "sheet", "col").agg(F.max("row").alias("last"))
    tops = said.where(F.col("row") < OWN_WINDOW).groupBy("file", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    tops = tops.select("file", "sheet", "row", F.transform("c", lambda x: x["col"]).alias("cols"), F.transform("c", lambda x: x["text"]).alias("texts"))
    texts = F.col("texts")
    mark = lambda rank, kind, found, col=F.lit(None): F.when(found, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), col.cast("long").alias("col")))
    heads = lambda h: F.array(*map(F.lit, h))
    shown = [
        mark(0, "own-picture-file", F.exists(texts, lambda t: t.rlike(PICTURE_MARK)) | (F.size(F.array_intersect(heads(PICTURE_HEADS), texts)) == len(PICTURE_HEADS))),
        mark(1, "own-review-file", F.exists(texts, lambda t: t.rlike(REVIEW_MARK))),
    ]
    for rank, (check, beside) in enumerate(REVIEW_HEADS.items(), 2):
        at = F.get("cols", (F.array_position(texts, check) - 1).cast("int"))
        shown.append(mark(rank, "own-review-file", F.array_contains(texts, check) & (F.size(F.array_intersect(heads(beside), texts)) >= 3), at))
    found = tops.select("file", "sheet", "row", F.inline(F.array_compact(F.array(*shown)))).join(words, ["file", "sheet", "col"], "left")
    return found.where(F.col("col").isNull() | (F.col("last") > F.col("row"))).groupBy("file").agg(F.min_by("kind", F.struct("sheet", "row", "rank")).alias("kind"))


def sheet_pages(sheets: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Adds ``state`` (page, same-file, too-many) and ``page`` (from 1) to the sheets of a batch that hold something.

    Sheets: ``batch, place, key`` (its rows as text), ``blank``.  Refused sheets stay as rows.
    """
    seen = F.row_number().over(W.partitionBy("batch", "key").orderBy("place"))
    d = sheets.where(~F.col("blank")).withColumn("_new", (seen == 1).cast("int"))
    d = d.withColumn("_n", F.sum("_new").over(W.partitionBy("batch").orderBy("place")))
    state = F.when(F.col("_n") - F.col("_new") >= most, "too-many").when(F.col("_new") == 0, "same-file").otherwise("page")
    return d.withColumn("state", state).withColumn("page", F.when(F.col("state") == "page", F.col("_n"))).drop("_new", "_n")


def heading_rows(pages: DataFrame) -> DataFrame:
    """``set_id, page, line, kind, cells``: all pages' lines under one heading, given again where a page's headings differ.

    Pages: ``set_id, page, error, rows`` (arrays of cells, the first one the headings).  Pages with an error or without rows give none.
    """
    d = pages.where(F.col("error").isNull() & (F.size("rows") > 0))
    head = F.array_join(F.get("rows", F.lit(0)), "|", "")
    d = d.withColumn("_new", F.coalesce(F.lag(head).over(W.partitionBy("set_id").orderBy("page")) != head, F.lit(True)))
    lines = d.select("set_id", "page", "_new", F.posexplode("rows").alias("line", "cells"))
    return lines.where(F.col("_new") | (F.col("line") > 0)).select("set_id", "page", "line", F.when(F.col("line") == 0, "heading").otherwise("line").alias("kind"), "cells")


def header_bands(words: DataFrame, reach: float = HEADER_REACH) -> DataFrame:
    """``page, top, bottom``: the first line with a date's label that has a balance's label on it or within ``reach``.

    Words: ``page, line, y0, y1, text``.
    """
    t = F.lower("text")
    any_of = lambda test, labels: F.array_max(F.array(*[test(t, F.lit(x)) for x in labels]))
    rows = words.groupBy("page", "line").agg(
        F.avg((F.col("y0") + F.col("y1")) / 2).alias("y"), F.min("y0").alias("top"), F.max("y1").alias("bottom"),
        F.bool_or(any_of(F.startswith, DATE_LABELS)).alias("dated"), F.bool_or(any_of(F.contains, BALANCE_LABELS)).alias("balanced"),
    )
    thousandths = round(reach * 1000)
    near = W.partitionBy("page").orderBy(F.round(F.col("y") * 1000).cast("long")).rangeBetween(-thousandths, thousandths)
    d = rows.select("page", "line", "y", "dated", F.max("balanced").over(near).alias("balanced"), F.min("top").over(near).alias("top"), F.max("bottom").over(near).alias("bottom"))
    return d.where("dated and balanced").groupBy("page").agg(F.min_by(F.struct("top", "bottom"), F.struct("y", "line")).alias("b")).select("page", "b.*")


def roles_by_content(columns: DataFrame) -> DataFrame:
    """``file, role, col``: which column is which by what columns hold; headings only tell withdrawals from deposits.

    Columns: ``file, col, kind`` (date, money or text), ``is_balance, right_edge, filled, length, heading``.  Where the
    headings don't tell directions, the columns are amount and amount2, and the balance decides.
    """
    bare = F.regexp_replace(F.coalesce("heading", F.lit("")), r"\s+", "")
    first = lambda names: F.array_min(F.transform(F.array(*map(F.lit, names)), lambda w: F.when(F.contains(F.lower(bare), w), F.position(w, F.lower(bare))).otherwise(1 << 30)))
    amount = (F.col("kind") == "money") & ~F.col("is_balance") & ~F.coalesce("heading", F.lit("")).rlike(TAX)
    one = F.struct("right_edge", "col", "filled", role_of(F.coalesce("heading", F.lit(""))).alias("role"), bare.rlike(BOTH).alias("both"), (first(OUT_WORDS) < first(IN_WORDS)).alias("out_first"))
    d = columns.groupBy("file").agg(
        F.min(F.when(F.col("kind") == "date", F.col("col"))).alias("date"), F.min(F.when((F.col("kind") == "money") & F.col("is_balance"), F.col("col"))).alias("balance"),
        F.array_sort(F.collect_list(F.when(amount, one))).alias("m"),
        F.min(F.when(F.col("kind") == "text", F.struct((-F.col("length")).alias("_length"), "col")))["col"].alias("description"),
    )
    named = F.filter("m", lambda x: x["role"].isin("withdrawal", "deposit", "amount"))
    fullest = F.array_sort(F.transform("m", lambda x: F.struct((-x["filled"]).alias("least"), x["right_edge"].alias("right_edge"), x["col"].alias("col"))))
    plain = lambda a: F.transform(F.slice(a, 1, 2), lambda x: F.struct(x["right_edge"].alias("right_edge"), x["col"].alias("col")))
    pick = F.array_sort(F.when(F.size("m") <= 2, plain("m")).when(F.size(named) >= 2, plain(named)).otherwise(plain(fullest)))
    left, right, two = F.get("m", F.lit(0)), F.get("m", F.lit(1)), F.size("m") == 2
    over = left["both"] & right["role"].isNull()
    told = lambda a, b: F.coalesce((left["role"] == a) & (right["role"] == b), F.lit(False))
    straight = two & (told("withdrawal", "deposit") | (over & left["out_first"] & ~told("deposit", "withdrawal")))
    crossed = two & ~straight & (told("deposit", "withdrawal") | over)
    a, b = F.get(pick, F.lit(0))["col"], F.get(pick, F.lit(1))["col"]
    neither = ~(F.coalesce(straight, F.lit(False)) | F.coalesce(crossed, F.lit(False)))
    roles = {
        "date": F.col("date"), "balance": F.col("balance"), "description": F.col("description"), "withdrawal": F.when(straight, a).when(crossed, b),
        "deposit": F.when(straight, b).when(crossed, a), "amount": F.when(neither, a), "amount2": F.when(neither, b),
    }
    return d.select("file", F.inline(F.array(*[F.struct(F.lit(k).alias("role"), v.cast("long").alias("col")) for k, v in roles.items()]))).where("col is not null")


def separate_words(words: DataFrame, least: float = 2.0) -> DataFrame:
    """Words whose boxes touch the next one's on their line lose what is nearer than ``least``, half of themselves at most.

    Words: ``page, place`` (reading order), ``x0, y0, x1, y1``.
    """
    after = F.lead(F.struct("x0", "y0", "y1")).over(W.partitionBy("page").orderBy("place", "x0", "x1"))
    d = words.withColumn("_b", after)
    same = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("_b.y0") + F.col("_b.y1")) / 2) < (F.col("_b.y1") - F.col("_b.y0")) / 2
    tight = same & (F.col("_b.x0") > F.col("x0")) & (F.col("_b.x0") - F.col("x1") < least)
    return d.withColumn("x1", F.when(tight, F.greatest(F.col("x0") + (F.col("x1") - F.col("x0")) * 0.5, F.col("_b.x0") - least)).otherwise(F.col("x1"))).drop("_b")


def passbook_rows(lines: DataFrame) -> DataFrame:
    """A book's printed lines as table rows: ``book, page, row, date, description, amount, balance, doubt, hint``.

    Lines: ``book, page, line, date, amount, balance`` (texts as printed), ``margin`` (certainty of the date).  Empty lines are none; the
    first line with a balance alone is brought forward; a day that sure lines on both sides agree on is offered, never filled in.
    """
    d = lines.where(F.coalesce(F.nullif("date", F.lit("")), F.nullif("amount", F.lit("")), F.nullif("balance", F.lit(""))).isNotNull())
    own = W.partitionBy("book").orderBy("page", "line")
    sure = F.coalesce(F.col("margin") >= DATE_SURE, F.lit(True))
    dated = F.when(F.coalesce("date", F.lit("")) != "", F.struct("date", sure.alias("sure")))
    up = F.last(dated, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    down = F.first(dated, ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))
    d = d.withColumns({"_u": up, "_d": down, "_n": F.row_number().over(own), "row": F.row_number().over(W.partitionBy("book", "page").orderBy("line")).cast("long")})
    around = F.when(F.col("_u.sure") & F.col("_d.sure") & (F.col("_u.date") == F.col("_d.date")), F.col("_u.date"))
    alone = (F.col("_n") == 1) & (F.coalesce("amount", F.lit("")) == "") & (F.coalesce("balance", F.lit("")) != "")
    doubt = F.when((F.coalesce("date", F.lit("")) != "") & ~sure, F.concat(F.lit("the reader was unsure of the date (reads "), "date", F.lit(") - check the date")))
    hint = F.when(~F.coalesce(F.col("date") == around, F.lit(False)), F.concat(F.lit("the lines either side both read "), around, F.lit(" - it may be "), around, F.lit("; check the paper")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return d.select(
        "book", "page", "row", blank("date").alias("date"), F.when(alone, "B/F").otherwise("").alias("description"), blank("amount").alias("amount"),
        F.regexp_replace(blank("balance"), r"^\*", "").alias("balance"), doubt.alias("doubt"), hint.alias("hint"),
    )


def passbook_lines(lines: DataFrame) -> DataFrame:
    """A book's printed lines as ``statements.lines_statement`` takes them: ``stmt_id, seq, day, amount, balance, sign, stated_opening, date_note``.

    A first line with a balance alone opens the book and is no line of it.
    """
    own = W.partitionBy("book").orderBy("page", "line")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bare = [F.ltrim(F.col(c), F.lit("*+-")).alias(c) for c in ("amount", "balance")]
    read = [money_cell(F.col(c))["cents"].alias(c) for c in ("amount", "balance")]
    given = lines.select("book", "page", "line", "date", "margin", *bare, F.left("amount", F.lit(1)).alias("sign")).select("book", "page", "line", "date", "margin", *read, "sign")
    opens = (F.col("_n") == 1) & F.col("amount").isNull() & F.col("balance").isNotNull()
    d = given.withColumn("_n", F.row_number().over(own)).withColumn("stated_opening", F.first(F.when(opens, F.col("balance"))).over(whole))
    day = passbook_date(F.col("date"))
    unsure = F.concat(F.lit("the reader was unsure of the date (reads "), F.date_format(day, "dd/MM/yyyy"), F.lit(") - check the date"))
    return d.where(~F.coalesce(opens, F.lit(False))).select(
        F.col("book").alias("stmt_id"), F.col("_n").cast("long").alias("seq"), day.alias("day"), "amount", "balance", "sign", "stated_opening", F.when(F.col("margin") < DATE_SURE, unsure).alias("date_note")
    )


def line_hints(rows: DataFrame) -> DataFrame:
    """Adds ``hints``, what a person may look for on the paper, joined by '; ' (empty if nothing); nothing is changed by them.

    Rows: ``stmt_id, seq, opening, opening_derived, amount, balance, amount_text, balance_text, light``.  A plus read as a 4, a comma and a
    dot mixed up where the balance agrees with the other reading, an amount missing between two balances.
    """
    own = statement()
    start = F.lag("seq").over(own).isNull()
    d = rows.withColumns({"_start": start, "_before": F.when(start, F.col("opening")).otherwise(F.lag("balance").over(own)), "_next": F.lead(F.struct("amount", "balance")).over(own)})
    moved = F.abs(F.col("balance") - F.col("_before"))
    digits, held = F.col("amount").cast("string"), F.col("light") != "green"
    plus = held & (moved > 0) & (F.length(digits) > 3) & digits.startswith("4") & (F.substr(digits, F.lit(2)).try_cast("bigint") == moved)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = fmt_comma(moved)

    def other(text: str, agrees) -> Column:
        fix = separator_fix(F.col(text))
        cents = let(money_cell(fix), lambda r: r["cents"])
        said = say('"', F.col(text), '" may be ', fix, " (a comma and a dot mixed up) - the balance agrees with ", fmt_comma(cents), " - check the paper, then tap Use")
        return F.when(held & agrees(cents), said)

    by_next = lambda c: (F.abs(c - F.col("_before")) == F.col("amount")) | (F.abs(F.col("_next.balance") - c) == F.col("_next.amount"))
    gap = F.col("amount").isNull() & (F.col("balance") != F.col("_before")) & ~(F.col("_start") & F.col("opening_derived"))
    sign = F.when(F.col("balance") > F.col("_before"), "+").otherwise("-")
    hints = F.concat_ws(
        "; ",
        F.when(plus, say("this may be +", shown, ' with the "+" read as a 4 - the balance agrees with ', shown, "; check the paper")),
        other("amount_text", lambda c: moved == c), other("balance_text", by_next),
        F.when(gap, say("the balance changed by ", sign, shown, " - that may be the amount, if the balance above was read right; type it from the paper")),
    )
    return d.withColumn("hints", hints).drop("_start", "_before", "_next")


def translate_labels(cells: DataFrame, words: dict[str, str], sheets: dict[str, str]) -> DataFrame:
    """The tool's own labels in another language, by their places on its sheets; what a statement says stays as it is.

    Cells: ``sheet, row, col, kind, text, last_row`` (the sheet's).  ``words`` and ``sheets``: the dictionary, a fixed list.
    """
    at, row, col, text = (F.col(c) for c in ("sheet", "row", "col", "text"))
    ours = (
        F.when(at == "Transactions", (row == 0) | ((row > 0) & (col == 8)) | ((row > 0) & row.isin(1) | (row > 0) & (row == F.col("last_row"))) & (col == 2) & text.rlike(r"^(Opening|Closing) balance\z"))
        .when(at == "Daily", (row == 0) | (col == 6) | (col == 0) & F.contains(text, F.lit(" days, "))).when(at == "Proof", col <= 2)
        .when(at == "Rows to check", (row == 0) & (col == 0) | (row == 1) | (row > 1) & (col == 7)).otherwise(F.lit(False))
    )
    said = lambda d, c: F.coalesce(*[F.when(c == k, v) for k, v in d.items()], c)
    return cells.withColumn("text", F.when(ours & (F.col("kind") == "text"), said(words, text)).otherwise(text)).withColumn("sheet", said(sheets, at))
