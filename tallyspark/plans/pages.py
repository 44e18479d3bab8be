"""Queries of words and pages: each input is SQL that Spark and DuckDB both run over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words
from ..operators import pages, statements
from .ledger import LEDGER
from .queries import ORACLES, query, table
from .statements import LINES


def given(spark, sf_dir, sql: str, name: str):
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


# Words

BARS = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '|' || c_mktsegment WHEN 1 THEN '(' || c_mktsegment || '|' || c_name || ')' WHEN 2 THEN '|' ELSE c_name END AS t,
  CAST(c_custkey % 500 AS DOUBLE) AS x0, CAST(c_custkey % 500 + 64 AS DOUBLE) AS x1 FROM customer"""


@query(f"""WITH b AS ({BARS}), p AS (SELECT *, string_split(t, '|') AS parts FROM b), u AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p),
a AS (SELECT *, parts[i] AS part, CASE WHEN i > 1 THEN length(array_to_string(parts[1:i - 1], '|')) + 1 ELSE 0 END AS before FROM u)
SELECT k, regexp_replace(part, '^[|()]+|[|()]+$', '', 'g') AS text, round(x0 + before * (x1 - x0) / length(t), 6) AS x0, round(x0 + (before + length(part)) * (x1 - x0) / length(t), 6) AS x1 FROM a
WHERE regexp_replace(part, '^[|()]+|[|()]+$', '', 'g') <> ''""")
def edge_words(spark, sf_dir):
    d = given(spark, sf_dir, BARS, "customer").select("k", F.inline(words.clean_edges(F.col("t"), F.col("x0"), F.col("x1"))))
    return d.select("k", "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("""SELECT o_orderkey AS k, o_orderpriority || ' status ' || o_orderstatus AS description FROM orders""")
def stripped_wraps(spark, sf_dir):
    said = F.concat(F.lit("NOTE:"), "o_orderpriority", F.lit(" status REF  "), "o_orderstatus", F.lit(" NOTE:"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), words.without_labels(said, ["NOTE:", "REF"]).alias("description"))


BLANKS = r"[\p{M}\p{Z}\t\n\x0b\f\r\x{feff}]+"


@query(rf"""WITH b AS (SELECT doc_id, regexp_replace(nfc_normalize('e' || chr(769) || ' ' || 'ช' || chr(3656) || 'อง ' || COALESCE(text, '')), '{BLANKS}', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM b""")
def bare_texts(spark, sf_dir):
    t = words.bare(F.concat(F.lit("é ช่อง "), F.coalesce("text", F.lit(""))))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query("SELECT o_orderkey AS k, o_orderkey % 6 < 4 AS is_date FROM orders")
def date_words(spark, sf_dir):
    said = F.expr("""element_at(array(date_format(o_orderdate, 'dd/MM/yyyy'), date_format(o_orderdate, 'd.M.yy'), concat(date_format(o_orderdate, 'dd'), '-มิ.ย.-2569'),
      concat(date_format(o_orderdate, 'dd'), '-9.0.-2569'), concat(date_format(o_orderdate, 'dd/MM'), '/'), concat(o_orderkey, '.00')), int(o_orderkey % 6 + 1))""")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), words.is_date_word(said).alias("is_date"))


@query("""WITH b AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN CAST(c AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS text FROM b""")
def tidy_words(spark, sf_dir):
    c = F.round(F.col("o_totalprice") * 100).cast("bigint")
    dots = F.concat(F.replace(F.format_number(F.floor(c / 100), 0), F.lit(","), F.lit(".")), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, dots).when(k % 4 == 2, F.date_format("o_orderdate", "dd|MM|yyyy")).otherwise(c.cast("string"))
    kind = F.when(k % 4 < 2, "money").when(k % 4 == 2, "date").otherwise("text")
    return table(spark, sf_dir, "orders").select(k.alias("k"), words.tidy(said, kind).alias("text"))


BOXES = """SELECT l_orderkey AS page, l_linenumber AS place, CAST(l_linenumber % 4 * 40 AS DOUBLE) AS x0, CAST(l_linenumber % 4 * 40 + 8 + l_quantity AS DOUBLE) AS x1,
  CAST(l_linenumber // 4 * 20 AS DOUBLE) AS y0, CAST(l_linenumber // 4 * 20 + 10 AS DOUBLE) AS y1 FROM lineitem"""


@query(f"""WITH b AS ({BOXES}), n AS (SELECT *, LEAD(x0) OVER w AS nx, LEAD(y0) OVER w AS ny FROM b WINDOW w AS (PARTITION BY page ORDER BY place, x0, x1))
SELECT page, place, x0, CASE WHEN ny = y0 AND nx > x0 AND nx - x1 < 2 THEN greatest((x0 + x1) / 2, nx - 2) ELSE x1 END AS x1 FROM n""")
def separate_words(spark, sf_dir):
    return pages.separate_words(given(spark, sf_dir, BOXES.replace("l_linenumber // 4", "(l_linenumber div 4)"), "lineitem")).select("page", "place", "x0", "x1")


# Pages


@query("""SELECT c_custkey AS file, CASE WHEN c_custkey % 6 = 1 THEN 'own-picture-file' ELSE 'own-review-file' END AS kind FROM customer WHERE c_custkey % 6 IN (0, 1, 4, 5)""")
def own_files(spark, sf_dir):
    """Files of two rows; the tool's own by its Check column, by the picture file's first row, or by a mark, and others that look alike."""
    top = "array('Date', 'Balance', 'Deposit', 'Check')"
    rows = f"""CASE c_custkey % 6 WHEN 0 THEN array({top}, array('1', '2', '3', 'OK')) WHEN 1 THEN array(array('Read from statement pictures on this computer - check every figure', 'Check'), {top})
      WHEN 2 THEN array(array('Date', 'Amount', 'Name', 'Check'), array('1', '2', '3', 'OK')) WHEN 3 THEN array({top}, array('1', '2', '3', '12 345'))
      WHEN 4 THEN array(array('', ' How this file was checked '), array(c_name)) ELSE array(array(c_name), array('ผลตรวจ', 'ถอน', 'ฝาก', 'ยอดคงเหลือ'), array('ดู', '1', '2', '3')) END"""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.posexplode(F.expr(rows)).alias("row", "cells"))
    return pages.own_file_kind(files.select("file", F.lit(0).alias("sheet"), "row", F.posexplode("cells").alias("col", "text")))


SHEETS = "SELECT user_id AS batch, event_id AS place, event_type || CAST(event_id % 11 AS STRING) AS key, event_id % 7 = 0 AS blank FROM events"


@query(f"""WITH b AS (SELECT * FROM ({SHEETS}) AS s WHERE NOT blank), f AS (SELECT *, place = min(place) OVER (PARTITION BY batch, key) AS fresh FROM b),
n AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY place) AS BIGINT) AS n FROM f)
SELECT batch, place, CASE WHEN n - CASE WHEN fresh THEN 1 ELSE 0 END >= 30 THEN 'too-many' WHEN NOT fresh THEN 'same-file' ELSE 'page' END AS state, CASE WHEN fresh AND n <= 30 THEN n END AS page FROM n""")
def sheet_pages(spark, sf_dir):
    return pages.sheet_pages(given(spark, sf_dir, SHEETS, "events")).select("batch", "place", "state", "page")


@query("""WITH b AS (SELECT o_custkey AS set_id, o_orderkey AS page, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 9 <> 0),
n AS (SELECT *, COALESCE(LAG(s) OVER (PARTITION BY set_id ORDER BY page) <> s, true) AS fresh FROM b)
SELECT set_id, page, CAST(0 AS INTEGER) AS line, 'heading' AS kind, 'Date|' || s AS text FROM n WHERE fresh UNION ALL SELECT set_id, page, 1, 'line', p || '|' || page FROM n""")
def heading_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = F.when(F.col("o_orderkey") % 18 == 9, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("Date"), "o_orderstatus"), F.array("o_orderpriority", F.col("o_orderkey").cast("string"))))
    d = o.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 18 == 0, "unread").alias("error"), rows.alias("rows"))
    return pages.heading_rows(d).select("set_id", "page", "line", "kind", F.array_join("cells", "|").alias("text"))


BANDS = """SELECT l_orderkey AS page, l_linenumber AS line, CAST(l_linenumber * 9 AS DOUBLE) AS y0, CAST(l_linenumber * 9 + 8 AS DOUBLE) AS y1,
  CASE WHEN l_returnflag = 'R' THEN 'Date of entry' WHEN l_returnflag = 'A' THEN 'Your Balance' ELSE 'words' END AS text FROM lineitem"""


@query(f"""WITH b AS ({BANDS}), r AS (SELECT page, line, min(y0) AS y0, bool_or(text LIKE 'Date%') AS d, bool_or(text LIKE '%Balance%') AS e FROM b GROUP BY ALL),
n AS (SELECT page, line, d, e, LEAD(line) OVER w AS above, LAG(line) OVER w AS below, LEAD(e) OVER w AS above_e, LAG(e) OVER w AS below_e FROM r WINDOW w AS (PARTITION BY page ORDER BY line)),
f AS (SELECT page, line, CASE WHEN below = line - 1 THEN line - 1 ELSE line END AS lo, CASE WHEN above = line + 1 THEN line + 1 ELSE line END AS hi FROM n WHERE d AND (e OR above = line + 1 AND above_e OR below = line - 1 AND below_e))
SELECT page, CAST(arg_min(lo, line) * 9 AS DOUBLE) AS top, CAST(arg_min(hi, line) * 9 + 8 AS DOUBLE) AS bottom FROM f GROUP BY page""")
def header_bands(spark, sf_dir):
    return pages.header_bands(given(spark, sf_dir, BANDS, "lineitem"))


@query("""WITH b AS (SELECT s_suppkey AS file, s_suppkey % 6 AS k FROM supplier)
SELECT file, 'date' AS role, CAST(0 AS BIGINT) AS col FROM b UNION ALL SELECT file, 'balance', 4 FROM b UNION ALL SELECT file, 'description', 1 FROM b
UNION ALL SELECT file, 'withdrawal', CASE k WHEN 1 THEN 3 ELSE 2 END FROM b WHERE k IN (0, 1, 2) UNION ALL SELECT file, 'deposit', CASE k WHEN 1 THEN 2 ELSE 3 END FROM b WHERE k IN (0, 1, 2)
UNION ALL SELECT file, 'amount', 2 FROM b WHERE k IN (3, 4, 5) UNION ALL SELECT file, 'amount2', CASE k WHEN 5 THEN 6 ELSE 3 END FROM b WHERE k IN (3, 5)""")
def content_roles(spark, sf_dir):
    """Tables of five to seven columns: told by two headings, told crosswise, by one heading over both, not told, with a tax column, and with three amounts."""
    heads = """CASE s_suppkey % 6 WHEN 0 THEN array('Withdrawal', 'Deposit') WHEN 1 THEN array('ฝาก', 'ถอน') WHEN 2 THEN array('ถอนเงิน / ฝากเงิน', 'smudge') WHEN 3 THEN array('Amount', 'smudge')
      WHEN 4 THEN array('Amount', 'Tax') ELSE array('first', 'second') END"""
    sql = f"""SELECT file, k, c.* FROM (SELECT s_suppkey AS file, s_suppkey % 6 AS k, {heads} AS h FROM supplier) AS f
      LATERAL VIEW inline(array(named_struct('col', 0, 'kind', 'date', 'is_balance', false, 'right_edge', 50.0D, 'filled', 9, 'length', 90, 'heading', 'Date'),
        named_struct('col', 1, 'kind', 'text', 'is_balance', false, 'right_edge', 90.0D, 'filled', 9, 'length', 200, 'heading', 'Details'),
        named_struct('col', 2, 'kind', 'money', 'is_balance', false, 'right_edge', 200.0D, 'filled', 5, 'length', 40, 'heading', h[0]),
        named_struct('col', 3, 'kind', 'money', 'is_balance', false, 'right_edge', 300.0D, 'filled', 4, 'length', 40, 'heading', h[1]),
        named_struct('col', 4, 'kind', 'money', 'is_balance', true, 'right_edge', 400.0D, 'filled', 9, 'length', 80, 'heading', 'Balance'),
        named_struct('col', 5, 'kind', 'text', 'is_balance', false, 'right_edge', 500.0D, 'filled', 9, 'length', 70, 'heading', ''),
        named_struct('col', 6, 'kind', CASE WHEN k = 5 THEN 'money' ELSE 'text' END, 'is_balance', false, 'right_edge', 600.0D, 'filled', 7, 'length', 30, 'heading', 'third'))) c AS col, kind, is_balance, right_edge, filled, length, heading"""
    return pages.roles_by_content(given(spark, sf_dir, sql, "supplier"))


# Passbooks

CENTS = "CAST(CAST({0} / 100.0 AS DECIMAL(18,2)) AS STRING)"
BOOK = f"""SELECT stmt_id AS book, CAST(FLOOR((seq - 1) / 20) AS BIGINT) AS page, seq AS line, row_id, CASE WHEN row_id % 5 <> 0 THEN substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || CAST(year(day) + 543 - 2500 AS STRING) END AS date,
  CASE WHEN seq > 1 OR row_id % 2 = 0 THEN CASE WHEN row_id % 13 <> 0 THEN CASE WHEN x1 < 250 THEN '-' ELSE '+' END || {CENTS.format('amount')} END END AS amount, CASE WHEN balance > 0 THEN '*' || {CENTS.format('balance')} END AS balance,
  CASE WHEN row_id % 6 = 0 THEN CAST(0.01 AS DOUBLE) WHEN row_id % 6 < 4 THEN CAST(0.4 AS DOUBLE) END AS margin FROM (SELECT *, CAST(CAST(date_trunc('year', day) AS DATE) AS STRING) AS d FROM ({LEDGER}) AS l) AS m"""


@query(f"""WITH b AS (SELECT *, COALESCE(margin >= 0.05, true) AS sure FROM ({BOOK}) AS x WHERE date IS NOT NULL OR amount IS NOT NULL OR balance IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY line) AS row, row_number() OVER (PARTITION BY book ORDER BY line) AS nth,
  last_value(CASE WHEN date IS NOT NULL THEN date || sure END IGNORE NULLS) OVER (PARTITION BY book ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u,
  first_value(CASE WHEN date IS NOT NULL THEN date || sure END IGNORE NULLS) OVER (PARTITION BY book ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS v FROM b),
o AS (SELECT *, CASE WHEN u = v AND u LIKE '%true' THEN replace(u, 'true', '') END AS around FROM n)
SELECT book, page, row, COALESCE(date, '') AS date, CASE WHEN nth = 1 AND amount IS NULL AND balance IS NOT NULL THEN 'B/F' ELSE '' END AS description, COALESCE(amount, '') AS amount, COALESCE(replace(balance, '*', ''), '') AS balance,
  CASE WHEN date IS NOT NULL AND NOT sure THEN 'the reader was unsure of the date (reads ' || date || ') - check the date' END AS doubt,
  CASE WHEN date IS DISTINCT FROM around THEN 'the lines either side both read ' || around || ' - it may be ' || around || '; check the paper' END AS hint FROM o""")
def passbook_rows(spark, sf_dir):
    return pages.passbook_rows(given(spark, sf_dir, BOOK, "orders"))


@query(f"""WITH b AS ({BOOK}), n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY line) AS seq FROM b), f AS (SELECT *, seq = 1 AND amount IS NULL AND balance IS NOT NULL AS opens FROM n),
o AS (SELECT *, max(CASE WHEN opens THEN CAST(CAST(substr(balance, 2) AS DECIMAL(18,2)) * 100 AS BIGINT) END) OVER (PARTITION BY book) AS stated_opening FROM f)
SELECT book AS stmt_id, seq, CAST(CASE WHEN date IS NOT NULL THEN make_date(CAST(substr(date, 7) AS INTEGER) + 1957, CAST(substr(date, 4, 2) AS INTEGER), CAST(substr(date, 1, 2) AS INTEGER)) END AS DATE) AS day, CAST(abs(CAST(amount AS DECIMAL(18,2))) * 100 AS BIGINT) AS amount,
  CAST(CAST(substr(balance, 2) AS DECIMAL(18,2)) * 100 AS BIGINT) AS balance, substr(amount, 1, 1) AS sign, stated_opening,
  CASE WHEN margin < 0.05 AND date IS NOT NULL THEN 'the reader was unsure of the date (reads ' || substr(date, 1, 6) || (CAST(substr(date, 7) AS INTEGER) + 1957) || ') - check the date' END AS date_note FROM o WHERE NOT opens""")
def passbook_lines(spark, sf_dir):
    return pages.passbook_lines(given(spark, sf_dir, BOOK, "orders"))


@query(ORACLES["lines_statement"].replace(LINES, ORACLES["passbook_lines"]))
def passbook_statement(spark, sf_dir):
    """The whole way from printed lines to proved rows."""
    d = statements.lines_statement(pages.passbook_lines(given(spark, sf_dir, BOOK, "orders")))
    return d.select("stmt_id", "seq", "verified", "withdrawal", "deposit", "reading", "sign_note")


# Hints and labels

DOUBTFUL = f"""SELECT stmt_id, seq, opening, seq % 2 = 0 AS opening_derived, balance, CASE WHEN row_id % 5 = 0 THEN CAST('4' || CAST(amount AS STRING) AS BIGINT) WHEN row_id % 11 <> 3 THEN amount END AS amount,
  CASE WHEN row_id % 3 = 0 THEN 'red' ELSE 'green' END AS light, CASE WHEN row_id % 2 = 0 AND amount >= 100000 AND amount < 100000000 THEN
    CAST(amount AS STRING) END AS digits FROM ({LEDGER}) AS l"""
MIXED = "CASE WHEN digits IS NOT NULL THEN substr(digits, 1, length(digits) - 5) || '.' || substr(digits, length(digits) - 4, 3) || ',' || substr(digits, length(digits) - 1) END"
SHOWN = "format('{:,}', %s // 100) || '.' || lpad(CAST(%s %% 100 AS VARCHAR), 2, '0')"


def _shown(c: str) -> str:
    return SHOWN % (c, c)


@query(f"""WITH b AS (SELECT *, {MIXED} AS mixed FROM ({DOUBTFUL}) AS x), w AS (SELECT *, row_number() OVER o = 1 AS start, CASE WHEN row_number() OVER o = 1 THEN opening ELSE LAG(balance) OVER o END AS bef FROM b WINDOW o AS (PARTITION BY stmt_id ORDER BY seq)),
m AS (SELECT *, abs(balance - bef) AS moved FROM w)
SELECT stmt_id, seq, concat_ws('; ',
  CASE WHEN light <> 'green' AND moved > 0 AND length(CAST(amount AS VARCHAR)) > 3 AND CAST(amount AS VARCHAR) = '4' || moved THEN 'this may be +' || {_shown('moved')} || ' with the "+" read as a 4 - the balance agrees with ' || {_shown('moved')} || '; check the paper' END,
  CASE WHEN light <> 'green' AND CAST(digits AS BIGINT) = moved THEN '"' || mixed || '" may be ' || {_shown('moved')} || ' (a comma and a dot mixed up) - the balance agrees with ' || {_shown('moved')} || ' - check the paper, then tap Use' END,
  CASE WHEN amount IS NULL AND balance <> bef AND NOT (start AND opening_derived) THEN 'the balance changed by ' || CASE WHEN balance > bef THEN '+' ELSE '-' END || {_shown('moved')} || ' - that may be the amount, if the balance above was read right; type it from the paper' END) AS hints FROM m""")
def line_hints(spark, sf_dir):
    d = given(spark, sf_dir, f"SELECT *, {MIXED} AS amount_text, CAST(NULL AS STRING) AS balance_text FROM ({DOUBTFUL}) AS x", "orders")
    return pages.line_hints(d).select("stmt_id", "seq", "hints")


#: Some of the labels' words and the sheets' names in Thai.
LABELS = {"Date": "วันที่", "Description": "รายการ", "Balance": "ยอดคงเหลือ", "Check": "ผลตรวจ", "Opening balance": "ยอดยกมา"}
SHEET_NAMES = {"Transactions": "รายการ", "Daily": "รายวัน", "Proof": "การตรวจสอบ"}
LABELLED = """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Transactions' WHEN 1 THEN 'Daily' WHEN 2 THEN 'Proof' WHEN 3 THEN 'Rows to check' ELSE 'BKTRN' END AS sheet, o_orderkey % 4 AS row, o_orderkey % 9 AS col,
  CASE WHEN o_orderkey % 7 = 0 THEN 'number' ELSE 'text' END AS kind, 3 AS last_row, CASE o_orderkey % 11 WHEN 0 THEN 'Date' WHEN 1 THEN 'Check' WHEN 2 THEN 'Balance' WHEN 3 THEN o_orderpriority ELSE 'Opening balance' END AS text FROM orders"""


@query(f"""WITH b AS ({LABELLED}), o AS (SELECT *, kind = 'text' AND CASE k % 5 WHEN 0 THEN row = 0 OR col = 8 OR row IN (1, 3) AND col = 2 AND text = 'Opening balance' WHEN 1 THEN row = 0 OR col = 6 WHEN 2 THEN col <= 2
  WHEN 3 THEN row = 0 AND col = 0 OR row = 1 OR row > 1 AND col = 7 ELSE false END AS ours FROM b)
SELECT k, CASE k % 5 WHEN 0 THEN 'รายการ' WHEN 1 THEN 'รายวัน' WHEN 2 THEN 'การตรวจสอบ' ELSE sheet END AS sheet, CASE WHEN ours THEN CASE text WHEN 'Date' THEN 'วันที่' WHEN 'Check' THEN 'ผลตรวจ' WHEN 'Balance' THEN 'ยอดคงเหลือ' WHEN 'Opening balance' THEN 'ยอดยกมา' ELSE text END ELSE text END AS text FROM o""")
def translated_labels(spark, sf_dir):
    return pages.translate_labels(given(spark, sf_dir, LABELLED, "orders"), LABELS, SHEET_NAMES).select("k", "sheet", "text")
