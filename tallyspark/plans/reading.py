"""Queries of words as a picture's reader gives them, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily, extract, reading, review
from ..scratch import kept
from ..sinks import workbooks
from ..sources import tables
from . import unlisted
from .ledger import LEDGER
from .lookups import PRINTED, placed_words
from .queries import DAILY, ORACLES, event_rows, query, table

#: Thai words and months that pages are printed with: by a row's key, so that all lengths and marks come up.
WORDS = ("ยอดคงเหลือ", "วันที่", "ถอนเงิน", "ฝาก", "ค่าธรรมเนียม", "ที่", "น้ำ")


@query(f"""SELECT c_nationkey * 1000 + c_custkey // 200 AS page, c_custkey * 100 AS word, ['{"', '".join(WORDS)}'][1 + c_custkey % 7] AS text FROM customer
UNION ALL SELECT c_nationkey * 1000 + c_custkey // 200, c_custkey * 100 + 50, lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || '-' || ['{"', '".join(reading.THAI_MONTHS)}'][1 + c_custkey % 12] || '-2569' FROM customer
UNION ALL SELECT c_nationkey * 1000 + c_custkey // 200, c_custkey * 100 + 90, c_mktsegment FROM customer""")
def joined_letters(spark, sf_dir):
    """Lines of a Thai word, a Thai date and a Latin word that were cut into letters, whole again; marks stand above or below their letter."""
    # The printed page number repeats between nations from key 200,000 on; letters meet on pages of one nation's block of keys only.
    block = F.floor(F.col("c_custkey") / 200)
    own = F.coalesce(F.concat(F.col("c_nationkey"), F.lit("|"), block, F.lit("|"), F.col("c_nationkey") * 1000 + block), F.lit(""))
    c = table(spark, sf_dir, "customer").select(own.alias("page"), F.col("c_custkey").alias("k"), "c_mktsegment")
    y = F.col("k") % 200 * 20.0 + 10
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("k") % 7 + 1).cast("int"))
    month = F.element_at(F.array(*map(F.lit, reading.THAI_MONTHS)), (F.col("k") % 12 + 1).cast("int"))
    date = F.concat(F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit("-|"), F.regexp_replace(month, "(.)", "$1|"), F.lit("-2569"))

    def letters(text, at, first):
        """Each letter six wide; a mark has its letter's place, above it."""
        parts = F.split(F.regexp_replace(text, r"(.)", "$1|"), r"\|")
        place = lambda i: F.length(F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), i + 1), ""), r"\p{M}", "")) - 1
        is_mark = lambda p: p.rlike(r"^\p{M}\z")
        box = lambda p, i: F.struct((first + i).alias("i"), (at + place(i) * 6.0).alias("x0"), F.when(is_mark(p), y - 2).otherwise(y).alias("y0"), (at + place(i) * 6.0 + 6).alias("x1"), F.when(is_mark(p), y + 5).otherwise(y + 9).alias("y1"), p.alias("text"))
        return F.filter(F.transform(parts, box), lambda w: w["text"] != "")

    def pieces(text, at, first):
        """Parts between bars, each as wide as its letters, two points apart."""
        parts = F.filter(F.split(text, r"\|"), lambda p: p != "")
        start = lambda i: at + F.length(F.array_join(F.slice(parts, F.lit(1), i), "")) * 5.0 + i * 2.0
        return F.transform(parts, lambda p, i: F.struct((first + i).alias("i"), start(i).alias("x0"), y.alias("y0"), (start(i) + F.length(p) * 5.0).alias("x1"), (y + 9).alias("y1"), p.alias("text")))

    whole = F.array(F.struct(F.lit(90).alias("i"), F.lit(400.0).alias("x0"), y.alias("y0"), F.lit(460.0).alias("x1"), (y + 9).alias("y1"), F.col("c_mktsegment").alias("text")))
    d = c.select("page", "k", F.explode(F.concat(letters(word, F.lit(10.0), F.lit(0)), pieces(date, F.lit(200.0), F.lit(50)), whole)).alias("w"))
    words = d.select("page", (F.col("k") * 100 + F.col("w.i")).alias("word"), "w.x0", "w.y0", "w.x1", "w.y1", "w.text")
    printed = F.element_at(F.split("page", r"\|"), -1).try_cast("bigint")
    return reading.join_thai(words, 4.0).select(printed.alias("page"), "word", "text")


@query(f"""WITH t AS ({PRINTED}), w AS (SELECT *, CASE WHEN (p_partkey + j) % 4 = 0 THEN 4.0 ELSE 8.0 END AS h, 20.0 * (p_partkey % 20) + CASE WHEN j % 2 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 3.0 ELSE 2.0 END ELSE 0.0 END AS yc FROM t),
m AS (SELECT page, p_partkey, list_sort(list(yc - h / 2)) AS tops, list_sort(list(yc + h / 2)) AS bottoms FROM w GROUP BY page, p_partkey)
SELECT w.page, w.word, CAST(tops[len(tops) // 2 + 1] AS DOUBLE) AS y0, CAST(bottoms[len(bottoms) // 2 + 1] AS DOUBLE) AS y1 FROM w JOIN m USING (page, p_partkey)""")
def levelled_lines(spark, sf_dir):
    """Words of unequal heights and places on one line get the line's middle top and bottom."""
    return reading.level_lines(placed_words(spark, sf_dir)).select("page", "word", "y0", "y1")


BOXES = """SELECT l_suppkey AS k, CAST(round((1 + l_linenumber % 5 + l_partkey % 9) * (9.3 + l_suppkey % 8 * 0.08)) - 2 AS DOUBLE) AS width, CAST(16 * 0.6 AS DOUBLE) AS size FROM lineitem"""


@query(f"""WITH g AS (SELECT k, size, width, count(*) AS n FROM ({BOXES}) GROUP BY ALL), t AS (SELECT k, width, n, size * CAST(0.93 AS DOUBLE) + i * CAST(0.02 AS DOUBLE) AS p FROM g, UNNEST(range(0, CAST(floor(CAST(9.6 AS DOUBLE) * 0.14 / 0.02 + 1e-9) AS BIGINT) + 1)) AS u(i)),
e AS (SELECT k, p, round(sum(CASE WHEN width >= 25 THEN abs((width + 2) / p - floor((width + 2) / p + CAST(0.5 AS DOUBLE))) * n ELSE 0 END), 9) AS e FROM t GROUP BY k, p)
SELECT k, round(p, 6) AS pitch FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e, p) AS r FROM e) WHERE r = 1""")
def box_pitch(spark, sf_dir):
    """The printer's box width of each supplier's lines, from the widths of their groups."""
    d = spark.sql(BOXES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return reading.pitch_of(d, "k").select("k", F.round("pitch", 6).alias("pitch"))


@query(f"""WITH l AS ({LEDGER}), f AS (SELECT stmt_id, stmt_id % 7 AS bank FROM l WHERE seq = 1 AND (x1 IS NOT NULL OR balance IS NOT NULL)), d AS (SELECT stmt_id % 7 AS bank, count(DISTINCT stmt_id) AS docs FROM l GROUP BY 1),
w AS (SELECT bank, h.text, count(*) AS n, CAST(any_value(h.x) + bank * 10 AS DOUBLE) AS x FROM f, (VALUES ('Date', 10.0, 0), ('Description', 80.0, 0), ('Amount', 230.0, 0), ('Balance', 380.0, 1)) AS h(text, x, named) WHERE named = 0 OR stmt_id % 10 <> 1 GROUP BY bank, h.text)
SELECT bank, text, n, x FROM w JOIN d USING (bank) WHERE n >= 0.5 * docs""")
def mined_anchors(spark, sf_dir):
    """Headings of seven banks, whose pages differ by a shift, found from the words above their first transactions."""
    lines = extract.lines_of(unlisted.printed_words(spark, sf_dir)).withColumn("bank", F.col("doc") % 7)
    return reading.anchor_words(lines)


@query("""WITH m AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS f FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, CAST(list_position(f, list_max(f)) - 1 AS VARCHAR) AS symbol FROM m""")
def free_readings(spark, sf_dir):
    """The symbol that fits best, whatever the shape of a figure asks for."""
    symbols = F.array(*[F.lit(str(i)) for i in range(10)])
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", reading.free_reading(F.slice("embedding", 1, 10), symbols).alias("symbol"))


#: The review workbooks' cells in SQL: each sheet's lines numbered, each cell under its column.
SERIAL = "CAST({0} - DATE '1899-12-30' AS DOUBLE)"
BOOK = f"""{DAILY}, tv AS (SELECT *, event_type IN ('purchase', 'error') AS out, CASE WHEN seq % 4 <> 0 THEN seq * 100 END AS balance, row_number() OVER (PARTITION BY stmt_id ORDER BY seq) AS idx FROM v),
ac AS (SELECT stmt_id, count(*) AS n, max(seq) * 100 AS closing, count(*) FILTER (seq % 9 <> 0) AS proved FROM v GROUP BY stmt_id),
dd AS (SELECT *, row_number() OVER (PARTITION BY stmt_id ORDER BY day) AS idx FROM ({ORACLES["daily_densify"].replace("WITH " + DAILY + ", cal", "WITH cal", 1)})),
ds AS (SELECT stmt_id, count(*) AS days, count(*) FILTER (n > 0) AS active, sum(n) AS n, sum(withdrawn) AS withdrawn, sum(deposited) AS deposited FROM dd GROUP BY stmt_id),
cl AS (
  SELECT stmt_id, 'Transactions' AS sheet, idx + 1 AS row, unnest([{SERIAL.format("day")}, NULL, CASE WHEN out THEN cents / 100.0::DOUBLE END, CASE WHEN NOT out THEN cents / 100.0::DOUBLE END, balance / 100.0::DOUBLE, NULL]) AS n,
    unnest([NULL, event_type, NULL, NULL, NULL, CASE WHEN seq % 9 <> 0 THEN 'OK' ELSE 'no. ' || seq END]) AS s, unnest([0, 2, 3, 4, 5, 8]) AS col FROM tv
  UNION ALL SELECT stmt_id, 'Transactions', 1, unnest([{SERIAL.format("DATE '2024-01-01'")}, NULL, 0]), unnest([NULL, 'Opening balance', NULL]), unnest([0, 2, 5]) FROM ac
  UNION ALL SELECT stmt_id, 'Transactions', n + 2, unnest([{SERIAL.format("DATE '2024-01-31'")}, NULL, closing / 100.0::DOUBLE]), unnest([NULL, 'Closing balance', NULL]), unnest([0, 2, 5]) FROM ac
  UNION ALL SELECT stmt_id, 'Daily', idx, unnest([{SERIAL.format("day")}, n, withdrawn / 100.0::DOUBLE, deposited / 100.0::DOUBLE, (deposited - withdrawn) / 100.0::DOUBLE, balance / 100.0::DOUBLE, NULL]),
    unnest([NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN n > 0 AND flagged > 0 THEN flagged || ' row(s) flagged' WHEN n > 0 THEN 'OK' END]), unnest([0, 1, 2, 3, 4, 5, 6]) FROM dd
  UNION ALL SELECT ds.stmt_id, 'Daily', ds.days + 1, unnest([NULL, ds.n, withdrawn / 100.0::DOUBLE, deposited / 100.0::DOUBLE, (deposited - withdrawn) / 100.0::DOUBLE, closing / 100.0::DOUBLE]), unnest([days || ' days, ' || active || ' active', NULL, NULL, NULL, NULL, NULL]), unnest([0, 1, 2, 3, 4, 5]) FROM ds JOIN ac USING (stmt_id)
  UNION ALL SELECT stmt_id, 'Proof', unnest([1, 3, 4, 5, 6, 7, 8, 9, 12]), NULL, unnest(['How this file was checked', 'user' || stmt_id || '.pdf', 'Bank ' || stmt_id % 3, 'User ' || stmt_id, '(not read)', '(not read)', '01/01/2024 to 31/01/2024', CAST(n AS VARCHAR), proved || ' of ' || n || ' rows verified']), unnest([0, 2, 2, 2, 2, 2, 2, 2, 2]) FROM ac)"""


@query(f"""WITH {BOOK}, r AS (SELECT stmt_id, CASE WHEN sheet = 'Proof' AND stmt_id % 3 <> 0 THEN row - 1 ELSE row END AS row, sheet, col, n, s FROM cl WHERE n IS NOT NULL OR s IS NOT NULL)
SELECT stmt_id, sheet, row, col, n, s FROM r""")
def review_cells(spark, sf_dir):
    """All three sheets of each account's review workbook, made by Spark, written, read again: every figure of transactions and days, the facts and the checks of the proof."""
    rows = kept(event_rows(spark, sf_dir), "review-rows")
    lines = rows.select("*", F.lit("").alias("time"), F.col("event_type").alias("description"), F.lit("").alias("channel"), F.lit("").alias("details"), F.concat(F.lit("no. "), F.col("seq").cast("string")).alias("note"))
    accounts = rows.groupBy("stmt_id").agg((F.max("seq") * 100).alias("closing"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("verified"), 1)).alias("proved")).selectExpr(
        "*", "cast(0 as bigint) as opening", "date '2024-01-01' as period_from", "date '2024-01-31' as period_to", "concat('in/user', stmt_id, '.pdf') as source", "concat('Bank ', stmt_id % 3) as bank",
        "concat('User ', stmt_id) as account_name", "cast(null as string) as account_no", "'' as branch", "if(stmt_id % 3 = 0, 'compare by eye', null) as caveat",
    )
    accounts = kept(accounts, "review-accounts")
    days = kept(daily.densify(daily.daily(rows), accounts), "review-days")
    checks = accounts.select("stmt_id", F.lit(1).alias("ord"), F.lit("Every row agrees with the running balance").alias("label"), (F.col("proved") == F.col("rows")).alias("passed"), F.concat(F.col("proved").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows verified")).alias("detail"))
    found = tables.made_cells(workbooks.sheet_files(review.sheets(lines, days, accounts, checks), "stmt_id", review.SHEETS))
    refused = F.raise_error(F.concat_ws(": ", "file", "error")).cast("boolean")
    found = found.where(F.when(F.col("error").isNotNull(), refused).otherwise(True))
    proof = F.col("sheet") == "Proof"
    wanted = F.when(proof, ((F.col("col") == 2) & (F.col("s") != "Detail")) | (F.col("s") == review.CHECKED)).otherwise(F.col("row") > 0)
    return found.where(wanted).select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("stmt_id"), "sheet", F.col("row").cast("long").alias("row"), "col", "n", "s")
