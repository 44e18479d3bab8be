"""Queries of page alignment, on pages that Spark derives from orders: turned, scaled and shifted as a reader sees them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import scratch
from ..operators import alignment, layout
from .queries import query, table

HEADINGS = (("Date", 60.0, 40.0), ("Withdrawal", 180.0, 40.0), ("Deposit", 300.0, 44.0), ("Balance", 440.0, 40.0))
COLUMNS = [("date", 40.0, 140.0, 1), ("withdrawal", 140.0, 270.0, 2), ("deposit", 270.0, 400.0, 3), ("balance", 400.0, 560.0, 4)]
WIDTH = 600.0

#: The words of the plain pages: a customer's orders as rows, headings above them; of every eleventh page one heading, of every seventh a summary mark alone.
PLAIN = """o AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey, CAST(o_totalprice AS VARCHAR) AS price FROM orders),
r AS (SELECT page, seq * 10 + j + 100 AS word, CASE j WHEN 0 THEN 'date' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'withdrawal' ELSE 'deposit' END ELSE 'balance' END AS "column" FROM o, generate_series(0, 2) t(j)),
h AS (SELECT page, k AS word, ['date', 'withdrawal', 'deposit', 'balance'][k + 1] AS "column" FROM (SELECT DISTINCT page FROM o), generate_series(0, 3) t(k) WHERE page % 7 <> 0),
m AS (SELECT DISTINCT page, 0 AS word, 'date' AS "column" FROM o WHERE page % 7 = 0)"""


def read_pages(spark, sf_dir):
    """page, word, x0, y0, x1, y1, text, page_width: the pages as read; a heading in two pieces on every third page."""
    own = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.row_number().over(own).alias("seq"), "o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    box = lambda word, x, y, text: F.struct(F.lit(word).cast("bigint").alias("word"), F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), text.alias("text"))
    y = F.lit(60.0) + F.col("seq") * 14
    first = F.col("seq") * 10 + 100
    amount_at = F.when(F.col("o_orderkey") % 2 == 0, 185.0).otherwise(305.0)
    rows = o.select("page", F.inline(F.array(box(first, 60.0, y, F.col("day")), box(first + 1, amount_at, y, F.col("price")), box(first + 2, 445.0, y, F.col("price")))))
    plain = F.when(F.col("page") % 7 == 0, F.lit(0)).when(F.col("page") % 11 == 0, F.lit(1)).otherwise(F.lit(len(HEADINGS)))
    heads = [box(k, x, y_, F.lit(t)) for k, (t, x, y_) in enumerate(HEADINGS)]
    split = [heads[0], heads[1], heads[2], box(3, 440.0, 40.0, F.lit("Bal")), box(4, 456.0, 40.0, F.lit("ance"))]
    all_heads = F.when((F.col("page") % 3 == 0) & (plain > 1), F.array(*split)).otherwise(F.slice(F.array(*heads), F.lit(1), plain))
    all_heads = F.when(F.col("page") % 7 == 0, F.array(box(0, 60.0, 40.0, F.lit("Sum mary")))).otherwise(all_heads)
    words = rows.unionByName(o.where("seq = 1").select("page", F.inline(all_heads)))
    turn = F.radians((F.col("page") % 7 - 3) * 0.5)
    scale = 1.5 + F.col("page") % 4 * 0.25
    shift = F.when(F.col("page") % 7 == 0, 0.0).otherwise(F.col("page") % 30 * 1.0)
    px, py = F.col("x") * scale + shift, F.col("y") * scale - shift / 2
    x0, y0 = px * F.cos(turn) - py * F.sin(turn), py * F.cos(turn) + px * F.sin(turn)
    wide = F.length("text") * 5 * scale
    return words.select("page", "word", x0.alias("x0"), y0.alias("y0"), (x0 + wide).alias("x1"), (y0 + 8 * scale).alias("y1"), "text", (WIDTH * scale).alias("page_width"))


@query(f"""WITH {PLAIN} SELECT page, CAST(word AS BIGINT) AS word, "column", page % 7 = 0 AS summary FROM (SELECT * FROM r UNION ALL SELECT * FROM h UNION ALL SELECT * FROM m) WHERE page % 11 <> 0 OR page % 7 = 0""")
def aligned_pages(spark, sf_dir):
    """Words of turned, scaled and shifted pages in the columns of the plain page; pages of one heading give none, those with a summary mark are scaled by width."""
    anchors = spark.createDataFrame(list(HEADINGS), "text string, x double, y double")
    words = scratch.kept(read_pages(spark, sf_dir), "read-pages")
    placed = alignment.align_pages(words, anchors, WIDTH, ("Summary",))
    # A heading's second piece belongs to the first.
    return layout.to_columns(placed, COLUMNS).where("word <> 4").select("page", "word", "column", "summary")
