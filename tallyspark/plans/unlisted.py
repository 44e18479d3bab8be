"""Statements of a bank without a profile, derived from ``orders``: their layout, rows and proof."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates, money
from ..operators import chain, extract, unlisted
from .ledger import CHAIN, LEDGER, ledger
from .queries import TODAY, query


#: What an account holds before its first line, so that no balance is below nothing: such a bank prints no signs.
HELD = 10_000_000_000


def printed_words(spark, sf_dir):
    """Each account on pages of eight rows, moved right by its own shift.

    Headings (on two lines for some accounts, without a balance's name for others), two dates above them, a time on all or
    some rows, text, the amount at its side, the balance where there is one, a channel right of it, wrapped lines, an opening (for most)
    and a foot that nothing but its distance tells from wrapped text.
    """
    account = F.col("stmt_id")
    d = ledger(spark, sf_dir).withColumn("page", F.floor((F.col("seq") - 1) / 8)).withColumn("at", 120 + (F.col("seq") - 1) % 8 * 20.0)
    lit, shift = F.lit, account % 7 * 10.0

    def word(x0, x1, y, said):
        return F.struct((lit(x0) + shift).cast("double").alias("x0"), (lit(x1) + shift).cast("double").alias("x1"), (y if not isinstance(y, (int, float)) else lit(float(y))).cast("double").alias("y"), (said if not isinstance(said, str) else lit(said)).alias("text"))

    def some(condition, w):
        return F.when(condition, w)

    side = F.when(F.col("x1").isNotNull(), F.col("x1") + shift)
    amount = F.struct((side - 30).alias("x0"), side.alias("x1"), (F.col("at") + F.col("row_id") % 3 * 0.7).alias("y"), money.fmt_comma(F.col("amount")).alias("text"))
    row = F.array(
        word(10, 50, F.col("at"), dates.printed(F.col("day"))), some((account % 3 == 0) | ((account % 3 == 1) & (F.col("row_id") % 5 < 2)), word(55, 75, F.col("at"), "10:15")),
        word(80, 105, F.col("at"), "order"), word(110, 150, F.col("at"), F.col("row_id").cast("string")), some(F.col("x1").isNotNull(), amount),
        some(F.col("balance").isNotNull(), word(380, 420, F.col("at"), money.fmt_comma(F.col("balance") + HELD))), some(F.col("row_id") % 6 == 1, word(440, 460, F.col("at"), "ATM")),
        some(F.col("row_id") % 4 == 0, word(80, 130, F.col("at") + 8, "wrapped")),
    )
    rows = d.select("stmt_id", "page", F.explode(F.filter(row, lambda w: w.isNotNull())).alias("w"))
    low = F.when(account % 2 == 0, 88.0).otherwise(80.0)
    around = F.array(
        word(10, 45, 60, "01/01/1992"), word(60, 95, 60, "31/12/1998"), word(10, 30, 80, "Date"), word(80, 140, 80, "Description"), word(230, 260, 80, "Amount"), word(380, 420, low, F.when(account % 10 == 1, "Left").otherwise("Balance")),
        some((F.col("page") == 0) & (account % 10 != 0), word(80, 100, 104, "B/F")), some((F.col("page") == 0) & (account % 10 != 0), word(380, 420, 104, money.fmt_comma(F.lit(HELD)))), word(80, 140, 340, "Thank"), word(145, 160, 340, "you"),
    )
    edges = d.select("stmt_id", "page").distinct().select("stmt_id", "page", F.explode(F.filter(around, lambda w: w.isNotNull())).alias("w"))
    words = rows.unionByName(edges).select(account.alias("doc"), "page", "w.*").withColumn("y0", F.col("y") - 4).withColumn("y1", F.col("y") + 4)
    return words.withColumn("word", F.row_number().over(W.partitionBy("doc", "page").orderBy("y", "x0", "text")))


#: Which accounts have a layout, and what keeps others from one, counted in the ledger.
FACTS = f"""l AS ({LEDGER}), n AS (
  SELECT stmt_id AS doc, count(*) AS n, count(balance) AS b, count(*) FILTER (x1 = 200) AS p, count(*) FILTER (x1 = 300) AS q, count(*) FILTER (row_id % 5 < 2) AS h FROM l GROUP BY stmt_id),
f AS (SELECT *, CASE WHEN doc % 10 = 1 THEN 'no headings' WHEN greatest(b, p, q) < 0.9 * n THEN 'no balance' WHEN b < 0.9 * n OR p + q = 0 THEN 'no amounts' WHEN doc % 10 = 0 THEN 'no opening' END AS refusal FROM n)"""


@query(f"""WITH {FACTS} SELECT doc, refusal, CASE WHEN refusal IS NULL THEN CAST(9 + doc % 7 * 10 AS DOUBLE) END AS date_lo, CASE WHEN refusal IS NULL AND (doc % 3 = 0 OR doc % 3 = 1 AND h >= 0.5 * n) THEN CAST(76 + doc % 7 * 10 AS DOUBLE) END AS time_hi,
  CASE WHEN refusal IS NULL THEN CAST(CASE WHEN p > 0 THEN 169.5 ELSE 269.5 END + doc % 7 * 10 AS DOUBLE) END AS amount_lo,
  CASE WHEN refusal IS NULL THEN (CASE WHEN q > 0 THEN 300 ELSE 200 END + 380) / 2 + doc % 7 * 10 END AS split, CASE WHEN refusal IS NULL THEN CAST(422 + doc % 7 * 10 AS DOUBLE) END AS balance_hi,
  CASE WHEN doc % 10 <> 1 THEN '01/01/1992 31/12/1998' END AS period_text FROM f""")
def unlisted_layouts(spark, sf_dir):
    """Column ranges, or why there are none, of every account."""
    d = unlisted.layouts(extract.lines_of(printed_words(spark, sf_dir), unlisted.LINE_REACH))
    edge = lambda name, side: F.get(F.filter("columns", lambda c: c["name"] == name), F.lit(0))[side].cast("double")
    return d.select(
        "doc", "refusal", edge("date", "lo").alias("date_lo"), edge("time", "hi").alias("time_hi"), edge("amount", "lo").alias("amount_lo"), edge("balance", "lo").alias("split"), edge("balance", "hi").alias("balance_hi"), "period_text"
    )


@query(f"""WITH {FACTS} SELECT stmt_id AS doc, row_number() OVER (PARTITION BY stmt_id ORDER BY seq) AS seq, CAST(day AS DATE) AS day,
  CASE WHEN doc % 3 = 1 AND h < 0.5 * n AND row_id % 5 < 2 THEN '10:15 ' ELSE '' END || 'order ' || row_id || CASE WHEN row_id % 4 = 0 THEN ' wrapped' ELSE '' END || CASE WHEN n = 1 THEN ' Thank you' ELSE '' END AS description,
  CASE WHEN x1 IS NOT NULL THEN amount END AS amount, balance + {HELD} AS balance, CASE WHEN row_id % 6 = 1 THEN 'ATM' END AS channel
FROM l JOIN f ON l.stmt_id = f.doc WHERE refusal IS NULL AND (x1 IS NOT NULL OR balance IS NOT NULL)""")
def unlisted_rows(spark, sf_dir):
    """The rows of all accounts whose layout is found, without any column range given.

    Where an account has one line only, no spacing tells its foot from wrapped text.
    """
    return unlisted.transactions(printed_words(spark, sf_dir), TODAY).select("doc", "seq", "day", "description", "amount", "balance", "channel")


@query(f"""WITH {CHAIN.replace('l AS (' + LEDGER + ')', 'l AS (SELECT stmt_id, seq, row_id, day, opening, amount, CAST(NULL AS BIGINT) AS tax, CAST(NULL AS DOUBLE) AS x1, balance FROM (' + LEDGER + ') WHERE x1 IS NOT NULL)')},
{FACTS.replace('l AS (', 'l2 AS (', 1).replace('FROM l GROUP', 'FROM l2 GROUP')}
SELECT stmt_id AS doc, count(*) AS rows, count(*) FILTER (verified) AS verified, CAST(COALESCE(sum(withdrawal), 0) AS BIGINT) AS withdrawn, CAST(COALESCE(sum(deposit), 0) AS BIGINT) AS deposited,
  CASE WHEN count(*) = count(*) FILTER (verified) THEN 'yellow' ELSE 'red' END AS status
FROM c JOIN f ON c.stmt_id = f.doc WHERE refusal IS NULL GROUP BY stmt_id""")
def unlisted_to_proof(spark, sf_dir):
    """From words to a light in one plan: no profile, directions by the balance alone, and never better than yellow."""
    rows = unlisted.transactions(printed_words(spark, sf_dir), TODAY).withColumnRenamed("doc", "stmt_id").withColumn("tax", F.lit(None).cast("bigint"))
    d = chain.verify_chain(rows)
    return d.groupBy(F.col("stmt_id").alias("doc")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.coalesce(F.sum("withdrawal"), F.lit(0)).alias("withdrawn"), F.coalesce(F.sum("deposit"), F.lit(0)).alias("deposited"),
        F.when(F.bool_and("verified"), "yellow").otherwise("red").alias("status"),
    )
