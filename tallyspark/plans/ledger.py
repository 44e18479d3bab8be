"""Ledgers derived from the given tables, as plain SQL that Spark and DuckDB both run.

``orders`` becomes account statements: a customer's orders in order of date, paid out (status F) or in,
with a running balance.  Some lines are damaged by rule - no printed balance, a wrong digit, an amount
of 0, tax withheld, an amount in the wrong column - so that every branch of the proof is reached.  The account is named
before the first window, so that all windows over an account share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column split between withdrawals (left) and deposits (right).
SPLIT = 250.0

LEDGER = """
SELECT stmt_id, seq, row_id, day, CAST(0 AS BIGINT) AS opening, amount, tax, x1, true_balance,
       CASE WHEN row_id % 7 <> 0 THEN true_balance + CASE WHEN row_id % 97 = 0 THEN 1 ELSE 0 END END AS balance
FROM (
  SELECT *, CAST(SUM(CASE WHEN paid_out THEN -amount ELSE amount END - COALESCE(tax, 0)) OVER (PARTITION BY stmt_id ORDER BY seq) AS BIGINT) AS true_balance
  FROM (
    SELECT stmt_id, o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS paid_out,
           CAST(ROW_NUMBER() OVER (PARTITION BY stmt_id ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq,
           CASE WHEN o_orderkey % 53 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS amount,
           CASE WHEN o_orderkey % 11 = 0 AND o_orderstatus <> 'F' AND o_orderkey % 53 <> 0 THEN CAST(125 AS BIGINT) END AS tax,
           CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN (o_orderstatus = 'F') <> (o_orderkey % 31 = 0) THEN CAST(200 AS DOUBLE) ELSE CAST(300 AS DOUBLE) END AS x1
    FROM (SELECT o_custkey AS stmt_id, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM orders) AS o
  ) AS a
) AS b
"""

#: The chain's outcome in SQL: what oracles build on.
CHAIN = f"""
l AS ({LEDGER}),
g AS (SELECT *, COUNT(balance) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp,
             CASE WHEN x1 < 250 THEN -amount WHEN x1 >= 250 THEN amount END AS signed FROM l),
s AS (SELECT stmt_id, grp, COUNT(*) AS grp_size, MAX(balance) AS closing, CAST(SUM(signed) AS BIGINT) AS net, COUNT(signed) AS sides FROM g GROUP BY stmt_id, grp),
t AS (SELECT *, COALESCE(LAG(closing) OVER (PARTITION BY stmt_id ORDER BY grp), 0) AS running FROM s),
p AS (
  SELECT g.stmt_id, g.seq, g.row_id, g.day, g.amount, g.tax, g.x1, g.balance, g.grp, t.grp_size, t.closing, t.running, g.signed,
         t.grp_size = 1 AND t.closing IS NOT NULL AND t.closing - t.running + COALESCE(g.tax, 0) <> 0 AND abs(t.closing - t.running + COALESCE(g.tax, 0)) = g.amount AS single_ok,
         t.grp_size > 1 AND t.closing IS NOT NULL AND t.sides = t.grp_size AND t.net = t.closing - t.running AS group_ok,
         t.closing - t.running + COALESCE(g.tax, 0) AS moved
  FROM g JOIN t ON g.stmt_id = t.stmt_id AND g.grp = t.grp),
c AS (
  SELECT *, COALESCE(single_ok, false) OR COALESCE(group_ok, false) AS verified,
         CASE WHEN single_ok AND moved < 0 OR group_ok AND signed < 0 OR group_ok AND x1 < 250 THEN amount END AS withdrawal,
         CASE WHEN single_ok AND moved > 0 OR group_ok AND x1 >= 250 THEN amount END AS deposit FROM p)
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEDGER.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
