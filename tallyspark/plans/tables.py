"""Queries of table files' rows: the accounts' lines printed as tables, a file for each year, with the rows that banks put between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .ledger import LEDGER, ledger
from .queries import ORACLES, TODAY, query, table
from .statements import LINES

CENTS = "CAST(CAST({0} / 100.0 AS DECIMAL(18,2)) AS STRING)"


def _c(x: str) -> str:
    return CENTS.format(f"({x})")


#: Plain SQL but for the row generator: {each} gives 0 to 9 beside every line, and the conditions keep those rows that a line has.
PRINTED = f"""
b AS (SELECT stmt_id AS set_id, year(day) AS file_no, row_id, seq, day, amount, x1, balance, row_number() OVER w AS k, count(*) OVER f AS n, min(year(day)) OVER s AS first_file,
  CAST(COALESCE(sum(CASE WHEN x1 < 250 THEN amount END) OVER f, 0) AS BIGINT) AS wd, CAST(COALESCE(sum(CASE WHEN x1 >= 250 THEN amount END) OVER f, 0) AS BIGINT) AS dp FROM ({LEDGER}) AS ledger
  WINDOW w AS (PARTITION BY stmt_id, year(day) ORDER BY seq), f AS (PARTITION BY stmt_id, year(day)), s AS (PARTITION BY stmt_id)),
e AS (SELECT *, {{each}} AS sub FROM b),
r AS (SELECT set_id, file_no, CAST(row_number() OVER (PARTITION BY set_id, file_no ORDER BY k, sub) - 1 AS BIGINT) AS row, CASE WHEN file_no > first_file THEN CAST(0 AS BIGINT) END AS opening,
  CASE WHEN sub IN (0, 6) THEN 'Date' WHEN sub = 3 THEN CAST(day AS STRING) ELSE '' END AS date,
  CASE WHEN sub IN (0, 6) THEN 'Description' WHEN sub = 1 THEN 'Brought forward' WHEN sub = 2 THEN 'Start' WHEN sub = 3 THEN 'order ' || row_id WHEN sub = 4 THEN 'ref ' || seq
       WHEN sub = 7 THEN 'Carried forward' WHEN sub = 8 THEN 'T' WHEN sub = 9 THEN 'Total' ELSE '' END AS description,
  CASE WHEN sub IN (0, 6) THEN 'Withdrawal' WHEN sub = 3 AND x1 < 250 THEN {_c('amount')} WHEN sub = 8 THEN {_c('wd + CASE WHEN row_id % 8 = 0 THEN 1 ELSE 0 END')} WHEN sub = 9 THEN {_c('wd')} ELSE '' END AS withdrawal,
  CASE WHEN sub IN (0, 6) THEN 'Deposit' WHEN sub = 3 AND x1 >= 250 THEN {_c('amount')} WHEN sub IN (8, 9) THEN {_c('dp')} ELSE '' END AS deposit,
  CASE WHEN sub IN (0, 6) THEN 'Balance' WHEN sub = 2 THEN '1.00' WHEN sub IN (1, 7) THEN {_c('COALESCE(balance, 0)')} WHEN sub = 3 AND balance IS NOT NULL THEN {_c('balance')} ELSE '' END AS balance
  FROM e WHERE sub = 3 OR sub = 0 AND k = 1 OR sub = 1 AND k = 1 AND row_id % 2 = 0 OR sub = 2 AND k = 1 AND row_id % 5 = 0 OR sub = 4 AND row_id % 6 = 0 OR sub = 5 AND row_id % 13 = 0
    OR sub = 6 AND row_id % 17 = 0 OR sub = 7 AND k = n AND row_id % 3 = 0 OR sub = 8 AND k = n AND row_id % 4 = 0 OR sub = 9 AND k = n)
"""

#: The kinds in SQL, for well-formed figures.
KINDS = f"""{PRINTED.replace("{each}", "unnest(range(0, 10))")},
m AS (SELECT *, TRY_CAST(withdrawal AS DECIMAL(18,2)) AS w, TRY_CAST(deposit AS DECIMAL(18,2)) AS p, CAST(TRY_CAST(balance AS DECIMAL(18,2)) * 100 AS BIGINT) AS bal FROM r),
a AS (SELECT *, CASE WHEN row = 0 THEN 'heading' WHEN description = '' THEN 'blank' WHEN date = 'Date' THEN 'repeated' WHEN description = 'Total' THEN 'totals' WHEN date = '' AND w IS NULL AND p IS NULL AND bal IS NULL THEN 'text' ELSE 'line' END AS k0 FROM m),
f AS (SELECT *, k0 = 'line' AND w IS NULL AND p IS NULL AND bal IS NOT NULL AND (description = 'Brought forward' OR date = '' AND opening IS NULL AND count(CASE WHEN k0 = 'line' THEN 1 END) OVER (PARTITION BY set_id, file_no ORDER BY row) = 1) AS begins FROM a),
g AS (SELECT *, CASE WHEN begins AND NOT bool_or(k0 = 'line' AND NOT begins) OVER (PARTITION BY set_id, file_no ORDER BY row) THEN 'brought_forward' ELSE k0 END AS k1 FROM f),
h AS (SELECT *, CASE WHEN k1 = 'line' THEN max(CASE WHEN k1 = 'line' THEN row END) OVER (PARTITION BY set_id, file_no ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS up FROM g),
t AS (SELECT h.*, CASE WHEN h.description = 'Carried forward' AND h.k1 = 'line' AND o.bal = h.bal THEN 'carried_forward' ELSE h.k1 END AS kind FROM h LEFT JOIN h o ON o.set_id = h.set_id AND o.file_no = h.file_no AND o.row = h.up),
x AS (SELECT *, kind = 'line' AND w <> 0 AND p <> 0 AS several FROM t),
v AS (SELECT set_id, file_no, row, description, kind, CASE WHEN kind = 'line' THEN TRY_CAST(date AS DATE) END AS day, CASE WHEN kind = 'line' AND NOT COALESCE(several, false) THEN CAST(COALESCE(nullif(w, 0), nullif(p, 0), w, p) * 100 AS BIGINT) END AS amount,
  CASE WHEN kind = 'line' AND NOT COALESCE(several, false) THEN CASE WHEN w <> 0 THEN '-' WHEN p <> 0 THEN '+' WHEN w = 0 THEN '-' WHEN p = 0 THEN '+' END END AS sign, bal AS balance,
  CASE WHEN several THEN 'more than one amount on this line - check it' END AS note, kind = 'line' AND date = '' AND bal IS NULL AND (w IS NOT NULL OR p IS NOT NULL) AS maybe, w, p FROM x)"""


def printed_rows(spark, sf_dir):
    text = f"WITH {PRINTED.replace('{each}', 'explode(sequence(0, 9))')} SELECT * FROM r".replace("FROM orders", "FROM {orders}")
    d = spark.sql(text, orders=table(spark, sf_dir, "orders"))
    none = F.lit(None).cast("string")
    return d.withColumns({"header": F.lit(0), "cells": F.array("date", "description", "withdrawal", "deposit", "balance"), "amount": none, "amount2": none})


def classified(spark, sf_dir):
    return tables.table_rows(printed_rows(spark, sf_dir), TODAY)


@query(f"WITH {KINDS} SELECT set_id, file_no, row, kind, day, amount, sign, balance, note FROM v")
def table_row_kinds(spark, sf_dir):
    return classified(spark, sf_dir).select("set_id", "file_no", "row", "kind", "day", "amount", "sign", "balance", "note")


@query(f"""WITH {KINDS}, ln AS (SELECT *, count(CASE WHEN kind = 'line' THEN 1 END) OVER (PARTITION BY set_id, file_no ORDER BY row) AS line FROM v)
SELECT set_id, file_no, min(CASE WHEN kind = 'line' THEN row END) AS row, string_agg(description, ' ' ORDER BY row) AS description FROM ln WHERE line > 0 AND kind IN ('line', 'text') GROUP BY set_id, file_no, line""")
def table_lines(spark, sf_dir):
    return tables.table_lines(classified(spark, sf_dir)).select("set_id", "file_no", "row", "description")


@query(f"""WITH {KINDS}, z AS (SELECT *, row = max(row) OVER (PARTITION BY set_id, file_no) AS last FROM v WHERE kind = 'line')
SELECT set_id, file_no, max(row) AS row, CAST(max(CASE WHEN last THEN COALESCE(w, 0) * 100 END) AS BIGINT) AS withdrawn, CAST(max(CASE WHEN last THEN COALESCE(p, 0) * 100 END) AS BIGINT) AS deposited FROM z GROUP BY set_id, file_no
HAVING count(*) > 1 AND bool_or(last AND maybe) AND COALESCE(sum(CASE WHEN NOT last AND sign = '-' THEN amount END), 0) = max(CASE WHEN last THEN COALESCE(w, 0) * 100 END)
  AND COALESCE(sum(CASE WHEN NOT last AND sign = '+' THEN amount END), 0) = max(CASE WHEN last THEN COALESCE(p, 0) * 100 END)""")
def foot_totals(spark, sf_dir):
    return tables.foot_totals(tables.table_lines(classified(spark, sf_dir)))


@query(f"""WITH pg AS (SELECT stmt_id AS set_id, year(day) * 100 + month(day) AS page, CASE WHEN bool_or(row_id % 29 = 0) THEN 'month' WHEN max(day(day)) > 12 THEN 'day' END AS evidence FROM ({LEDGER}) AS ledger GROUP BY stmt_id, year(day) * 100 + month(day))
SELECT set_id, page, evidence, COALESCE(last_value(evidence IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'day', false) AS day_first FROM pg""")
def carried_order(spark, sf_dir):
    """A month's lines stand for a page; a line of every 29th order only makes sense month first."""
    page = F.year("day") * 100 + F.month("day")
    shown = F.when(F.bool_or(F.col("row_id") % 29 == 0), "month").when(F.max(F.day("day")) > 12, "day")
    return tables.carried_order(ledger(spark, sf_dir).groupBy(F.col("stmt_id").alias("set_id"), page.alias("page")).agg(shown.alias("evidence")))


#: The lines of all of an account's files in SQL: without totals at a foot and lines that move nothing.
JOINED = f"""WITH {KINDS}, ft AS ({ORACLES["foot_totals"]}), bf AS (SELECT set_id, arg_min(balance, file_no * 1000000 + row) AS ob FROM v WHERE kind = 'brought_forward' GROUP BY set_id),
q AS (SELECT v.set_id AS stmt_id, row_number() OVER (PARTITION BY v.set_id ORDER BY v.file_no, v.row) AS seq, v.day, v.amount, v.balance, v.sign, ob AS stated_opening
  FROM v LEFT JOIN bf ON bf.set_id = v.set_id LEFT JOIN ft ON ft.set_id = v.set_id AND ft.file_no = v.file_no AND ft.row = v.row WHERE v.kind = 'line' AND ft.row IS NULL),
z AS (SELECT *, COALESCE(last_value(balance IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), stated_opening) AS known FROM q)
SELECT stmt_id, seq, day, amount, balance, sign, stated_opening FROM z WHERE NOT COALESCE(amount = 0 AND balance = known AND day IS NOT NULL, false)"""


@query(ORACLES["lines_statement"].replace(LINES, JOINED))
def table_statement(spark, sf_dir):
    return tables.table_statement(printed_rows(spark, sf_dir), TODAY).select("stmt_id", "seq", "verified", "withdrawal", "deposit", "reading", "sign_note")
