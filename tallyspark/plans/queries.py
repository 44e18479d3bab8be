"""The registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates, money, text
from ..operators import batch, chain, checks, daily, infer, layout, trust
from .ledger import CHAIN, LEDGER, SPLIT, ledger

Query = Callable[[SparkSession, str], DataFrame]
#: The day by which dates of these queries are judged unlikely.
TODAY = "2026-10-02"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.verify_chain(ledger(spark, sf_dir), SPLIT)


# The chain


@query(f"WITH {CHAIN} SELECT stmt_id, seq, verified, withdrawal, deposit FROM c")
def chain_verify(spark, sf_dir):
    return proved(spark, sf_dir).select("stmt_id", "seq", "verified", "withdrawal", "deposit")


MONEY_SQL = "(CASE WHEN {0} < 0 THEN '-' ELSE '' END || CAST(abs({0}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0'))"


def _m(x: str) -> str:
    return MONEY_SQL.format(f"({x})")


@query(f"""WITH {CHAIN}, fg AS (SELECT *, min(CASE WHEN signed IS NULL THEN seq END) OVER (PARTITION BY stmt_id, grp) AS gap FROM c),
nt AS (SELECT *, CAST(COALESCE(sum(CASE WHEN gap IS NULL OR seq < gap THEN signed END) OVER (PARTITION BY stmt_id, grp), 0) AS BIGINT) AS told, count(CASE WHEN gap IS NULL OR seq < gap THEN signed END) OVER (PARTITION BY stmt_id, grp) AS terms FROM fg)
SELECT stmt_id, seq,
  CASE WHEN closing IS NULL THEN '{chain.NO_BALANCE}' WHEN verified THEN NULL
       WHEN grp_size = 1 AND closing = running THEN 'the balance did not change, so whether ' || {_m('amount')} || ' went in or out cannot be determined - check this row by hand'
       WHEN grp_size = 1 THEN 'balance chain broken: ' || {_m('running')} || ' -> ' || {_m('closing')} || ' is a change of ' || {_m('closing - running')} || ', but the amount printed is ' || {_m('amount')} || CASE WHEN tax <> 0 THEN ' (tax ' || {_m('tax')} || ')' ELSE '' END
       ELSE 'these ' || grp_size || ' rows share one printed balance, and they do not add up to it: ' || {_m('running')} || ' -> ' || {_m('closing')} || ' is a change of ' || {_m('closing - running')} || ', the rows net ' || CASE WHEN terms = 0 THEN '0' ELSE {_m('told')} END END AS note,
  CASE WHEN single_ok AND amount <> 0 AND x1 IS NOT NULL AND (moved < 0) <> (x1 < 250) THEN CASE WHEN moved < 0 THEN '{chain.SIDE.format("withdrawal", "deposit")}' ELSE '{chain.SIDE.format("deposit", "withdrawal")}' END END AS side_note
FROM nt""")
def chain_notes(spark, sf_dir):
    return proved(spark, sf_dir).select("stmt_id", "seq", "note", "side_note")


@query(f"""WITH {CHAIN} SELECT stmt_id, grp, grp_size, running, closing, bool_and(verified) AS verified,
  CAST(SUM(withdrawal) AS BIGINT) AS withdrawn, CAST(SUM(deposit) AS BIGINT) AS deposited FROM c WHERE grp_size > 1 GROUP BY ALL""")
def chain_groups(spark, sf_dir):
    d = proved(spark, sf_dir).where("grp_size > 1")
    return d.groupBy("stmt_id", "grp", "grp_size", "running", "closing").agg(F.bool_and("verified").alias("verified"), F.sum("withdrawal").alias("withdrawn"), F.sum("deposit").alias("deposited"))


@query(f"""WITH l AS ({LEDGER}), k AS (SELECT *, COALESCE(last_value(balance IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM l)
SELECT stmt_id, seq, row_id FROM k WHERE amount = 0 AND COALESCE(tax, 0) = 0 AND balance = known""")
def zero_lines(spark, sf_dir):
    return chain.drop_zero_lines(ledger(spark, sf_dir)).where("moves_nothing").select("stmt_id", "seq", "row_id")


@query(f"""WITH {CHAIN}, x AS (SELECT *, verified AND COALESCE(tax, 0) <> 0 AS taxed FROM c)
SELECT stmt_id, seq, 0 AS part, amount, balance + CASE WHEN taxed THEN tax ELSE 0 END AS balance, withdrawal, deposit, false AS is_tax FROM x
UNION ALL SELECT stmt_id, seq, 1, tax, balance, tax, NULL, true FROM x WHERE taxed""")
def tax_split(spark, sf_dir):
    return chain.split_tax(proved(spark, sf_dir)).drop("verified")


@query(f"""WITH l AS ({LEDGER}) SELECT stmt_id, arg_min(balance + CASE WHEN x1 < 250 THEN amount ELSE -amount END, seq) AS opening FROM l WHERE balance IS NOT NULL GROUP BY stmt_id""")
def derived_opening(spark, sf_dir):
    return chain.derive_opening(ledger(spark, sf_dir).withColumn("is_withdrawal", F.coalesce(F.col("x1") < SPLIT, F.lit(False))))


# Trust


def trusted(spark, sf_dir):
    d = proved(spark, sf_dir).withColumn("has_notes", F.col("note").isNotNull() | F.col("side_note").isNotNull())
    last = F.max("seq").over(W.partitionBy("stmt_id"))
    met = F.max(F.when(F.col("seq") == last, F.col("balance") == F.col("true_balance"))).over(W.partitionBy("stmt_id"))
    d = d.join(ledger(spark, sf_dir).select("stmt_id", "seq", "true_balance"), ["stmt_id", "seq"]) if "true_balance" not in d.columns else d
    return d.withColumn("closing_met", F.coalesce(met, F.lit(False))).withColumn("opening_confirmed", F.col("stmt_id") % 3 != 0).withColumn("page_held", F.floor((F.col("seq") - 1) / 10) == F.col("stmt_id") % 9).withColumn("per_line", F.col("stmt_id") % 2 == 0).withColumn("is_tax", F.lit(False))


TRUST = f"""{CHAIN}, e AS (
  SELECT c.*, l.true_balance, verified AND NOT (grp_size = 1 AND single_ok AND c.x1 IS NOT NULL AND c.amount <> 0 AND (moved < 0) <> (c.x1 < 250)) AS good,
         c.stmt_id % 3 <> 0 AS opening_confirmed, (c.seq - 1) // 10 = c.stmt_id % 9 AS page_held, c.stmt_id % 2 = 0 AS per_line,
         COALESCE(first_value(c.balance = l.true_balance) OVER (PARTITION BY c.stmt_id ORDER BY c.seq DESC), false) AS closing_met,
         LAG(verified) OVER w AS was, LEAD(verified) OVER w AS follows FROM c JOIN l ON c.stmt_id = l.stmt_id AND c.seq = l.seq WINDOW w AS (PARTITION BY c.stmt_id ORDER BY c.seq)),
f AS (SELECT *, LEAD(good) OVER (PARTITION BY stmt_id ORDER BY seq) AS good_follows FROM e),
h AS (SELECT *, good AND NOT page_held AND COALESCE(was, opening_confirmed) AND CASE WHEN follows IS NULL THEN closing_met WHEN per_line THEN follows ELSE good_follows END AS confirmed FROM f)"""


@query(f"WITH {TRUST} SELECT stmt_id, seq, confirmed FROM h")
def confirmed_rows(spark, sf_dir):
    return trust.confirmed_rows(trusted(spark, sf_dir)).select("stmt_id", "seq", "confirmed")


@query(f"WITH {TRUST} SELECT stmt_id, COUNT(*) AS to_check, MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM h WHERE NOT confirmed GROUP BY stmt_id")
def rows_to_check(spark, sf_dir):
    return trust.confirmed_rows(trusted(spark, sf_dir)).where(~F.col("confirmed")).groupBy("stmt_id").agg(F.count(F.lit(1)).alias("to_check"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"""WITH {TRUST}, i AS (SELECT *, CASE WHEN verified AND COALESCE(LAG(balance) OVER w, 1) <> 0 THEN 1 ELSE 0 END AS link FROM h WINDOW w AS (PARTITION BY stmt_id ORDER BY seq))
SELECT a.stmt_id, a.seq, (a.opening_confirmed AND (SELECT bool_and(CASE WHEN b.seq = 1 THEN b.verified ELSE b.link = 1 END) FROM i b WHERE b.stmt_id = a.stmt_id AND b.seq <= a.seq))
  OR (a.closing_met AND COALESCE((SELECT bool_and(b.link = 1) FROM i b WHERE b.stmt_id = a.stmt_id AND b.seq > a.seq), true)) AS linked FROM i a""")
def linked_runs(spark, sf_dir):
    return trust.linked_rows(trusted(spark, sf_dir)).select("stmt_id", "seq", "linked")


EVENTS = "SELECT user_id AS stmt_id, event_id AS seq, event_type, CAST(ts AS DATE) - CASE WHEN event_id % 37 = 0 THEN 5 ELSE 0 END AS day, CAST(round(value * 100) AS BIGINT) AS cents FROM events"


def event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    back = F.when(F.col("event_id") % 37 == 0, 5).otherwise(0)
    return e.select(F.col("user_id").alias("stmt_id"), F.col("event_id").alias("seq"), "event_type", F.date_sub(F.to_date("ts"), back).alias("day"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query(f"WITH v AS ({EVENTS}), a AS (SELECT *, LAG(day) OVER (PARTITION BY stmt_id ORDER BY seq) AS above FROM v) SELECT stmt_id, seq, day, above FROM a WHERE day < above")
def dates_monotone(spark, sf_dir):
    return trust.dates_backwards(event_lines(spark, sf_dir))


@query(f"""WITH v AS ({EVENTS}), a AS (SELECT *, MAX(day) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_above,
  MIN(day) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS earliest_below FROM v)
SELECT stmt_id, seq, latest_above, COALESCE(day < latest_above, false) AS too_early, NOT COALESCE(day < latest_above, false) AND COALESCE(earliest_below < day, false) AS too_late FROM a""")
def dates_stack(spark, sf_dir):
    return trust.doubtful_dates(event_lines(spark, sf_dir)).select("stmt_id", "seq", "latest_above", "too_early", "too_late")


LINES = "SELECT l_suppkey AS stmt_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS seq, l_linenumber AS page, date_trunc('month', CAST(l_shipdate AS DATE)) AS day, CAST(l_quantity AS BIGINT) AS amount, CAST(round(l_tax * 100) AS BIGINT) AS balance FROM lineitem"


def page_lines(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stmt_id"), n.cast("bigint").alias("seq"), F.col("l_linenumber").alias("page"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"),
        F.col("l_quantity").cast("bigint").alias("amount"), F.round(F.col("l_tax") * 100).cast("bigint").alias("balance"),
    )


@query(f"WITH v AS ({LINES}), a AS (SELECT *, MIN(seq) OVER (PARTITION BY stmt_id, day, amount, balance) AS first_seq FROM v) SELECT stmt_id, seq, first_seq FROM a WHERE first_seq < seq")
def duplicate_lines(spark, sf_dir):
    return trust.repeated_lines(page_lines(spark, sf_dir)).select("stmt_id", "seq", "first_seq")


@query(f"WITH v AS ({LINES}), a AS (SELECT *, MIN(page) OVER (PARTITION BY stmt_id, amount, balance) < page AS again FROM v) SELECT stmt_id, page, bool_or(again) AS held FROM a GROUP BY stmt_id, page")
def overlap_pages(spark, sf_dir):
    return trust.overlapping_pages(page_lines(spark, sf_dir))


@query(f"""WITH {CHAIN}, q AS (SELECT stmt_id, seq, (seq - 1) // 5 AS page, verified, LAG((seq - 1) // 5) OVER (PARTITION BY stmt_id ORDER BY seq) AS above FROM c)
SELECT stmt_id, page, above FROM q WHERE above <> page AND NOT verified""")
def page_links(spark, sf_dir):
    return trust.page_joins(proved(spark, sf_dir).withColumn("page", F.floor((F.col("seq") - 1) / 5)))


@query(f"""WITH l AS ({LEDGER}), r AS (SELECT stmt_id, day, amount, balance, CASE WHEN stmt_id % 3 = 0 THEN -seq ELSE seq END AS seq FROM l),
a AS (SELECT *, LAG(day) OVER w AS d0, LAG(balance) OVER w AS b0, LEAD(balance) OVER w AS b1 FROM r WINDOW w AS (PARTITION BY stmt_id ORDER BY seq)),
n AS (SELECT stmt_id, count(*) FILTER (day < d0) AS falls, count(*) FILTER (day > d0) AS rises, count(*) FILTER (abs(balance - b1) = amount) AS links_below, count(*) FILTER (abs(balance - b0) = amount) AS links_above FROM a GROUP BY stmt_id)
SELECT *, falls > rises AND links_below > links_above AS newest_first FROM n""")
def newest_first_vote(spark, sf_dir):
    turned = F.when(F.col("stmt_id") % 3 == 0, -F.col("seq")).otherwise(F.col("seq"))
    return trust.newest_first(ledger(spark, sf_dir).select("stmt_id", "day", "amount", "balance", turned.alias("seq")))


# Checks and status


FACTS = """SELECT o_custkey AS stmt_id,
  CASE WHEN o_custkey % 4 <> 0 THEN CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 53 <> 0 THEN round(o_totalprice * 100) ELSE 0 END) AS BIGINT) END AS withdraw_total,
  CASE WHEN o_custkey % 4 <> 0 THEN CAST(sum(CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 53 <> 0 THEN round(o_totalprice * 100) ELSE 0 END) AS BIGINT) END AS deposit_total,
  CASE WHEN o_custkey % 5 = 0 THEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) END AS withdraw_count,
  CASE WHEN o_custkey % 5 = 0 THEN count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) END AS deposit_count,
  CASE WHEN o_custkey % 7 = 0 THEN CAST(0 AS BIGINT) END AS closing_stated, o_custkey % 8 = 0 AS opening_derived, CAST(0 AS BIGINT) AS opening, CAST(CASE WHEN o_custkey % 2 = 0 THEN count(CASE WHEN o_orderkey % 53 = 0 THEN 1 END) END AS INT) AS zero_lines, o_custkey % 6 = 0 AS from_photo, o_custkey % 10 = 0 AS untested FROM orders GROUP BY o_custkey"""


def facts(spark, sf_dir):
    return spark.sql(FACTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def statement_totals(spark, sf_dir):
    d = proved(spark, sf_dir).withColumn("has_notes", F.col("side_note").isNotNull()).withColumn("is_tax", F.lit(False))
    for name, day in (("period_from", "1995-06-01"), ("period_to", "2001-03-31")):
        d = d.withColumn(name, F.when(F.col("stmt_id") % 9 == 0, F.lit(day).cast("date")))
    return checks.totals(d)


TOTALS = f"""{CHAIN}, o AS (SELECT *, LAG(day) OVER (PARTITION BY stmt_id ORDER BY seq) AS above FROM c),
tot AS (SELECT stmt_id, count(*) AS rows, count(*) FILTER (verified) AS verified_rows, count(*) FILTER (day < above) AS backwards,
  CAST(COALESCE(sum(withdrawal), 0) AS BIGINT) AS withdrawn, count(withdrawal) AS withdrawals, CAST(COALESCE(sum(deposit), 0) AS BIGINT) AS deposited, count(deposit) AS deposits,
  arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closing,
  count(*) FILTER (single_ok AND amount <> 0 AND x1 IS NOT NULL AND (moved < 0) <> (x1 < 250)) AS anomalies, MIN(day) AS first_day, MAX(day) AS last_day,
  string_agg(strftime(day, '%Y-%m-%d') || ' comes after ' || strftime(above, '%Y-%m-%d'), '; ' ORDER BY seq) FILTER (day < above) AS backwards_said,
  string_agg(strftime(day, '%Y-%m-%d') || ' ' || {_m('COALESCE(nullif(withdrawal, 0), nullif(deposit, 0), amount)')}, '; ' ORDER BY seq) FILTER (stmt_id % 9 = 0 AND NOT (day BETWEEN DATE '1995-06-01' AND DATE '2001-03-31')) AS outside_said,
  CASE WHEN stmt_id % 9 = 0 THEN DATE '1995-06-01' END AS period_from, CASE WHEN stmt_id % 9 = 0 THEN DATE '2001-03-31' END AS period_to FROM o GROUP BY stmt_id), facts AS ({FACTS})"""


@query(f"WITH {TOTALS} SELECT * FROM tot")
def control_totals(spark, sf_dir):
    return statement_totals(spark, sf_dir).drop("tax", "tax_rows")


CHECK_ROWS = f"""{TOTALS}, j AS (SELECT tot.*, f.* EXCLUDE (stmt_id), COALESCE(zero_lines, 0) AS z, CASE WHEN first_day - period_from >= 28 THEN 'no lines ' || period_from || ' to ' || (first_day - 1) END AS head, CASE WHEN period_to - last_day >= 28 THEN 'no lines ' || (last_day + 1) || ' to ' || period_to END AS tail FROM tot LEFT JOIN facts f USING (stmt_id)), ch AS (
  SELECT stmt_id, 1 AS ord, 'Every row agrees with the running balance' AS label, rows = verified_rows AS passed, verified_rows || ' of ' || rows || ' rows verified' || CASE WHEN rows > verified_rows THEN '; ' || (rows - verified_rows) || ' could not be' ELSE '' END AS detail FROM j
  UNION ALL SELECT stmt_id, 2, 'Dates never go backwards', backwards = 0, COALESCE(backwards_said, 'in order') FROM j
  UNION ALL SELECT stmt_id, 3, 'Final balance matches the closing balance the bank printed', COALESCE(closing = closing_stated, false), 'computed ' || COALESCE({_m('closing')}, 'none') || ' vs printed ' || {_m('closing_stated')} FROM j WHERE closing_stated IS NOT NULL
  UNION ALL SELECT stmt_id, 4, 'Total withdrawals matches the bank''s own total', withdrawn = withdraw_total, 'computed ' || CASE WHEN withdrawals = 0 THEN '0' ELSE {_m('withdrawn')} END || ' vs printed ' || {_m('withdraw_total')} FROM j WHERE withdraw_total IS NOT NULL
  UNION ALL SELECT stmt_id, 6, 'Total deposits matches the bank''s own total', deposited = deposit_total, 'computed ' || CASE WHEN deposits = 0 THEN '0' ELSE {_m('deposited')} END || ' vs printed ' || {_m('deposit_total')} FROM j WHERE deposit_total IS NOT NULL
  UNION ALL SELECT stmt_id, 5, 'Number of withdrawals matches the bank''s own count', withdrawals IN (withdraw_count, withdraw_count - z), 'found ' || withdrawals || CASE WHEN z > 0 AND withdrawals + z = withdraw_count THEN ' + ' || z || ' line(s) of 0.00' ELSE '' END || ' vs printed ' || withdraw_count FROM j WHERE withdraw_count IS NOT NULL
  UNION ALL SELECT stmt_id, 7, 'Number of deposits matches the bank''s own count', deposits IN (deposit_count, deposit_count - z), 'found ' || deposits || CASE WHEN z > 0 AND deposits + z = deposit_count THEN ' + ' || z || ' line(s) of 0.00' ELSE '' END || ' vs printed ' || deposit_count FROM j WHERE deposit_count IS NOT NULL
  UNION ALL SELECT stmt_id, 9, 'Opening balance (not printed by the bank) worked back from row 1', true, '0.00; ' || CASE WHEN withdraw_total IS NULL AND deposit_total IS NULL THEN 'the bank printed no totals to confirm it - the balance chain proves every line after the first' ELSE 'confirmed only through the totals checks above' END FROM j WHERE opening_derived
  UNION ALL SELECT stmt_id, 10, 'Rows dated outside the statement period (allowed, listed)', true, outside_said FROM j WHERE outside_said IS NOT NULL
  UNION ALL SELECT stmt_id, 11, 'A month or more of the statement period has no lines (allowed, listed)', true, concat_ws('; ', head, tail) || ' - if the account was used then, this file may be cut short' FROM j WHERE head IS NOT NULL OR tail IS NOT NULL
  UNION ALL SELECT stmt_id, 12, 'Lines of 0.00 left out - nothing to post (allowed, listed)', true, z || ' line(s)' FROM j WHERE z > 0
  UNION ALL SELECT stmt_id, 13, 'No other anomalies on any row', anomalies = 0, CASE WHEN anomalies > 0 THEN anomalies || ' row(s) carry a warning' ELSE 'clean' END FROM j)"""


@query(f"WITH {CHECK_ROWS} SELECT * FROM ch")
def statement_checks(spark, sf_dir):
    return checks.checks(statement_totals(spark, sf_dir), facts(spark, sf_dir))


STATUS = f"""{CHECK_ROWS}, st AS (SELECT ch.stmt_id, bool_and(passed) AS ok,
  CASE WHEN NOT bool_and(passed) THEN 'red' WHEN any_value(from_photo) OR any_value(untested) THEN 'yellow' WHEN COALESCE(any_value(closing_stated), any_value(withdraw_total), any_value(deposit_total), any_value(withdraw_count), any_value(deposit_count)) IS NOT NULL THEN 'green' ELSE 'yellow' END AS status
  FROM ch LEFT JOIN facts USING (stmt_id) GROUP BY ch.stmt_id)"""


@query(f"WITH {STATUS} SELECT * FROM st")
def status_light(spark, sf_dir):
    return checks.status(checks.checks(statement_totals(spark, sf_dir), facts(spark, sf_dir)), facts(spark, sf_dir))


@query(f"""WITH {STATUS} SELECT r_name, n_name, CASE max(CASE status WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 4 END) WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' ELSE 'red' END AS worst,
  count(*) AS statements, count(*) FILTER (status = 'green') AS green, count(*) FILTER (status = 'red') AS red
FROM st JOIN customer ON stmt_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def worst_status_summary(spark, sf_dir):
    st = status_light(spark, sf_dir)
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = st.join(c, st["stmt_id"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return checks.worst(d, "r_name", "n_name")


PERIOD = "DATE '1995-06-01' AS period_from, DATE '2001-03-31' AS period_to"


@query(f"WITH l AS ({LEDGER}) SELECT stmt_id, seq, day FROM l WHERE NOT (day BETWEEN DATE '1995-06-01' AND DATE '2001-03-31')")
def outside_period(spark, sf_dir):
    return checks.outside_period(ledger(spark, sf_dir).selectExpr("*", PERIOD.split(", ")[0], PERIOD.split(", ")[1])).select("stmt_id", "seq", "day")


@query(f"""WITH l AS ({LEDGER}), e AS (SELECT stmt_id, MIN(day) AS first_day, MAX(day) AS last_day FROM l GROUP BY stmt_id)
SELECT *, date_diff('day', DATE '1995-06-01', first_day) >= 28 AS empty_head, date_diff('day', last_day, DATE '2001-03-31') >= 28 AS empty_tail FROM e
WHERE date_diff('day', DATE '1995-06-01', first_day) >= 28 OR date_diff('day', last_day, DATE '2001-03-31') >= 28""")
def empty_period(spark, sf_dir):
    d = ledger(spark, sf_dir).selectExpr("*", PERIOD.split(", ")[0], PERIOD.split(", ")[1])
    return checks.empty_ends(d).select("stmt_id", "first_day", "last_day", "empty_head", "empty_tail")


# Days


def event_rows(spark, sf_dir):
    e = event_lines(spark, sf_dir)
    out = F.col("event_type").isin("purchase", "error")
    balance = F.when(F.col("seq") % 4 != 0, F.col("seq") * 100)
    return e.withColumn("withdrawal", F.when(out, F.col("cents"))).withColumn("deposit", F.when(~out, F.col("cents"))).withColumn("balance", balance).withColumn("verified", F.col("seq") % 9 != 0)


DAILY = f"""v AS ({EVENTS}), dly AS (SELECT stmt_id, day, count(*) AS n, count(*) FILTER (seq % 9 = 0) AS flagged,
  CAST(COALESCE(sum(cents) FILTER (event_type IN ('purchase', 'error')), 0) AS BIGINT) AS withdrawn, CAST(COALESCE(sum(cents) FILTER (event_type NOT IN ('purchase', 'error')), 0) AS BIGINT) AS deposited,
  max(CASE WHEN seq % 4 <> 0 THEN seq * 100 END) AS balance FROM v GROUP BY stmt_id, day)"""


@query(f"WITH {DAILY} SELECT * FROM dly")
def daily_rollup(spark, sf_dir):
    return daily.daily(event_rows(spark, sf_dir))


@query(f"""WITH {DAILY}, cal AS (SELECT stmt_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT stmt_id FROM v))
SELECT cal.stmt_id, cal.day, COALESCE(n, 0) AS n, COALESCE(flagged, 0) AS flagged, COALESCE(withdrawn, 0) AS withdrawn, COALESCE(deposited, 0) AS deposited,
  COALESCE(last_value(balance IGNORE NULLS) OVER (PARTITION BY cal.stmt_id ORDER BY cal.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS balance, false AS outside
FROM cal LEFT JOIN dly ON cal.stmt_id = dly.stmt_id AND cal.day = dly.day
UNION ALL SELECT stmt_id, day, n, flagged, withdrawn, deposited, balance, true FROM dly WHERE NOT (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31')""")
def daily_densify(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    accounts = rows.select("stmt_id").distinct().selectExpr("stmt_id", "cast(0 as bigint) as opening", "date '2024-01-01' as period_from", "date '2024-01-31' as period_to")
    return daily.densify(daily.daily(rows), accounts)


@query(f"WITH {DAILY} SELECT stmt_id, day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(withdrawn) AS BIGINT) AS withdrawn, CAST(sum(deposited) AS BIGINT) AS deposited FROM dly GROUP BY GROUPING SETS ((stmt_id, day), (stmt_id))")
def daily_totals(spark, sf_dir):
    return daily.grand_total(daily.daily(event_rows(spark, sf_dir)))


@query(f"""WITH {CHAIN} SELECT stmt_id, strftime(day, '%Y-%m') AS month, count(*) AS n, CAST(COALESCE(sum(withdrawal), 0) AS BIGINT) AS withdrawn, CAST(COALESCE(sum(deposit), 0) AS BIGINT) AS deposited FROM c WHERE verified GROUP BY ALL""")
def month_split(spark, sf_dir):
    d = proved(spark, sf_dir).where("verified").withColumn("month", dates.month_of(F.col("day")))
    return d.groupBy("stmt_id", "month").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("withdrawal"), F.lit(0)).alias("withdrawn"), F.coalesce(F.sum("deposit"), F.lit(0)).alias("deposited"))


# Batches


YEARS = f"""SELECT CAST(stmt_id AS VARCHAR) AS account, stmt_id || '-' || yr || tag AS name, CASE WHEN tag = 'b' THEN make_date(yr, 6, 1) ELSE make_date(yr, 1, 1) END AS period_from,
  CASE WHEN stmt_id % 50 = 0 AND yr = 1999 THEN NULL ELSE make_date(yr, 12, 31) END AS period_to, opening, closing + CASE WHEN stmt_id % 17 = 0 THEN 1 ELSE 0 END AS closing FROM (
  SELECT stmt_id, year(day) AS yr, LAG(arg_max(true_balance, seq)) OVER (PARTITION BY stmt_id ORDER BY year(day)) AS before, arg_max(true_balance, seq) AS closing FROM l GROUP BY stmt_id, year(day)) y
  CROSS JOIN (VALUES ('a'), ('b')) t(tag) CROSS JOIN LATERAL (SELECT COALESCE(before, 0) AS opening) z WHERE (yr + stmt_id) % 7 <> 0 AND (tag = 'a' OR stmt_id % 5 = 0 AND yr % 3 = 0)"""


def year_statements(spark, sf_dir):
    y = ledger(spark, sf_dir).groupBy("stmt_id", F.year("day").alias("yr")).agg(F.max_by("true_balance", "seq").alias("end"))
    before = F.coalesce(F.lag("end").over(W.partitionBy("stmt_id").orderBy("yr")), F.lit(0))
    y = y.withColumn("opening", before).withColumn("tag", F.explode(F.array(F.lit("a"), F.lit("b"))))
    y = y.where("(yr + stmt_id) % 7 <> 0 and (tag = 'a' or stmt_id % 5 = 0 and yr % 3 = 0)")
    return y.selectExpr(
        "cast(stmt_id as string) as account", "concat(stmt_id, '-', yr, tag) as name", "make_date(yr, if(tag = 'b', 6, 1), 1) as period_from",
        "if(stmt_id % 50 = 0 and yr = 1999, null, make_date(yr, 12, 31)) as period_to", "opening", "end + if(stmt_id % 17 = 0, 1, 0) as closing",
    )


BATCH = f"""WITH RECURSIVE l AS ({LEDGER}), y AS ({YEARS}), k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY COALESCE(period_from, DATE '9999-12-31'), name) AS i, bool_or(period_from IS NULL OR period_to IS NULL) OVER (PARTITION BY account) AS unread FROM y),
f AS (SELECT account, i, name, 'first' AS state, CAST(NULL AS DATE) AS gap_from, CAST(NULL AS DATE) AS gap_to, period_to AS pto, closing AS pc FROM k WHERE i = 1 AND NOT unread
 UNION ALL SELECT k.account, k.i, k.name, CASE WHEN k.period_from <= f.pto THEN 'overlap' WHEN k.period_from <> f.pto + 1 THEN 'gap' WHEN k.opening = f.pc THEN 'linked' ELSE 'broken' END,
  CASE WHEN k.period_from > f.pto + 1 THEN f.pto + 1 END, CASE WHEN k.period_from > f.pto + 1 THEN k.period_from - 1 END,
  CASE WHEN k.period_from <= f.pto THEN f.pto ELSE k.period_to END, CASE WHEN k.period_from <= f.pto THEN f.pc ELSE k.closing END FROM f JOIN k ON k.account = f.account AND k.i = f.i + 1),
links AS (SELECT account, name, state, gap_from, gap_to FROM f UNION ALL SELECT account, name, 'unreadable', NULL, NULL FROM k WHERE unread)"""


@query(f"{BATCH} SELECT account, name, state, CAST(gap_from AS DATE) AS gap_from, CAST(gap_to AS DATE) AS gap_to FROM links")
def batch_links(spark, sf_dir):
    return batch.batch_links(year_statements(spark, sf_dir))


@query(f"""{BATCH} SELECT account, count(*) AS statements, count(*) FILTER (state = 'linked') AS agreeing, count(*) FILTER (state = 'gap') AS gaps, count(*) FILTER (state = 'overlap') AS overlaps,
  count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'unreadable') AS unreadable, count(*) FILTER (state IN ('gap', 'overlap', 'broken', 'unreadable')) = 0 AS ok FROM links GROUP BY account""")
def batch_checks(spark, sf_dir):
    return batch.batch_checks(batch.batch_links(year_statements(spark, sf_dir)))


@query(f"""{BATCH}, nx AS (SELECT links.account, links.name, LEAD(state) OVER (PARTITION BY links.account ORDER BY COALESCE(y.period_from, DATE '9999-12-31'), links.name) AS next_state FROM links JOIN y ON links.account = y.account AND links.name = y.name WHERE state <> 'overlap')
SELECT l.account, l.name, state, state = 'overlap' AS left_out,
  CASE WHEN next_state = 'linked' AND length(l.name) % 2 = 0 THEN 'green' WHEN length(l.name) % 2 = 0 THEN 'yellow' ELSE 'red' END AS status FROM links l LEFT JOIN nx ON l.account = nx.account AND l.name = nx.name""")
def batch_left_out(spark, sf_dir):
    st = year_statements(spark, sf_dir)
    return batch.lifted(batch.batch_links(st), st.select("account", "name", "period_from", F.when(F.length("name") % 2 == 0, "yellow").otherwise("red").alias("status")))


# Money, dates, text


PRICES = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem"
#: A price as some statement would print it, by rule; some can't be read.
WRITTEN = """CASE p % 12 WHEN 0 THEN plain WHEN 1 THEN '(' || plain || ')' WHEN 2 THEN plain || '-' WHEN 3 THEN plain || ' Dr' WHEN 4 THEN 'THB ' || plain || ' CR' WHEN 5 THEN '*' || plain
  WHEN 6 THEN '-' || plain WHEN 7 THEN '' WHEN 8 THEN plain || '5' WHEN 9 THEN '1 2 ' || plain WHEN 10 THEN '+' || plain ELSE '฿' || plain END"""


def written(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as n", "l_partkey as p", "cast(round(l_extendedprice * 100) as bigint) as cents").distinct()
    return d.withColumn("plain", money.fmt_money(F.col("cents"))).withColumn("written", F.expr(WRITTEN))


WRITTEN_SQL = f"w AS (SELECT *, {WRITTEN} AS written FROM (SELECT DISTINCT k, n, p, cents, {_m('cents')} AS plain FROM ({PRICES})))"


@query(f"""WITH {WRITTEN_SQL} SELECT k, n, p, written, CASE WHEN regexp_full_match(written, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)\\.[0-9]{{2}}') THEN cents END AS amount,
  CASE WHEN p % 12 IN (0, 6) THEN CASE WHEN p % 12 = 6 THEN -cents ELSE cents END END AS signed FROM w""")
def money_parse(spark, sf_dir):
    d = written(spark, sf_dir)
    return d.select("k", "n", "p", "written", money.parse_amount(F.col("written")).alias("amount"), money.parse_signed(F.col("written")).alias("signed"))


@query(f"""WITH {WRITTEN_SQL} SELECT k, n, p, CASE WHEN p % 12 NOT IN (7, 8, 9) THEN cents END AS cents,
  CASE WHEN p % 12 IN (1, 2, 3, 6) THEN '-' WHEN p % 12 IN (4, 10) THEN '+' END AS sign, CASE WHEN p % 12 IN (8, 9) THEN written END AS bad, p % 12 = 7 AS blank FROM w""")
def money_cell(spark, sf_dir):
    return written(spark, sf_dir).select("k", "n", "p", F.inline(F.array(money.money_cell(F.col("written")))))


@query(f"""WITH q AS (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS c FROM supplier)
SELECT s_suppkey, {_m('c')} AS plain, CASE WHEN c < 0 THEN '-' ELSE '' END || format('{{:,}}', abs(c) // 100) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS grouped,
  regexp_replace({_m('c')}, '0$', '') AS shortest FROM q""")
def money_format(spark, sf_dir):
    c = F.round(F.col("s_acctbal") * 100).cast("bigint")
    return table(spark, sf_dir, "supplier").select("s_suppkey", money.fmt_money(c).alias("plain"), money.fmt_comma(c).alias("grouped"), money.shortest(c).alias("shortest"))


#: Order dates as cells would hold them, by rule.
CELLS = """CASE k % 9 WHEN 0 THEN lpad(CAST(dd AS {s}), 2, '0') || '/' || lpad(CAST(mm AS {s}), 2, '0') || '/' || CAST(yy + 543 AS {s}) WHEN 1 THEN CAST(yy AS {s}) || '-' || lpad(CAST(mm AS {s}), 2, '0') || '-' || lpad(CAST(dd AS {s}), 2, '0')
  WHEN 2 THEN CAST(serial AS {s}) WHEN 3 THEN CAST(dd AS {s}) || ' ' || mon || ' ' || CAST(yy AS {s}) WHEN 4 THEN CAST(mm AS {s}) || '/' || CAST(dd AS {s}) || '/' || CAST(yy AS {s})
  WHEN 5 THEN '31/02/' || CAST(yy AS {s}) WHEN 6 THEN '' WHEN 7 THEN 'soon' ELSE lpad(CAST(dd AS {s}), 2, '0') || '.' || lpad(CAST(mm AS {s}), 2, '0') || '.' || CAST((yy + 543) % 100 AS {s}) END"""


def date_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "to_date(o_orderdate) as day")
    parts = o.selectExpr("*", "day(day) as dd", "month(day) as mm", "year(day) as yy", "date_format(day, 'MMM') as mon").withColumn("serial", dates.excel_serial(F.col("day")))
    return parts.withColumn("cell", F.expr(CELLS.format(s="string")))


DATE_SQL = f"""o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, day(o_orderdate) AS dd, month(o_orderdate) AS mm, year(o_orderdate) AS yy, strftime(o_orderdate, '%b') AS mon, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial FROM orders),
t AS (SELECT *, {CELLS.format(s='VARCHAR')} AS cell, CASE WHEN k % 9 = 4 AND mm > 12 THEN NULL WHEN k % 9 = 4 AND dd <= 12 THEN make_date(yy, dd, mm) WHEN k % 9 IN (5, 6, 7) THEN NULL WHEN k % 9 = 8 THEN TRY_CAST((CASE WHEN (yy + 543) % 100 >= 60 THEN 1957 ELSE 2000 END + (yy + 543) % 100) || '-' || mm || '-' || dd AS DATE) ELSE day END AS date FROM o)"""


@query(f"""WITH {DATE_SQL} SELECT k, cell, date, CASE WHEN k % 9 = 6 THEN NULL WHEN k % 9 = 4 AND dd > 12 THEN 'only makes sense month first' WHEN k % 9 = 5 OR k % 9 = 8 AND date IS NULL THEN 'not a real date' WHEN k % 9 = 7 THEN 'could not be read as a date' WHEN year(date) < 2000 OR year(date) > 2027 THEN 'an unlikely year' END AS note,
  CASE WHEN k % 9 = 2 THEN 'number' WHEN k % 9 = 0 OR k % 9 = 8 AND date IS NOT NULL OR k % 9 = 4 AND dd <= 12 THEN 'text' END AS kind,
  COALESCE((k % 9 IN (0, 2, 8) OR k % 9 = 4 AND dd <= 12) AND day(date) > 12, false) AS day_over_12, COALESCE((k % 9 IN (0, 2, 8) OR k % 9 = 4 AND dd <= 12) AND day(date) <= 12 AND day(date) <> month(date), false) AS either_way FROM t""")
def date_cell(spark, sf_dir):
    d = date_texts(spark, sf_dir).select("k", "cell", F.inline(F.array(dates.date_cell(F.col("cell"), TODAY))))
    return d.select("k", "cell", "date", "note", "kind", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("day_over_12", "either_way")])


@query("""SELECT o_orderkey AS k, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial, CAST(o_orderdate AS DATE) AS back, year(o_orderdate) AS western, strftime(o_orderdate, '%d/%m/%Y') AS printed FROM orders""")
def excel_serial(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    serial = dates.excel_serial(F.col("day"))
    return d.select("k", serial.cast("bigint").alias("serial"), dates.from_serial(serial).alias("back"), dates.western(F.year("day") + 543).cast("bigint").alias("western"), dates.printed(F.col("day")).alias("printed"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN (year(o_orderdate) + 543) % 100 WHEN o_orderkey % 3 = 1 THEN year(o_orderdate) % 100 ELSE (year(o_orderdate) + 50) % 100 END AS yy, year(o_orderdate) AS y FROM orders),
f AS (SELECT k, yy, list_distinct(list_filter([yy + 2000, yy + 1957], lambda x: x BETWEEN y - 1 AND y + 1)) AS fits FROM o)
SELECT k, yy, CASE WHEN len(fits) = 1 THEN fits[1] END AS year, CASE WHEN len(fits) = 0 THEN 'the year fits no reading near the period' WHEN len(fits) > 1 THEN 'the year can be read in two ways' END AS note FROM f""")
def year_resolve(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k", "to_date(o_orderdate) as day", "cast(case o_orderkey % 3 when 0 then (year(o_orderdate) + 543) % 100 when 1 then year(o_orderdate) % 100 else (year(o_orderdate) + 50) % 100 end as bigint) as yy"
    )
    return d.select("k", "yy", F.inline(F.array(dates.resolve_year(F.col("yy"), F.col("day"), F.col("day")))))


@query("""SELECT o_orderkey AS k, CASE WHEN NOT o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS placed, CAST(o_orderdate AS DATE) AS passbook FROM orders""")
def short_dates(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "to_date(o_orderdate) as day")
    d = d.selectExpr("*", "date_format(day, 'dd MMM') as short", "trunc(day, 'month') as a", "last_day(day) as b", "concat(date_format(day, 'dd/MM/'), lpad(cast((year(day) + 543) % 100 as string), 2, '0')) as pb")
    far = F.when(F.col("k") % 4 == 0, 150).otherwise(0)
    placed = dates.day_month(F.col("short"), F.date_add("a", far), F.date_add("b", far))
    return d.select("k", placed.alias("placed"), dates.passbook_date(F.col("pb")).alias("passbook"))


TOKENS = "SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS token FROM documents"


@query(f"""WITH t AS ({TOKENS}), m AS (SELECT token, regexp_replace(token, '[ -]', '', 'g') AS marks FROM t)
SELECT token, right(regexp_replace(token, '[^0-9xX*]', '', 'g'), 4) AS masked, regexp_full_match(marks, '[0-9xX*]{{10,12}}') AND CASE WHEN regexp_matches(marks, '[xX*]') THEN length(regexp_replace(marks, '[^0-9]', '', 'g')) >= 6 ELSE true END AS is_account
FROM m WHERE regexp_matches(token, '[0-9]')""")
def account_shape(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("token")).where("token rlike '[0-9]'").distinct()
    return t.select("token", text.mask_account(F.col("token")).alias("masked"), text.looks_like_account(F.col("token")).alias("is_account"))


@query("""SELECT conv_id, turn, left(CASE WHEN turn % 2 = 0 AND trim(text, ' ') <> '' THEN text ELSE role END, 50) AS remark, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM conversations""")
def remark_cut(spark, sf_dir):
    first = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.remark(first, F.col("role")).alias("remark"), text.xml_escape(F.col("text")).alias("escaped"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, lower(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[[:space:]_]+', '', 'g')) AS squashed FROM pages""")
def url_names(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"), text.squash(title).alias("squashed"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT CAST(p_size AS BIGINT) * 37 AS c FROM part)
SELECT c, CASE WHEN c >= 702 THEN chr(CAST(65 + (c // 26 - 1) // 26 - 1 AS INTEGER)) ELSE '' END || CASE WHEN c >= 26 THEN chr(CAST(65 + (c // 26 - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + c % 26 AS INTEGER)) AS letters FROM n""")
def column_letters(spark, sf_dir):
    n = table(spark, sf_dir, "part").select((F.col("p_size").cast("bigint") * 37).alias("c")).distinct()
    return n.select("c", text.column_letter(F.col("c")).alias("letters"))


# Inference


#: Headings by rule: part types stand for files, words of sizes for cells.
HEADS = ["Date", "Value Date", "Description", "Account Description", "Withdrawal", "Deposit", "Balance", "Amount", "Dr", "Credit Limit Note", "Channel Code", "Remark"]


def heading_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_type as file", "cast(p_size % 7 as bigint) as row", "p_partkey % 9 as col", f"element_at(array({', '.join(repr(h) for h in HEADS)}), cast((p_partkey * 7 + p_size) % 12 + 1 as int)) as text")
    return p.groupBy("file", "row", "col").agg(F.min("text").alias("text"))


ROLE_SQL = """CASE text WHEN 'Date' THEN 'date' WHEN 'Value Date' THEN 'date' WHEN 'Description' THEN 'description' WHEN 'Account Description' THEN 'description' WHEN 'Withdrawal' THEN 'withdrawal' WHEN 'Deposit' THEN 'deposit'
  WHEN 'Balance' THEN 'balance' WHEN 'Amount' THEN 'amount' WHEN 'Dr' THEN 'withdrawal' WHEN 'Credit Limit Note' THEN 'deposit' WHEN 'Channel Code' THEN 'description' WHEN 'Remark' THEN 'description' END"""
HEADS_SQL = f"""hc AS (SELECT p_type AS file, CAST(p_size % 7 AS BIGINT) AS row, p_partkey % 9 AS col, min([{', '.join("'" + h + "'" for h in HEADS)}][(p_partkey * 7 + p_size) % 12 + 1]) AS text FROM part GROUP BY ALL),
hr AS (SELECT *, {ROLE_SQL} AS role, CASE WHEN text IN ('Account Description', 'Channel Code') THEN 4 WHEN text = 'Remark' THEN 2 WHEN text = 'Value Date' THEN 1 ELSE 0 END AS rank FROM hc)"""


@query(f"WITH {HEADS_SQL} SELECT file, row, col, text, role, rank FROM hr")
def heading_roles(spark, sf_dir):
    d = heading_cells(spark, sf_dir).withColumn("role", infer.role_of(F.col("text")))
    return d.withColumn("rank", infer.role_rank(F.col("role"), F.col("text")))


@query(f"""WITH {HEADS_SQL}, b AS (SELECT file, row, role, arg_min(col, rank * 1000 + col) AS col FROM hr GROUP BY ALL),
s AS (SELECT file, row, count(*) AS n, count(*) + count(*) FILTER (role = 'balance') AS score, string_agg(role || '=' || col, ',' ORDER BY role) AS roles FROM b GROUP BY file, row)
SELECT file, arg_max(row, score * 1000 - row) AS header, arg_max(roles, score * 1000 - row) AS roles FROM s WHERE n >= 2 GROUP BY file""")
def best_heading(spark, sf_dir):
    d = infer.find_columns(heading_cells(spark, sf_dir))
    said = F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return d.select("file", "header", said.alias("roles"))


@query(f"""WITH {DATE_SQL}, r AS (SELECT k // 500 AS file, CASE WHEN k % 9 = 2 THEN 'number' WHEN k % 9 IN (0, 4, 8) THEN 'text' ELSE 'sure' END AS kind, date, k % 9 IN (0, 2, 8) AND day(date) > 12 AS over, k % 9 = 4 AND dd > 12 AS against FROM t WHERE date IS NOT NULL),
g AS (SELECT file, kind, count(DISTINCT date) FILTER (over) AS proofs, date_diff('day', min(date) FILTER (over), max(date) FILTER (over)) AS span, bool_or(against) AS against FROM r GROUP BY file, kind)
SELECT file, kind, proofs, span, against, proofs >= 2 AND COALESCE(span, 0) <= 45 AND NOT against AS proved FROM g""")
def date_order_proof(spark, sf_dir):
    """Every readable date of a file; what only makes sense month first speaks against the texts' order."""
    d = date_texts(spark, sf_dir).select("k", F.inline(F.array(dates.date_cell(F.col("cell"), TODAY)))).where("date is not null")
    against = F.coalesce(F.col("note") == "only makes sense month first", F.lit(False))
    kind = F.when(against, "text").otherwise(F.coalesce("kind", F.lit("sure")))
    rows = d.select(F.floor(F.col("k") / 500).alias("file"), kind.alias("kind"), F.col("date").alias("day"), "day_over_12", against.alias("against"))
    return infer.date_order_proof(rows).withColumn("span", F.col("span").cast("bigint"))


#: Marks by which texts are told apart, by priority.
MARKS = [("licence", 1, ["License"]), ("secret", 2, ["token", "="]), ("french", 3, [" le ", " la "]), ("german", 4, [" der ", " die "]), ("english", 5, [" the "])]


@query("""SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, 'token') AND contains(text, '=') THEN 'secret' WHEN contains(text, ' le ') AND contains(text, ' la ') THEN 'french' WHEN contains(text, ' der ') AND contains(text, ' die ') THEN 'german' ELSE 'english' END AS profile
FROM documents WHERE contains(text, 'License') OR contains(text, 'token') AND contains(text, '=') OR contains(text, ' le ') AND contains(text, ' la ') OR contains(text, ' der ') AND contains(text, ' die ') OR contains(text, ' the ')""")
def profile_identify(spark, sf_dir):
    return infer.identify(table(spark, sf_dir, "documents").select("doc_id", "text"), MARKS)


@query("""WITH s AS (SELECT l_suppkey AS supplier, l_returnflag || l_linestatus AS candidate, count(*) AS score FROM lineitem GROUP BY ALL), t AS (SELECT *, max(score) OVER (PARTITION BY supplier) AS top FROM s)
SELECT supplier, any_value(candidate) AS candidate, any_value(score) AS score FROM t WHERE score = top GROUP BY supplier HAVING count(*) = 1 AND any_value(score) >= 3""")
def unique_best(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.concat("l_returnflag", "l_linestatus").alias("candidate")).agg(F.count(F.lit(1)).alias("score"))
    return infer.unique_best(s, "supplier")


# Layout


COLUMNS = [("date", 0.0, 20000.0, 0), ("amount", 15000.0, 50000.0, 1), ("balance", 50000.0, 80000.0, 2), ("amount", 80000.0, 90000.0, 3)]


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1,
  CASE WHEN c < 20000 THEN 'date' WHEN c < 50000 THEN 'amount' WHEN c < 80000 THEN 'balance' WHEN c < 90000 THEN 'amount' END AS "column" FROM (SELECT *, (l_extendedprice + (l_extendedprice + l_quantity)) / 2 AS c FROM lineitem)""")
def column_range_join(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as n", "l_partkey as p", "l_extendedprice as x0", "l_extendedprice + l_quantity as x1")
    return layout.to_columns(words, COLUMNS)


def event_page(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id as page", "event_id as line", "cast(unix_timestamp(ts) as double) as y", "event_type = 'purchase' as is_row", "event_type = 'error' as is_footer")


PAGE = "pg AS (SELECT user_id AS page, event_id AS line, CAST(floor(epoch(ts)) AS DOUBLE) AS y, event_type = 'purchase' AS is_row, event_type = 'error' AS is_footer FROM events)"


@query(f"""WITH {PAGE}, a AS (SELECT *, last_value(CASE WHEN is_row THEN y END IGNORE NULLS) OVER u AS ya, last_value(CASE WHEN is_row THEN line END IGNORE NULLS) OVER u AS la,
  first_value(CASE WHEN is_row THEN y END IGNORE NULLS) OVER d AS yb, first_value(CASE WHEN is_row THEN line END IGNORE NULLS) OVER d AS lb FROM pg
  WINDOW u AS (PARTITION BY page ORDER BY y, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY page ORDER BY y, line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT page, line, CASE WHEN is_row THEN line WHEN y - ya <= 20000 AND COALESCE(y - ya <= yb - y, true) THEN la WHEN yb - y <= 20000 THEN lb END AS row_line FROM a""")
def nearest_wrap(spark, sf_dir):
    return layout.settle_wrapped(event_page(spark, sf_dir), 20000.0).select("page", "line", "row_line")


@query(f"WITH {PAGE} SELECT page, line, last_value(CASE WHEN is_row THEN line END IGNORE NULLS) OVER (PARTITION BY page ORDER BY y, line) AS row_line FROM pg")
def asof_wrap(spark, sf_dir):
    return layout.wrap_to_previous(event_page(spark, sf_dir)).select("page", "line", "row_line")


@query(f"WITH {PAGE}, a AS (SELECT *, max(CASE WHEN is_footer AND NOT is_row THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, line) AS stop FROM pg) SELECT page, line FROM a WHERE stop = 0")
def footer_stop(spark, sf_dir):
    return layout.stop_at_footer(event_page(spark, sf_dir)).select("page", "line")


@query("""WITH v AS (SELECT vec_id, label, embedding[1] AS x FROM embeddings), g AS (SELECT *, CASE WHEN x - LAG(x) OVER (PARTITION BY label ORDER BY x, vec_id) > CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END AS fresh FROM v)
SELECT vec_id, label, CAST(sum(fresh) OVER (PARTITION BY label ORDER BY x, vec_id) AS BIGINT) AS cluster FROM g""")
def gap_cluster(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    return layout.gap_clusters(v, "label", "x", 0.01, "vec_id").select("vec_id", "label", "cluster")


@query("""WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i FROM events),
f AS (SELECT user_id, i, 0 AS cluster, CAST(1 AS BIGINT) AS n, value AS total FROM v WHERE i = 1
  UNION ALL SELECT v.user_id, v.i, CASE WHEN abs(v.value - f.total / f.n) <= 4 THEN f.cluster ELSE f.cluster + 1 END, CASE WHEN abs(v.value - f.total / f.n) <= 4 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(v.value - f.total / f.n) <= 4 THEN f.total + v.value ELSE v.value END
  FROM f JOIN v ON v.user_id = f.user_id AND v.i = f.i + 1)
SELECT user_id, cluster, max(n) AS n, round(arg_max(total, n) / max(n), 6) AS mean FROM f GROUP BY user_id, cluster""")
def mean_cluster(spark, sf_dir):
    d = layout.mean_clusters(table(spark, sf_dir, "events"), "user_id", "value", 4.0)
    return d.select("user_id", "cluster", "n", F.round("mean", 6).alias("mean"))


@query("""WITH p AS (SELECT label, embedding[1] * CAST(600 AS DOUBLE) AS x, embedding[2] * CAST(600 AS DOUBLE) AS y FROM embeddings), a AS (SELECT label, k, round((k - 100) * CAST(0.05 AS DOUBLE), 6) AS angle, x, y FROM p, generate_series(0, 200) t(k)),
b AS (SELECT label, k, angle, floor((y * cos(radians(angle)) - x * sin(radians(angle))) / 2) AS bin, count(*) AS n FROM a GROUP BY ALL), s AS (SELECT label, k, angle, CAST(sum(n * n) AS BIGINT) AS score FROM b GROUP BY ALL), m AS (SELECT *, max(score) OVER (PARTITION BY label) AS top FROM s)
SELECT label, round((min(angle) + max(angle)) / 2, 6) AS angle, max(score) AS score FROM m WHERE score = top GROUP BY label""")
def deskew(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("label", (F.col("embedding")[0].cast("double") * 600).alias("x"), (F.col("embedding")[1].cast("double") * 600).alias("y"))
    return layout.deskew(p, "label")


@query("""SELECT l_suppkey AS supplier, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey""")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(layout.upper_median("l_quantity").alias("median"))


@query("""WITH p AS (SELECT label AS candidate, list(x ORDER BY i) AS pattern FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, generate_series(1, 64) t(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, candidate, round(list_inner_product(CAST(embedding AS DOUBLE[]), pattern) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(pattern, pattern)), 6) AS score FROM embeddings, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) AS r FROM s)
SELECT vec_id, max(CASE WHEN r = 1 THEN candidate END) AS best, max(CASE WHEN r = 1 THEN score END) AS score, round(max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END), 6) AS margin FROM r WHERE r <= 2 GROUP BY vec_id""")
def pattern_match_margin(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    patterns = means.groupBy(F.col("label").alias("candidate")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pattern"))  # one row per label
    scores = e.select("vec_id", "embedding").join(F.broadcast(patterns)).select("vec_id", "candidate", F.round(layout.correlation(F.col("embedding"), F.col("pattern")), 6).alias("score"))
    d = layout.best_with_margin(scores, "vec_id")
    return d.withColumn("margin", F.round("margin", 6))


# Comparing results


@query("""SELECT COALESCE(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left only' WHEN d.doc_id IS NULL THEN 'right only' WHEN (d.n_chars > 500) <> (l.quality = 1) THEN 'differs' ELSE 'same' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def oracle_diff(spark, sf_dir):
    d, r = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("other"), "quality")
    both = d.join(r, d["doc_id"] == r["other"], "full")
    state = F.when(F.col("other").isNull(), "left only").when(F.col("doc_id").isNull(), "right only").when((F.col("n_chars") > 500) != (F.col("quality") == 1), "differs").otherwise("same")
    return both.select(F.coalesce("doc_id", "other").alias("doc_id"), state.alias("state"))


# Files


def statement_files(spark, sf_dir, kind: str) -> DataFrame:
    """Each supplier's customers' orders as a table file's bytes, made by Spark: ``path, length, content``."""
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey as k", "c_custkey", "c_name", "cast(round(c_acctbal * 100) as bigint) as cents", "c_mktsegment as seg")
    if kind == "csv":
        line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(';""'), "seg", F.lit('"""')), money.fmt_money(F.col("cents")))
        head, sep, ext = F.lit("key;name;balance\r\n"), "\r\n", ".csv"
    else:
        cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
        line = F.concat(F.lit("<TR>"), cell(F.col("c_custkey").cast("string")), cell(F.concat(F.lit(" <b>"), "c_name", F.lit("</b>;<br/>&quot;"), "seg", F.lit("&quot;\n"))), cell(money.fmt_money(F.col("cents"))), F.lit("</TR>"))
        head, sep, ext = F.lit("<table><tr><th>key<th>name<th>balance</tr>"), "", ".xls"
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), sep)
    body = c.groupBy(F.col("k"), F.floor(F.col("c_custkey") / 2000).alias("part")).agg(F.concat(head, lines).cast("binary").alias("content"))
    return body.select(F.concat(F.col("k").cast("string"), F.lit("-"), F.col("part").cast("string"), F.lit(ext)).alias("path"), F.octet_length("content").cast("bigint").alias("length"), "content")


def read_back(files: DataFrame) -> DataFrame:
    """Rows of files that Spark has made; a refused one fails the query, as its rows would be missing."""
    from ..sources.tables import made_cells

    refused = F.raise_error(F.concat_ws(": ", "file", "error")).cast("boolean")
    found = made_cells(files).where(F.when(F.col("error").isNotNull(), refused).otherwise(F.col("row") > 0))
    value = F.coalesce("s", F.regexp_replace(F.col("n").cast("decimal(20,2)").cast("string"), r"\.00\z", ""))
    return found.groupBy("file", "row").agg(*[F.max(F.when(F.col("col") == i, value)).alias(name) for i, name in enumerate(("key", "name", "balance"))]).drop("row")


FILES_SQL = """SELECT c_nationkey || '-' || c_custkey // 2000 || '{0}' AS file, CAST(c_custkey AS VARCHAR) AS key, c_name || ';{1}"' || c_mktsegment || '"' AS name, {2} AS balance FROM (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)"""


@query(FILES_SQL.format(".csv", "", _m("cents")))
def csv_tables(spark, sf_dir):
    return read_back(statement_files(spark, sf_dir, "csv"))


@query(FILES_SQL.format(".xls", " ", _m("cents")))
def html_tables(spark, sf_dir):
    return read_back(statement_files(spark, sf_dir, "html"))


@query("""SELECT c_custkey // 500 || '.xlsx' AS file, CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS balance FROM customer""")
def workbook_round_trip(spark, sf_dir):
    from ..sinks.workbooks import files

    c = table(spark, sf_dir, "customer").selectExpr("c_custkey div 500 as part", "c_custkey as key", "c_name as name", "cast(round(c_acctbal * 100) as bigint) as balance")
    return read_back(files(c, "part", ["key"], ["key", "name", "balance"]))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[[:space:]]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), ' +', ' ', 'g'), ' ') AS text FROM pages""")
def html_entity_text(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(t, " +", " ")).alias("text"))


# Streams


@query("""SELECT user_id AS stmt_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""")
def stream_daily(spark, sf_dir):
    from ..streaming.ledger_stream import daily_windows, latest, run

    # A pattern, as the stream's source takes a single file only so.
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("user_id").alias("stmt_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return latest(run(spark, daily_windows(events), "update", "stream-daily"), "stmt_id", "day")


@query(f"""WITH l AS ({LEDGER}), k AS (SELECT stmt_id, seq, amount, balance, COALESCE(last_value(balance IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT stmt_id, seq, amount, balance, CASE WHEN balance IS NULL THEN 'open' WHEN abs(balance - before) = amount THEN 'proved' ELSE 'broken' END AS state FROM k""")
def stream_chain(spark, sf_dir):
    from ..scratch import scratch
    from ..streaming.ledger_stream import chain_stream

    rows = ledger(spark, sf_dir).select("stmt_id", "seq", "amount", "balance")
    path = scratch(spark, "stream-ledger")
    rows.write.parquet(path)
    return chain_stream(spark.readStream.schema(rows.schema).parquet(path), "stream-chain").drop("batch")
