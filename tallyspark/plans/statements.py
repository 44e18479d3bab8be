"""Queries of line statements, imports, repairs and summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates, money, repair
from ..operators import chain, checks, infer, statements
from . import queries as base
from .ledger import CHAIN, LEDGER, SPLIT, ledger
from .queries import TODAY, TRUST, _m, heading_cells, proved, query, table, trusted

# Statements from lines


LINES = f"""SELECT stmt_id, seq, day, CASE WHEN row_id % 19 = 0 THEN NULL ELSE amount END AS amount, balance, CASE WHEN row_id % 5 = 0 THEN NULL WHEN x1 < 250 THEN '-' WHEN x1 >= 250 THEN '+' END AS sign,
  CASE WHEN stmt_id % 2 = 0 THEN CAST(0 AS BIGINT) END AS stated_opening FROM ({LEDGER}) AS ledger"""


def lines(spark, sf_dir):
    return spark.sql(LINES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


LINE_OPENING = f"""ln AS ({LINES}), fo AS (SELECT *, first_value(balance) OVER w AS fb, first_value(amount) OVER w AS fa, first_value(sign) OVER w AS fs, row_number() OVER w AS place FROM ln WINDOW w AS (PARTITION BY stmt_id ORDER BY seq)),
op AS (SELECT *, stated_opening IS NULL AS opening_derived, COALESCE(stated_opening, fb - CASE WHEN fs = '-' THEN -fa ELSE fa END, 0) AS opening FROM fo)"""


@query(f"WITH {LINE_OPENING} SELECT stmt_id, any_value(opening) AS opening, bool_or(opening_derived) AS opening_derived FROM op GROUP BY stmt_id")
def line_opening(spark, sf_dir):
    return statements.line_opening(lines(spark, sf_dir)).groupBy("stmt_id").agg(F.max("opening").alias("opening"), F.bool_or("opening_derived").alias("opening_derived"))


@query(f"""WITH {LINE_OPENING}, k AS (SELECT *, COALESCE(last_value(balance IGNORE NULLS) OVER u, opening) AS running, COALESCE(LAG(balance) OVER w, CASE WHEN row_number() OVER w = 1 THEN opening END) AS before
  FROM op WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY stmt_id ORDER BY seq), u AS (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, balance IS NOT NULL AND before IS NOT NULL AND balance <> running AND abs(balance - running) = amount AS ok, balance - running AS moved FROM k),
j AS (SELECT op.stmt_id, op.seq, op.amount, op.balance, op.sign, COALESCE(v.ok, false) AS ok, CASE WHEN v.ok AND v.moved < 0 THEN op.amount END AS withdrawal, CASE WHEN v.ok AND v.moved > 0 THEN op.amount END AS deposit, COALESCE(v.ok, false) AND NOT (op.opening_derived AND op.place = 1) AS verified
  FROM op LEFT JOIN v ON op.stmt_id = v.stmt_id AND op.seq = v.seq)
SELECT stmt_id, seq, verified, withdrawal, deposit, CASE WHEN amount IS NULL AND balance IS NULL THEN 'nothing on this line could be read' WHEN amount IS NULL THEN 'the amount could not be read' WHEN balance IS NULL THEN 'the balance could not be read' END AS reading,
  CASE WHEN verified AND (sign = '-') <> (withdrawal IS NOT NULL) THEN 'shown as a ' || CASE WHEN sign = '-' THEN 'withdrawal' ELSE 'deposit' END || ' but the balance says ' || CASE WHEN withdrawal IS NOT NULL THEN 'withdrawal' ELSE 'deposit' END || ' - check this line' END AS sign_note FROM j""")
def lines_statement(spark, sf_dir):
    return statements.lines_statement(lines(spark, sf_dir)).select("stmt_id", "seq", "verified", "withdrawal", "deposit", "reading", "sign_note")


@query(f"""WITH l AS ({LEDGER}), k AS (SELECT *, COALESCE(last_value(balance IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM l)
SELECT stmt_id, seq, strftime(day, '%Y-%m-%d') || ' ' || seq AS dropped FROM k WHERE amount = 0 AND balance = known AND row_id % 5 <> 0""")
def table_zero_lines(spark, sf_dir):
    d = ledger(spark, sf_dir).withColumn("date_note", F.when(F.col("row_id") % 5 == 0, "doubtful"))
    return statements.table_zero_lines(d).select("stmt_id", "seq", "dropped")


@query(f"WITH l AS ({LEDGER}), k AS (SELECT *, COALESCE(last_value(balance IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM l) SELECT stmt_id, seq, 'row ' || row_id AS dropped FROM k WHERE amount = 0 AND balance = known")
def zero_line_labels(spark, sf_dir):
    d = ledger(spark, sf_dir).withColumn("date_note", F.lit(None).cast("string"))
    return statements.table_zero_lines(d, lambda: F.concat(F.lit("row "), F.col("row_id").cast("string"))).select("stmt_id", "seq", "dropped")


@query(f"""WITH {base.HEADS_SQL}, b AS (SELECT file, row, role, arg_min(col, rank * 1000 + col) AS col FROM hr GROUP BY ALL),
h AS (SELECT file, row, string_agg(role || '=' || col, ',' ORDER BY role) AS text, count(*) AS n FROM b GROUP BY file, row),
f AS (SELECT *, first_value(text) OVER w AS text0, first_value(n) OVER w AS n0, first_value(row) OVER w AS row0 FROM h WINDOW w AS (PARTITION BY file ORDER BY row)),
s AS (SELECT b.file, b.row, bool_and(COALESCE(a.col = b.col, false)) AS same FROM b JOIN f ON b.file = f.file AND b.row = f.row LEFT JOIN b a ON a.file = b.file AND a.row = f.row0 AND a.role = b.role GROUP BY b.file, b.row)
SELECT f.file AS set_id, f.row AS file_no, f.text = f.text0 OR s.same AND f.n >= least(3, f.n0) AS fits FROM f JOIN s ON f.file = s.file AND f.row = s.row""")
def heading_fits(spark, sf_dir):
    """The headings of a part type's rows stand for files of one set."""
    d = heading_cells(spark, sf_dir).withColumn("role", infer.role_of(F.col("text"))).where("role is not null")
    own = W.partitionBy("file", "row", "role").orderBy(infer.role_rank(F.col("role"), F.col("text")), "col")
    best = d.withColumn("r", F.row_number().over(own)).where("r = 1")
    entries = F.sort_array(F.collect_list(F.struct("role", "col")))
    heads = best.groupBy(F.col("file").alias("set_id"), F.col("row").alias("file_no")).agg(
        F.map_from_entries(entries).alias("roles"), F.array_join(F.transform(entries, lambda e: F.concat(e["role"], F.lit("="), e["col"].cast("string"))), ",").alias("text")
    )
    return statements.heading_fits(heads).select("set_id", "file_no", "fits")


@query(f"WITH ln AS ({LINES}) SELECT stmt_id, bool_and(CASE WHEN stmt_id % 3 = 0 THEN true ELSE sign IS NULL END) AND bool_and(balance IS NULL OR balance >= 0) AS overdraft FROM ln GROUP BY stmt_id")
def table_warnings(spark, sf_dir):
    return statements.warnings(lines(spark, sf_dir).withColumn("sign", F.when(F.col("stmt_id") % 3 != 0, F.col("sign"))))


@query(f"""WITH l AS ({LEDGER}), t AS (SELECT stmt_id AS doc, x1, sum(amount) AS amount FROM l WHERE x1 IS NOT NULL GROUP BY stmt_id, x1)
SELECT doc, CAST(max(CASE WHEN x1 < 250 THEN amount END) AS BIGINT) AS withdraw_total, CAST(max(CASE WHEN x1 >= 250 THEN amount END) AS BIGINT) AS deposit_total FROM t GROUP BY doc HAVING count(*) = 2""")
def totals_by_side(spark, sf_dir):
    t = ledger(spark, sf_dir).where("x1 is not null").groupBy(F.col("stmt_id").alias("doc"), "x1").agg(F.sum("amount").alias("amount"))
    return statements.totals_line(t, SPLIT)


# Checks with tax, and what can be sent


@query(f"""WITH {CHAIN}, x AS (SELECT *, verified AND COALESCE(tax, 0) <> 0 AS taxed FROM c),
tt AS (SELECT stmt_id, verified, withdrawal, deposit, false AS is_tax, tax FROM x UNION ALL SELECT stmt_id, true, tax, NULL, true, NULL FROM x WHERE taxed)
SELECT stmt_id, count(*) AS rows, count(*) FILTER (verified) AS verified_rows, CAST(COALESCE(sum(withdrawal) FILTER (NOT is_tax), 0) AS BIGINT) AS withdrawn, CAST(COALESCE(sum(withdrawal) FILTER (is_tax), 0) AS BIGINT) AS tax, count(*) FILTER (is_tax) AS tax_rows FROM tt GROUP BY stmt_id""")
def tax_totals(spark, sf_dir):
    """Control totals of rows whose tax is split off: the bank's own withdrawal total leaves it out."""
    split = chain.split_tax(proved(spark, sf_dir)).withColumn("day", F.lit(None).cast("date")).withColumn("has_notes", F.lit(False))
    return checks.totals(split).select("stmt_id", "rows", "verified_rows", "withdrawn", "tax", "tax_rows")


@query(f"""WITH {TRUST}, ck AS (SELECT stmt_id, bool_and(verified) AS all_proved, stmt_id % 4 = 0 AS other_bad, stmt_id % 5 = 0 AS contradicted, stmt_id % 3 <> 1 AS from_photo FROM h GROUP BY stmt_id)
SELECT h.stmt_id, h.seq FROM h JOIN ck ON h.stmt_id = ck.stmt_id WHERE confirmed AND from_photo AND NOT contradicted AND NOT all_proved AND NOT other_bad""")
def partial_rows(spark, sf_dir):
    from ..operators import trust

    rows = trust.confirmed_rows(trusted(spark, sf_dir))
    per = rows.groupBy("stmt_id").agg(F.bool_and("verified").alias("all_proved"))
    check = per.select("stmt_id", F.explode(F.array(
        F.struct(F.lit("Every row agrees with the running balance").alias("label"), F.col("all_proved").alias("passed")), F.struct(F.lit("Dates never go backwards").alias("label"), (F.col("stmt_id") % 4 != 0).alias("passed")),
    )).alias("c")).select("stmt_id", "c.*")
    facts = per.select("stmt_id", (F.col("stmt_id") % 3 != 1).alias("from_photo"), (F.col("stmt_id") % 5 == 0).alias("contradicted"))
    return statements.partial_rows(check, rows, facts)


GROUPS = """SELECT c_custkey AS group_id, lower(substr(c_mktsegment, 1, 4)) AS bank, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('20-', 10000000 + c_custkey) END AS account, c_name AS name,
  CASE WHEN c_custkey % 10 <> 0 THEN DATE '1995-01-01' END AS period_from, CASE WHEN c_custkey % 10 <> 0 THEN DATE '2001-12-31' END AS period_to, c_custkey % 7 = 0 AS untested FROM customer"""


def groups(spark, sf_dir):
    return spark.sql(GROUPS.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))


FILE_NAME = """upper(bank) || '_' || CASE WHEN account <> '' THEN right(regexp_replace(account, '[^0-9xX*]', '', 'g'), 4) ELSE name END || '_' || {0} || '_BKTRN.xlsx'"""
SPAN = "COALESCE(strftime(period_from, '%Y%m') || '-' || strftime(period_to, '%Y%m'), 'period-unknown')"
FILES = f"""{CHAIN}, gr AS ({GROUPS}), sm AS (SELECT stmt_id AS group_id, count(*) AS n, CAST(COALESCE(sum(withdrawal), 0) AS BIGINT) AS withdrawn, CAST(COALESCE(sum(deposit), 0) AS BIGINT) AS deposited FROM c WHERE verified GROUP BY stmt_id)"""


@query(f"""WITH {FILES} SELECT group_id, CASE WHEN n > 0 THEN {FILE_NAME.format(SPAN)} END AS file, COALESCE(n, 0) AS n, withdrawn, deposited, CASE WHEN n IS NULL THEN 'nothing to import - ' || name || ': no rows' END AS refused FROM gr LEFT JOIN sm USING (group_id)""")
def import_files(spark, sf_dir):
    rows = proved(spark, sf_dir).where("verified").select(F.col("stmt_id").alias("group_id"), "withdrawal", "deposit")
    return statements.import_files(rows, groups(spark, sf_dir))


@query(f"""WITH {CHAIN}, gr AS ({GROUPS}), sm AS (SELECT stmt_id AS group_id, strftime(day, '%Y-%m') AS month, count(*) AS n, CAST(COALESCE(sum(withdrawal), 0) AS BIGINT) AS withdrawn, CAST(COALESCE(sum(deposit), 0) AS BIGINT) AS deposited FROM c WHERE verified GROUP BY ALL)
SELECT group_id, month, {FILE_NAME.format("replace(month, '-', '')")} AS file, n, withdrawn, deposited FROM gr JOIN sm USING (group_id)""")
def import_month_files(spark, sf_dir):
    rows = proved(spark, sf_dir).where("verified").select(F.col("stmt_id").alias("group_id"), dates.month_of(F.col("day")).alias("month"), "withdrawal", "deposit")
    return statements.import_files(rows, groups(spark, sf_dir), "month").where("n > 0").drop("refused")


@query(f"WITH {CHAIN} SELECT stmt_id, count(DISTINCT strftime(day, '%Y-%m')) AS months, min(strftime(day, '%Y-%m')) AS first_month FROM c WHERE verified GROUP BY stmt_id")
def import_months(spark, sf_dir):
    d = proved(spark, sf_dir).where("verified").select("stmt_id", dates.month_of(F.col("day")).alias("month"))
    return d.groupBy("stmt_id").agg(F.countDistinct("month").alias("months"), F.min("month").alias("first_month"))


_COMMA = "(format('{{:,}}', {0} // 100) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0'))"


@query(f"""WITH {FILES}, st AS (SELECT o_custkey AS group_id, o_orderstatus <> 'P' AS kept FROM orders GROUP BY ALL), ks AS (SELECT group_id, count(*) FILTER (kept) AS k FROM st GROUP BY group_id),
f AS (SELECT gr.group_id, untested, COALESCE(n, 0) AS n, COALESCE(withdrawn, 0) AS w, COALESCE(deposited, 0) AS d, COALESCE(k, 0) AS k FROM gr LEFT JOIN sm USING (group_id) LEFT JOIN ks USING (group_id))
SELECT group_id, 0 AS ord, 'Caveat' AS label, 'this layout is untested - check every line' AS value FROM f WHERE untested UNION ALL SELECT group_id, 1, 'Statements in this file', CAST(k AS VARCHAR) FROM f
UNION ALL SELECT group_id, 2, 'Rows in this file', CAST(n AS VARCHAR) FROM f UNION ALL SELECT group_id, 3, 'Withdrawals', {_COMMA.format('w')} FROM f UNION ALL SELECT group_id, 4, 'Deposits', {_COMMA.format('d')} FROM f""")
def import_proof(spark, sf_dir):
    rows = proved(spark, sf_dir).where("verified").select(F.col("stmt_id").alias("group_id"), "withdrawal", "deposit")
    files = statements.import_files(rows, groups(spark, sf_dir)).join(groups(spark, sf_dir).select("group_id", "untested"), "group_id")
    st = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id"), (F.col("o_orderstatus") == "P").alias("left_out")).agg(F.count(F.lit(1)).alias("n"))
    return statements.batch_proof(files, st.select("group_id", "left_out"))


@query("""WITH c AS (SELECT p_brand AS sheet, CAST(p_size AS INTEGER) % 9 + 1 AS row, p_partkey % 40 AS col, min(p_name) AS value FROM part GROUP BY ALL), e AS (SELECT sheet, unnest(generate_series(1, max(row))) AS row FROM c GROUP BY sheet),
w AS (SELECT sheet, row, max(col) AS last FROM c GROUP BY ALL), g AS (SELECT w.sheet, w.row, t.col, COALESCE(c.value, '') AS value FROM w, LATERAL (SELECT unnest(generate_series(0, w.last)) AS col) t LEFT JOIN c ON c.sheet = w.sheet AND c.row = w.row AND c.col = t.col),
r AS (SELECT sheet, row, string_agg(value, '|' ORDER BY col) AS line FROM g GROUP BY ALL) SELECT e.sheet, e.row, COALESCE(line, '') AS line FROM e LEFT JOIN r ON e.sheet = r.sheet AND e.row = r.row""")
def dense_grid(spark, sf_dir):
    from ..functions.text import column_letter

    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sheet"), (F.col("p_size").cast("int") % 9 + 1).alias("row"), (F.col("p_partkey") % 40).alias("col")).agg(F.min("p_name").alias("value"))
    cells = p.select("sheet", F.concat(column_letter(F.col("col")), F.col("row").cast("string")).alias("ref"), "value")
    return statements.dense_grid(cells).select("sheet", "row", F.array_join("values", "|").alias("line"))


@query(f"WITH {base.STATUS} SELECT n_nationkey AS nation, count(*) FILTER (status = 'green') AS green, count(*) FILTER (status = 'yellow') AS yellow, count(*) FILTER (status = 'red') AS red, CASE WHEN count(*) FILTER (status = 'red') > 0 THEN 'red' ELSE 'yellow' END AS light FROM st JOIN customer ON stmt_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def set_lights(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stmt_id"), F.col("c_nationkey").alias("nation"))
    return statements.set_lights(base.status_light(spark, sf_dir).withColumnRenamed("status", "light").join(c, "stmt_id"), "nation")


@query(f"""WITH {base.STATUS}, a AS (SELECT c_mktsegment AS segment, count(*) AS accounts, max(CASE status WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 4 END) AS w FROM st JOIN customer ON stmt_id = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
r AS (SELECT c_mktsegment AS segment, count(*) AS refusals FROM customer WHERE c_acctbal < 0 GROUP BY 1)
SELECT COALESCE(a.segment, r.segment) AS segment, COALESCE(accounts, 0) AS accounts, CASE w WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' WHEN 4 THEN 'red' ELSE 'blocked' END AS banner, COALESCE(refusals, 0) AS refusals FROM a FULL JOIN r ON a.segment = r.segment""")
def batch_banner(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stmt_id"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    accounts = base.status_light(spark, sf_dir).join(c, "stmt_id").where("segment <> 'BUILDING'")
    return statements.banner(accounts, c.where("c_acctbal < 0"), "segment")


@query(f"WITH l AS ({LEDGER}), y AS ({base.YEARS}), k AS (SELECT 'kb|' || CASE WHEN length(name) % 3 = 0 THEN '? ' || name ELSE account END AS account_key FROM y) SELECT account_key, count(*) AS statements FROM k GROUP BY account_key")
def account_groups(spark, sf_dir):
    from ..operators import batch

    d = base.year_statements(spark, sf_dir).withColumn("profile", F.lit("kb")).withColumn("account", F.when(F.length("name") % 3 != 0, F.col("account")))
    return d.groupBy(batch.account_key().alias("account_key")).agg(F.count(F.lit(1)).alias("statements"))


@query("""WITH n AS (SELECT l_suppkey AS file, l_linenumber AS col, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL) SELECT file, col, n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, col) AS r FROM n) WHERE r <= 2""")
def fullest_columns(spark, sf_dir):
    return statements.fullest_columns(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("col"), F.col("l_orderkey").alias("row")))


@query("SELECT l_suppkey AS file, l_linenumber AS col, count(DISTINCT l_orderkey) AS rows FROM lineitem GROUP BY ALL")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("col")).agg(F.countDistinct("l_orderkey").alias("rows"))


@query("""WITH r AS (SELECT l_suppkey AS file, l_returnflag AS reason, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS r FROM lineitem)
SELECT file, string_agg(reason, '; ' ORDER BY r) FILTER (r <= 8) || CASE WHEN count(*) > 8 THEN '; and ' || (count(*) - 8) || ' more' ELSE '' END AS said FROM r GROUP BY file""")
def told_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("reason"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("seq"))
    return statements.told_reasons(d, "file")


@query("""WITH c AS (SELECT user_id, event_type AS cluster, count(*) FILTER (event_id % 3 = 0) AS dated, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, cluster, dated, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dated DESC, n DESC, cluster) AS r FROM c) WHERE r = 1""")
def best_cluster(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("cluster")).agg(F.count(F.when(F.col("event_id") % 3 == 0, 1)).alias("dated"), F.count(F.lit(1)).alias("n"))
    return statements.best_cluster(c, "user_id")


@query("""SELECT o_custkey AS doc, count(*) AS cells, count(*) FILTER (o_orderkey % 8 <> 0) AS right, count(*) FILTER (o_orderkey % 8 = 0 AND o_orderkey % 3 <> 0) AS silently_wrong FROM orders GROUP BY o_custkey""")
def reading_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"))
    wrong = F.when(F.col("o_orderkey") % 8 == 0, 1).otherwise(0)
    return statements.score_reading(o.select("doc", "o_orderkey", (F.col("value") + wrong).alias("value"), (F.col("o_orderkey") % 3 != 0).alias("proved")), o, "o_orderkey")


# Words: repairs and shapes


@query("""WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%d') AS d, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%y') AS y FROM orders),
t AS (SELECT k, d, m, y, CASE k % 6 WHEN 0 THEN d || '/' || m || '/' || y WHEN 1 THEN d || '7' || m || '1' || y WHEN 2 THEN d || '/' || m || y WHEN 3 THEN d || m || '/' || y WHEN 4 THEN d || '|' || m || '|20' || y ELSE 'no' END AS word FROM o)
SELECT k, word, CASE WHEN k % 6 IN (0, 1, 2) THEN d || '/' || m || '/' || y WHEN k % 6 = 4 THEN d || '/' || m || '/20' || y END AS repaired FROM t""")
def date_repair(spark, sf_dir):
    """Dates with slashes read as look-alikes or lost; a lost first slash isn't repaired, as the day wouldn't be certain."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *[F.date_format("o_orderdate", f).alias(n) for n, f in (("d", "dd"), ("m", "MM"), ("y", "yy"))])
    word = F.expr("case k % 6 when 0 then concat(d, '/', m, '/', y) when 1 then concat(d, '7', m, '1', y) when 2 then concat(d, '/', m, y) when 3 then concat(d, m, '/', y) when 4 then concat(d, '|', m, '|20', y) else 'no' end")
    return o.select("k", word.alias("word")).withColumn("repaired", repair.repair_date(F.col("word")))


_PLAIN = _m("c")


@query(f"""WITH q AS (SELECT DISTINCT l_partkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem WHERE l_extendedprice >= 1000), t AS (SELECT k, c, format('{{:,}}', c // 100) AS g, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS f FROM q)
SELECT k, CASE k % 3 WHEN 0 THEN replace(g, ',', '.') || ',' || f WHEN 1 THEN g || '.' || f ELSE replace(g, ',', '.') || '.' || f END AS word, CASE WHEN k % 3 <> 1 THEN g || '.' || f END AS offered FROM t""")
def separator_fix(spark, sf_dir):
    """Figures of 1,000 and more, whose marks can be mixed up."""
    q = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 1000").select(F.col("l_partkey").alias("k"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c")).distinct()
    g = money.fmt_comma(F.col("c"))
    whole, cents = F.regexp_replace(g, r"\.\d\d\z", ""), F.right(g, F.lit(2))
    dots = F.regexp_replace(whole, ",", ".")
    word = F.when(F.col("k") % 3 == 0, F.concat(dots, F.lit(","), cents)).when(F.col("k") % 3 == 1, g).otherwise(F.concat(dots, F.lit("."), cents))
    return q.select("k", word.alias("word")).withColumn("offered", repair.separator_fix(F.col("word")))


@query(f"""WITH q AS (SELECT s_suppkey AS k, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c, s_name AS n FROM supplier), t AS (SELECT *, format('{{:,}}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS m FROM q)
SELECT k, CASE k % 4 WHEN 0 THEN m || '|' || n WHEN 1 THEN m WHEN 2 THEN n ELSE m || '|' || n END AS parts FROM t""")
def glued_words(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), money.fmt_comma(F.round(F.abs("s_acctbal") * 100).cast("bigint")).alias("m"), F.col("s_name").alias("n"))
    word = F.when(F.col("k") % 4 == 0, F.concat("m", F.lit("("), "n")).when(F.col("k") % 4 == 1, F.concat(F.lit("!"), "m", F.lit(";|"))).when(F.col("k") % 4 == 2, F.col("n")).otherwise(F.concat("m", "n"))
    return q.select("k", F.array_join(repair.split_glued(word), "|").alias("parts"))


@query(f"""WITH q AS (SELECT s_suppkey AS k, {_m('CAST(round(abs(s_acctbal) * 100) AS BIGINT)')} AS m FROM supplier) SELECT k, CASE k % 5 WHEN 0 THEN m WHEN 1 THEN '+' || m WHEN 2 THEN m WHEN 3 THEN '-' || m ELSE m END AS figure FROM q""")
def passbook_marks(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), money.fmt_money(F.round(F.abs("s_acctbal") * 100).cast("bigint")).alias("m"))
    head = F.element_at(F.array(*map(F.lit, ("*", "#", "$", "$-", ""))), (F.col("k") % 5 + 1).cast("int"))
    return q.select("k", repair.passbook_mark(F.concat(head, "m"), F.col("k") % 5 == 2).alias("figure"))


@query(f"""WITH q AS (SELECT s_suppkey AS k, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier) SELECT k, 'paid ' || CASE WHEN c >= 100000 THEN format('{{:,}}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') ELSE {_m('c')} END || ' out' AS line FROM q""")
def split_money(spark, sf_dir):
    """Figures that were cut at their last comma are put together again."""
    m = money.fmt_comma(F.round(F.abs("s_acctbal") * 100).cast("bigint"))
    words = F.split(F.concat(F.lit("paid "), F.regexp_replace(m, r",(\d{3}\.\d\d)\z", ", $1"), F.lit(" out")), " ")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.array_join(repair.join_split_money(words), " ").alias("line"))


@query("""WITH d AS (SELECT conv_id, turn, role || ' pay ' || CASE WHEN turn % 3 = 0 THEN role || ' pay ' WHEN turn % 3 = 1 THEN 'to ' || role || ' ' ELSE '' END || 'now' AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN regexp_extract(t, '^[a-z]+ pay') WHEN 1 THEN regexp_extract(t, '^[a-z]+') END AS channel, CASE turn % 3 WHEN 0 THEN regexp_replace(t, '^[a-z]+ pay ', '') WHEN 1 THEN regexp_replace(t, '^[a-z]+ ', '') ELSE t END AS description FROM d""")
def lead_channel(spark, sf_dir):
    t = F.expr("concat(role, ' pay ', case turn % 3 when 0 then concat(role, ' pay ') when 1 then concat('to ', role, ' ') else '' end, 'now')")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(F.array(repair.lead_channel(t))))


@query("""SELECT p_partkey AS k, contains(regexp_replace(p_name, '[[:space:]/]+', '', 'g'), 'name1') OR contains(regexp_replace(p_name, '[[:space:]/]+', '', 'g'), 'B1') AS loose, contains(regexp_replace(p_name, '[[:space:]]+', '', 'g'), 'name2') AS spaced FROM (SELECT p_partkey, 'na me' || p_size || '/ ' || p_brand || ' B/ ' || p_size AS p_name FROM part)""")
def loose_marks(spark, sf_dir):
    t = F.concat(F.lit("na me"), F.col("p_size").cast("string"), F.lit("/ "), "p_brand", F.lit(" B/ "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), repair.has_mark(t, ["na/me 1", "B /1"], r"[\s/]+").alias("loose"), repair.has_mark(t, ["name 2"]).alias("spaced"))


@query("""SELECT doc_id, 'page furniture leaked into this row''s text (' || array_to_string(list_filter(['License', 'token', ' the '], lambda m: contains(text, m)), ', ') || ') - the amounts are still proved by the balance, but the description is not trustworthy' AS note
FROM documents WHERE contains(text, 'License') OR contains(text, 'token') OR contains(text, ' the ')""")
def furniture_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", repair.furniture_note(F.col("text"), ["License", "token", " the "]).alias("note")).where("note is not null")


@query("""WITH w AS (SELECT o_custkey AS stmt_id, o_orderkey // 4 AS line, count(*) FILTER (o_orderkey % 3 <> 0) AS dates FROM orders GROUP BY ALL) SELECT stmt_id, line, dates FROM w WHERE dates > 1""")
def two_dates_on_a_line(spark, sf_dir):
    """Lines into which two dates fell: the grouping took two lines for one."""
    word = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.col("o_orderpriority"))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("stmt_id"), F.floor(F.col("o_orderkey") / 4).alias("line")).agg(F.collect_list(word).alias("words"))
    return d.select("stmt_id", "line", repair.dates_on_line(F.col("words")).cast("bigint").alias("dates")).where("dates > 1")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 97 WHEN 1 THEN o_orderkey % 89 WHEN 2 THEN NULL ELSE NULL END AS n FROM orders""")
def count_in_text(spark, sf_dir):
    t = F.expr("case o_orderkey % 4 when 0 then concat('รวมถอนเงิน ', o_orderkey % 97, ' รายการ 5 6') when 1 then concat('total ', o_orderkey % 89, ' 12.00') when 2 then '3 and 4' else 'none' end")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), repair.count_in(t).alias("n"))


@query(f"""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '-' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(o_orderkey % 50 AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN '12-' || o_custkey ELSE o_orderpriority END AS value FROM orders""")
def typed_facts(spark, sf_dir):
    key = F.element_at(F.array(*map(F.lit, ("closing_stated", "withdraw_count", "period_from", "account_no", "branch"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    cents = money.fmt_comma(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    value = F.when(key == "closing_stated", F.concat(F.lit("-"), cents)).when(key == "withdraw_count", F.lpad((F.col("o_orderkey") % 50).cast("string"), 3, "0")).when(key == "period_from", F.date_format("o_orderdate", "dd.MM-yyyy")).when(key == "account_no", F.concat(F.lit(" 12  "), F.col("o_custkey").cast("string"), F.lit(" "))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), repair.pattern_value(key, value).alias("value"))


@query(f"""SELECT s_suppkey AS k, CAST(abs(c) AS BIGINT) AS beside_sign, CASE WHEN c >= 0 THEN c END AS plain FROM (SELECT *, CAST(round(s_acctbal * 100) AS BIGINT) AS c FROM supplier)""")
def amounts_with_signs(spark, sf_dir):
    m = money.fmt_comma(F.round(F.col("s_acctbal") * 100).cast("bigint"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), repair.amount_of(m, True).alias("beside_sign"), repair.amount_of(m, False).alias("plain"))


@query(f"""SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c END AS cents, CASE WHEN s_suppkey % 4 = 1 THEN 'not an amount: ' || s_name END AS refused FROM (SELECT *, CAST(round(s_acctbal * 100) AS BIGINT) AS c FROM supplier)""")
def typed_balances(spark, sf_dir):
    m = money.fmt_money(F.round(F.col("s_acctbal") * 100).cast("bigint"))
    typed = F.when(F.col("s_suppkey") % 4 == 0, " ").when(F.col("s_suppkey") % 4 == 1, F.col("s_name")).otherwise(m)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.inline(F.array(repair.typed_balance(typed))))


@query("""SELECT c_custkey AS k, list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1] AS place FROM (SELECT c_custkey, c_name AS a, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || '9' ELSE replace(c_name, '5', '6') END AS b FROM customer)""")
def first_differences(spark, sf_dir):
    b = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit("9"))).otherwise(F.replace("c_name", F.lit("5"), F.lit("6")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), repair.first_difference(F.col("c_name"), b).cast("bigint").alias("place"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 30 + 1 END AS days, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) END AS last FROM orders""")
def day_spans(spark, sf_dir):
    a = F.to_date("o_orderdate")
    b = F.when(F.col("o_orderkey") % 8 == 0, F.date_add(a, -1)).when(F.col("o_orderkey") % 4 != 0, F.date_add(a, (F.col("o_orderkey") % 30).cast("int")))
    span = repair.day_span(a, b)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.size(span).cast("bigint").alias("days"), F.try_element_at(span, F.lit(-1)).alias("last"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') || '.xlsx' AS file FROM pages""")
def review_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(repair.file_stem(F.col("url")), F.lit(".xlsx")).alias("file"))


@query("""SELECT event_id AS k, event_id % 3 <> 2 AS short, event_id % 3 = 1 OR event_id % 3 = 0 AS long FROM events""")
def time_words(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 2, F.col("event_type")).otherwise(F.date_format("ts", "HH:mm"))
    longer = F.when(F.col("event_id") % 3 == 1, F.date_format("ts", "H:mm:ss")).otherwise(t)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), repair.is_time(t).alias("short"), repair.is_time(longer, True).alias("long"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def profile_dates(spark, sf_dir):
    """A date read by its profile's own rule; profiles without one have none."""
    p = F.element_at(F.array(F.lit("dots"), F.lit("plain"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    said = F.when(p == "dots", F.date_format("o_orderdate", "dd.MM.yyyy")).when(p == "plain", F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("soon"))
    read = statements.by_profile(p, said, {"dots": lambda c: F.replace(c, F.lit("."), F.lit("/")), "plain": lambda c: F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)\z", "$3/$2/$1")})
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.date_cell(read, TODAY)["date"].alias("day"))


# Review workbooks


@query(f"""WITH {CHAIN}, bk AS (SELECT stmt_id // 100 AS book, * FROM c),
tx AS (SELECT book, 'Transactions' AS sheet, count(*) + 1 AS rows, CAST(COALESCE(sum(amount), 0) AS BIGINT) AS total FROM bk GROUP BY book),
dy AS (SELECT book, 'Daily' AS sheet, count(*) + 1 AS rows, CAST(sum(n) AS BIGINT) AS total FROM (SELECT book, day, count(*) AS n FROM bk GROUP BY ALL) GROUP BY book)
SELECT * FROM tx UNION ALL SELECT * FROM dy UNION ALL SELECT book, 'Proof', 3, count(*) FROM bk GROUP BY book""")
def review_workbooks(spark, sf_dir):
    """A workbook of three sheets for each hundred accounts - transactions, days, proof - written, read again and counted."""
    from ..sinks.workbooks import review_files
    from ..sources.tables import made_cells

    d = proved(spark, sf_dir).select(F.floor(F.col("stmt_id") / 100).alias("book"), "stmt_id", "seq", F.date_format("day", "yyyy-MM-dd").alias("day"), "amount", "verified")
    refused = F.raise_error(F.concat_ws(": ", "file", "error")).cast("boolean")
    found = made_cells(review_files(d, "book", ["stmt_id", "seq"])).where(F.when(F.col("error").isNotNull(), refused).otherwise(True))
    last = {"Transactions": 3, "Daily": 1, "Proof": 1}
    figure = F.coalesce(*[F.when((F.col("sheet") == s) & (F.col("col") == c), F.col("n")) for s, c in last.items()])
    counted = found.groupBy("file", "sheet").agg((F.max("row") + 1).cast("long").alias("rows"), F.coalesce(F.sum(figure).cast("long"), F.lit(0)).alias("total"))
    return counted.select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("book"), "sheet", "rows", "total")
