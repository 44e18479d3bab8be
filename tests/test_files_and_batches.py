"""Sources, sink, batches, days, layout, streams: small cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import batch, daily, layout
from tallyspark.sinks import workbooks
from tallyspark.sources import tables


def files(spark, *named):
    return spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in named], "path string, length bigint, content binary")


def grid(d, name):
    return {(r.row, r.col): r.s if r.s is not None else r.n for r in d.where(F.col("file") == name).collect()}


def test_table_files(spark):
    book = workbooks.workbook({"a": [["k", "v"], ["x <&>", 1.5], [None, 7]], "b": [["z"]]})
    d = tables.cells(
        files(
            spark, ("a.csv", 'd;"a;b";c\r\n1;"say ""hi""\nthere";3\n'.encode()), ("t.csv", "ก,ข\n".encode("cp874")), ("h.xls", b"<table><tr><td>A&amp;B<br>c</td><td> 1 </td></tr></table>"),
            ("w.xlsx", book), ("bad.xlsx", b"nothing"), ("old.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest"), ("pic.png", b"x"), ("empty.csv", b""),
        )
    ).persist()
    assert grid(d, "a.csv") == {(0, 0): "d", (0, 1): "a;b", (0, 2): "c", (1, 0): "1", (1, 1): 'say "hi"\nthere', (1, 2): "3"}
    assert grid(d, "t.csv") == {(0, 0): "ก", (0, 1): "ข"}
    assert grid(d, "h.xls") == {(0, 0): "A&B c", (0, 1): "1"}
    assert grid(d.where("sheet = 'a'"), "w.xlsx") == {(0, 0): "k", (0, 1): "v", (1, 0): "x <&>", (1, 1): 1.5, (2, 1): 7.0}
    assert {r.file for r in d.where("error is not null").collect()} == {"bad.xlsx", "old.xls", "pic.png"}
    assert workbooks.workbook({"a": [["k"]]}) == workbooks.workbook({"a": [["k"]]})


def test_limits(spark):
    small = tables.Limits(file_bytes=10, rows=2)
    d = tables.cells(files(spark, ("big.csv", b"x" * 11), ("long.csv", b"1\n2\n3\n4")), small)
    assert {(r.file, r.error) for r in d.collect()} == {("big.csv", "too large"), ("long.csv", "too many rows or columns")}


def test_a_file_that_a_job_makes_is_made_once(spark):
    """A second look for files that are too large made every workbook again."""
    made = spark.sparkContext.accumulator(0)

    def one(key, group):
        made.add(1)
        return group

    d = files(spark, ("big.csv", b"x" * 11), ("short.csv", b"1\n2"))
    d = tables.made_cells(d.groupBy("path").applyInPandas(one, d.schema), tables.Limits(file_bytes=10))
    assert {(r.file, r.row, r.s, r.error) for r in d.collect()} == {("big.csv", None, None, "too large"), ("short.csv", 0, "1", None), ("short.csv", 1, "2", None)}
    assert made.value == 2


def test_review_workbooks_reads_the_orders_once(spark, tmp_path):
    from tallyspark.plans import statements as plans

    spark.sql("select 5L as o_orderkey, 3L as o_custkey, 'F' as o_orderstatus, 9.5D as o_totalprice, timestamp '1995-01-02' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    d = plans.review_workbooks(spark, str(tmp_path))
    assert d._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(d.collect()) == [(0, "Daily", 2, 1), (0, "Proof", 3, 1), (0, "Transactions", 2, 950)]


def statements(spark, *rows):
    kind = "account string, name string, period_from string, period_to string, opening long, closing long"
    return spark.createDataFrame(list(rows), kind).withColumn("period_from", F.to_date("period_from")).withColumn("period_to", F.to_date("period_to"))


def states(d):
    return {r.name: r.state for r in batch.batch_links(d).collect()}


def test_batches(spark):
    jul, aug = ("a", "1", "2026-07-01", "2026-07-31", 100, 200), ("a", "2", "2026-08-01", "2026-08-31", 200, 300)
    assert states(statements(spark, jul, aug)) == {"1": "first", "2": "linked"}
    assert states(statements(spark, jul, ("a", "1b", *jul[2:]), aug)) == {"1": "first", "1b": "overlap", "2": "linked"}
    assert states(statements(spark, jul, ("a", "2", *aug[2:4], 250, 300))) == {"1": "first", "2": "broken"}
    (gap,) = batch.batch_links(statements(spark, jul, ("a", "3", "2026-09-01", "2026-09-30", 200, 1))).where("state = 'gap'").collect()
    assert (gap.gap_from, gap.gap_to) == (date(2026, 8, 1), date(2026, 8, 31))
    unread = statements(spark, jul, ("a", "x", None, None, 1, 2))
    assert set(states(unread).values()) == {"unreadable"} and not batch.batch_checks(batch.batch_links(unread)).collect()[0].ok


def test_days(spark):
    rows = spark.createDataFrame([(1, 1, "2026-06-09", 1000000, None, 2123456, True), (1, 2, "2026-06-12", None, 6543, 2129999, True), (1, 3, "2026-06-20", None, 1, None, False)], "stmt_id long, seq long, day string, withdrawal long, deposit long, balance long, verified boolean")
    days = daily.daily(rows.withColumn("day", F.to_date("day")))
    accounts = spark.sql("select 1L as stmt_id, 3123456L as opening, date '2026-06-08' as period_from, date '2026-06-14' as period_to")
    got = daily.densify(days, accounts).orderBy("outside", "day").collect()
    assert [r.balance for r in got] == [3123456, 2123456, 2123456, 2123456, 2129999, 2129999, 2129999, None]
    assert got[-1].outside and got[-1].flagged == 1 and sum(r.n for r in got) == 3


def test_layout(spark):
    points = spark.createDataFrame([("p", float(v), i) for i, v in enumerate([1, 3, 6, 10, 30, 33])], "k string, v double, i int")
    assert [r.cluster for r in layout.gap_clusters(points, "k", "v", 4.0, "i").orderBy("i").collect()] == [0, 0, 0, 0, 1, 1]
    got = layout.mean_clusters(points, "k", "v", 4.0).orderBy("cluster").collect()
    assert [(r.n, round(r["mean"], 3)) for r in got] == [(3, 3.333), (1, 10.0), (2, 31.5)]
    words = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 30.0, "b"), (90.0, 111.0, "c")], "x0 double, x1 double, w string")
    columns = [("one", 0.0, 20.0, 0), ("two", 20.0, 100.0, 1), ("three", 0.0, 100.0, 2)]
    got = [(r.w, r["column"]) for r in layout.to_columns(words.union(words), columns).collect()]
    assert sorted(got, key=str) == sorted([("a", "one"), ("b", "two"), ("c", None)] * 2, key=str)
    lines = spark.createDataFrame([(1, 1, 0.0, True), (1, 2, 5.0, False), (1, 3, 10.0, True), (1, 4, 30.0, False)], "page int, line int, y double, is_row boolean")
    assert [r.row_line for r in layout.settle_wrapped(lines, 6.0).orderBy("line").collect()] == [1, 1, 3, None]


def test_streams_go_on_from_their_state(spark, tmp_path):
    from tallyspark.streaming.ledger_stream import chain_stream

    kind = "stmt_id long, seq long, amount long, balance long"
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    go = lambda rows: (spark.createDataFrame(rows, kind).write.mode("append").parquet(source), chain_stream(spark.readStream.schema(kind).parquet(source), "t", state))[1]
    go([(1, 1, 10, 10), (1, 2, 4, 6), (2, 1, 5, 5)])
    got = {(r.stmt_id, r.seq, r.batch): r.state for r in go([(1, 3, 1, 7), (1, 2, 9, 9), (2, 2, 1, 9)]).collect()}
    assert {k[:2]: v for k, v in got.items() if k[2] == 0} == {(1, 1): "proved", (1, 2): "proved", (2, 1): "proved"}
    assert {k[:2]: v for k, v in got.items() if k[2] == 1} == {(1, 3): "proved", (1, 2): "late", (2, 2): "broken"}


def test_stream_of_one_large_account_in_any_order(spark, tmp_path):
    """More rows of a key than an Arrow batch holds, shuffled: the chain is proved in order of its rows."""
    from tallyspark.streaming.ledger_stream import chain_stream

    n = 30_000
    rows = spark.range(1, n + 1).selectExpr("1L as stmt_id", "id as seq", "10L as amount", "id * 10 as balance").orderBy(F.xxhash64("seq"))
    rows.repartition(7).write.parquet(str(tmp_path / "in"))
    got = chain_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", str(tmp_path / "state"))
    assert [(r.state, r["count"]) for r in got.groupBy("state").count().collect()] == [("proved", n)]


def test_reader_errors_are_refusals(spark):
    import io
    import zipfile

    def zipped(sheet, **more):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", '<w xmlns:r="r"><sheets><sheet name="s" r:id="1"/><sheet name="t" r:id="2"/></sheets></w>')
            z.writestr("xl/_rels/workbook.xml.rels", '<r><x Id="1" Target="worksheets/a.xml"/><x Id="2" Target="worksheets/b.xml"/></r>')
            z.writestr("xl/sharedStrings.xml", "<sst><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
            z.writestr("xl/worksheets/a.xml", sheet)
            z.writestr("xl/worksheets/b.xml", '<s><row><c t="b"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row></s>')
        return data.getvalue()

    good = zipped('<s><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><v>2.5</v></c></row></s>')
    broken = bytearray(good)
    broken[good.index(b"xl/worksheets/a.xml") + 25 :][:0] = b""
    at = good.index(b"xl/worksheets/a.xml") + len(b"xl/worksheets/a.xml")
    broken[at : at + 12] = b"\xff" * 12
    locked = bytearray(good)
    for k in range(len(locked) - 4):
        if locked[k : k + 4] == b"PK\x01\x02":
            locked[k + 8] |= 1
    bomb = zipped('<!DOCTYPE x [<!ENTITY a "b">]><s/>')
    wide = ("k\n" + "v" * 200_000 + "\n").encode()
    d = tables.cells(files(spark, ("good.xlsx", good), ("broken.xlsx", bytes(broken)), ("locked.xlsx", bytes(locked)), ("bomb.xlsx", bomb), ("wide.csv", wide), ("none.xlsx", b"")))
    got = d.collect()
    assert {r.file for r in got if r.error} == {"broken.xlsx", "locked.xlsx", "bomb.xlsx", "none.xlsx"}
    assert {(r.sheet, r.row, r.col): r.s or r.n for r in got if r.file == "good.xlsx"} == {("s", 0, 0): "two", ("s", 0, 2): "one", ("s", 1, 1): 2.5, ("t", 0, 0): "TRUE", ("t", 0, 1): "x"}
    assert {len(r.s) for r in got if r.file == "wide.csv"} == {1, 200_000}
    over = tables.cells(files(spark, ("good.xlsx", good)), tables.Limits(rows=2)).collect()
    assert [r.error for r in over] == ["too many rows or columns"]


def test_refusals_are_told(spark):
    import io
    import zipfile

    from tallyspark.plans.queries import read_back

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets>" + '<sheet name="s"/>' * 51 + "</sheets></workbook>")
    with pytest.raises(tables.Refused, match="too many sheets"):
        tables.workbook(data.getvalue())
    files = spark.createDataFrame([("a.csv", 9, b"k;n;b\n1;x;2"), ("b.xlsx", 9, data.getvalue())], "path string, length long, content binary")
    assert [tuple(r) for r in read_back(files.where("path = 'a.csv'")).collect()] == [("a.csv", "1", "x", "2")]
    with pytest.raises(Exception, match="too many sheets"):
        read_back(files).collect()
