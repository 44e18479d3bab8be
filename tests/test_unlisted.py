"""Layouts without a profile on pages made by hand: every refusal, ties, times, two-line headings, wraps."""

import datetime

from tallyspark.operators import extract, layout, unlisted

KIND = "doc string, page int, word int, x0 double, y0 double, x1 double, y1 double, y double, text string"


def frame(spark, pages):
    """``pages``: (doc, page, [(x0, x1, y, text)])."""
    rows = [(doc, page, i, float(x0), y - 4.0, float(x1), y + 4.0, float(y), text) for doc, page, words in pages for i, (x0, x1, y, text) in enumerate(words)]
    return spark.createDataFrame(rows, KIND)


HEAD = [(10, 40, 50, "วันที่"), (200, 230, 50, "Amount"), (300, 340, 58, "ยอดคงเหลือ"), (60, 90, 66, "B/F"), (300, 340, 66, "900.00")]


def line(y, day, amount=None, balance=None, said="shop", time=None):
    out = [(10, 48, y, day), (80, 110, y, said)]
    out += [(200, 230, y, amount)] if amount else []
    out += [(300, 340, y, balance)] if balance else []
    return out + ([(52, 70, y, time)] if time else [])


def body(n=4, first=900, **kw):
    return [w for i in range(n) for w in line(90 + 20 * i, f"0{i + 1}/06/2026", "10.00", f"{first - 10 * (i + 1)}.00", **kw)]


def layouts(spark, pages):
    found = unlisted.layouts(extract.lines_of(frame(spark, pages))).collect()
    return {r.doc: (r.refusal, {c["name"]: (c["lo"], c["hi"]) for c in r.columns or []}, r.reach, r.period_text) for r in found}


def test_columns_and_refusals(spark):
    no_balance_head = [w for w in HEAD if "คงเหลือ" not in w[3]]
    right = [w for i in range(3) for w in [(10, 48, 90 + 20 * i, "01/06/26"), (200, 230, 90 + 20 * i, "5.00"), (300, 330, 90 + 20 * i, "5.00")][: 2 + (i == 0)]]
    got = layouts(
        spark,
        [
            ("good", 0, HEAD + body(time="09:30")), ("half", 0, HEAD + body(3, time="09:30") + line(150, "09/06/2026", "1.00", "869.00") + line(170, "09/06/2026", "1.00", "868.00") + line(190, "09/06/2026", "1.00", "867.00") + line(210, "09/06/2026", "1.00", "866.00")),
            ("headless", 0, no_balance_head + body()), ("dateless", 0, HEAD + [(80, 100, 90, "x"), (300, 340, 90, "1.00")]), ("thin", 0, HEAD + line(90, "01/06/26", "5.00") + line(110, "02/06/26", None, "5.00")),
            ("lone", 0, HEAD + line(90, "01/06/26", None, "5.00")), ("crossed", 0, HEAD + right), ("overlap", 0, HEAD + [(10, 48, 90, "01/06/26"), (40, 70, 90, "1.00"), (300, 340, 90, "5.00")] + [(49.5, 60, 110, "2.00"), (10, 48, 110, "02/06/26"), (300, 340, 110, "3.00")]),
            ("unopened", 0, [w for w in HEAD if w[3] != "B/F"] + body()), ("empty", 0, [(1, 2, 3, "")]),
        ],
    )
    assert got["good"] == (None, {"date": (9.0, 49.0), "time": (49.0, 71.0), "description": (71.0, 199.5), "amount": (199.5, 265.0), "balance": (265.0, 342.0), "channel": (342.0, 10000.0)}, 30.0, None)
    assert got["half"][0] is None and "time" not in got["half"][1]  # a time on 3 of 7 lines has no column
    assert {k: v[0] for k, v in got.items() if k not in ("good", "half")} == {
        "headless": "no headings", "dateless": "no dates", "thin": "no balance", "lone": "no amounts", "crossed": "no amounts", "overlap": "columns overlap", "unopened": "no opening", "empty": "no headings",
    }


def test_period_is_the_nearest_line_above_the_first_headings(spark):
    above = [(10, 50, 10, "1/1/69"), (60, 90, 10, "31/1/69"), (10, 50, 30, "01/06/2026"), (60, 90, 30, "-"), (95, 130, 30, "30/06/2026"), (10, 50, 40, "01/02/2026")]
    got = layouts(spark, [("a", 0, above + HEAD + body()), ("a", 1, [(10, 50, 20, "05/05/2025"), (60, 99, 20, "06/05/2025")] + HEAD + body(2))])
    assert got["a"][3] == "01/06/2026 - 30/06/2026" and got["a"][2] == 30.0


def test_rows_wraps_and_channel(spark):
    words = HEAD + body(9) + [(80, 120, 98, "more"), (350, 380, 90, "ATM"), (80, 110, 400, "Total")]
    words += line(270, "10/06/2026", said="nothing") + [(80, 110, 278, "lost")]
    got = unlisted.transactions(frame(spark, [("a", 0, words), ("b", 0, HEAD)]), "2026-10-02").orderBy("seq").collect()
    assert [(r.doc, r.seq, r.day, r.description, r.amount, r.balance, r.channel, r.opening) for r in got] == [
        ("a", i + 1, datetime.date(2026, 6, i + 1), "shop more" if i == 0 else "shop", 1000, 90000 - 1000 * (i + 1), "ATM" if i == 0 else None, 90000) for i in range(9)
    ]


def test_mean_clusters_stream_over_batches_and_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, v) for k in ("a", "b", None) for v in (1.0, 1.0, 2.0, 3.4, 9.0, 9.5, None)] + [("dense", i * 0.5) for i in range(400)]
        got = layout.mean_clusters(spark.createDataFrame(rows, "k string, v double"), "k", "v", 2.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in {k for k, _ in rows}:
        expected = []
        for v in sorted(v for k, v in rows if k == key and v is not None):
            if expected and abs(v - sum(expected[-1]) / len(expected[-1])) <= 2.0:
                expected[-1].append(v)
            else:
                expected.append([v])
        mine = sorted((r.cluster, r.n, round(r.mean, 9), r.low, r.high) for r in got if r.k == key)
        assert mine == [(i, len(c), round(sum(c) / len(c), 9), c[0], c[-1]) for i, c in enumerate(expected)]
