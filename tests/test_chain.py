"""The balance chain and trust: golden cases, and windows against a fold over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import chain, checks, trust

KIND = "stmt_id long, seq long, opening long, amount long, balance long, tax long, x1 double"


def rows(spark, opening, lines, stmt=1):
    """lines: (amount, balance, tax, x1)."""
    return spark.createDataFrame([(stmt, i, opening, a, b, t, x) for i, (a, b, t, x) in enumerate(lines, 1)], KIND)


def prove(spark, opening, lines, split=250.0, **more):
    return chain.verify_chain(rows(spark, opening, lines), split, **more).orderBy("seq").collect()


def test_clean_chain(spark):
    a, b = prove(spark, 3123456, [(1000000, 2123456, None, None), (6543, 2129999, None, None)])
    assert (a.withdrawal, a.deposit, b.withdrawal, b.deposit) == (1000000, None, None, 6543) and a.verified and b.verified


def test_broken_link_is_told_and_the_printed_balance_is_the_next_start(spark):
    a, b = prove(spark, 3123456, [(1000000, 2999999, None, None), (6543, 3006542, None, None)])
    assert a.note == "balance chain broken: 31234.56 -> 29999.99 is a change of -1234.57, but the amount printed is 10000.00" and not a.verified
    assert b.deposit == 6543 and b.verified


def test_no_movement(spark):
    (a,) = prove(spark, 3123456, [(50000, 3123456, None, None)])
    assert (a.withdrawal, a.deposit, a.verified) == (None, None, False) and a.note.startswith("the balance did not change")


def test_the_balance_is_believed_over_the_column(spark):
    (a,) = prove(spark, 3123456, [(500000, 3623456, None, 200.0)])
    assert a.deposit == 500000 and a.verified and a.side_note == "the balance says this is a deposit, but it is printed in the withdrawal column - the balance was believed"
    (b,) = prove(spark, 3123456, [(500000, 3623456, None, 200.0)], deposit_first=True)
    assert b.side_note is None


def test_rows_that_share_a_balance(spark):
    lines = [(432100, None, None, 300.0), (987654, None, None, 200.0), (1100000, None, None, 300.0), (43210, 2512347, None, 200.0), (102, 2512449, None, 300.0)]
    got = prove(spark, 2011111, lines)
    assert all(r.verified for r in got) and [r.deposit is not None for r in got] == [True, False, True, False, True]


def test_rows_that_do_not_add_up_and_rows_after_the_last_balance(spark):
    got = prove(spark, 2011111, [(432100, None, None, 300.0), (43210, 2400000, None, 200.0), (500, None, None, 300.0)])
    assert got[0].note == got[1].note == "these 2 rows share one printed balance, and they do not add up to it: 20111.11 -> 24000.00 is a change of 3888.89, the rows net 3888.90"
    assert got[2].note == chain.NO_BALANCE and not any(r.verified for r in got)


def test_a_group_with_an_unknown_side_is_flagged(spark):
    got = prove(spark, 0, [(100, None, None, 300.0), (50, 150, None, None)])
    assert not got[0].verified and got[0].note.endswith("the rows net 1.00")


def test_tax_becomes_a_row_of_its_own(spark):
    d = chain.verify_chain(rows(spark, 31000, [(1000, 30000, None, None), (3968, 33928, 40, None)]), 560.0)
    got = chain.split_tax(d).orderBy("seq", "part").collect()
    assert [(r.withdrawal, r.deposit, r.balance, r.is_tax) for r in got] == [(1000, None, 30000, False), (None, 3968, 33968, False), (40, None, 33928, True)]


def test_tax_that_was_not_taken(spark):
    d = chain.verify_chain(rows(spark, 31000, [(3968, 34968, 40, None)]), 560.0)
    assert "tax 0.40" in d.collect()[0].note and chain.split_tax(d).count() == 1


def test_zero_lines(spark):
    d = chain.drop_zero_lines(rows(spark, 500, [(0, 500, None, None), (0, 501, None, None), (0, None, None, None), (0, 501, 0, None), (0, 501, 3, None)]))
    assert [r.moves_nothing for r in d.orderBy("seq").collect()] == [True, False, False, True, False]


def test_derived_opening(spark):
    d = rows(spark, None, [(7, None, None, None), (200000, 2611122, None, 300.0)]).withColumn("is_withdrawal", F.lit(False))
    assert chain.derive_opening(d).collect()[0].opening == 2411122


def fold(opening, lines, split=250.0):
    """The rules read row by row."""
    out, running, waiting = [None] * len(lines), opening, []
    for i, (amount, balance, tax, x1) in enumerate(lines):
        if balance is None:
            waiting.append(i)
            continue
        if waiting:
            group = [*waiting, i]
            sides = [lines[k][3] for k in group]
            fine = None not in sides and sum(-lines[k][0] if lines[k][3] < split else lines[k][0] for k in group) == balance - running
            for k in group:
                out[k] = (fine, lines[k][0] if fine and lines[k][3] < split else None, lines[k][0] if fine and lines[k][3] >= split else None)
            waiting = []
        else:
            moved = balance - running + (tax or 0)
            fine = moved != 0 and abs(moved) == amount
            out[i] = (fine, amount if fine and moved < 0 else None, amount if fine and moved > 0 else None)
        running = balance
    for k in waiting:
        out[k] = (False, None, None)
    return out


def test_windows_equal_the_fold_on_random_ledgers(spark):
    r = random.Random(9)
    data, expected = [], {}
    for stmt in range(400):
        opening, balance, lines = r.randint(0, 5), 0, []
        balance = opening
        for _ in range(r.randint(1, 9)):
            amount, out, tax = r.randint(0, 3), r.random() < 0.5, r.choice([None, None, 0, 1])
            balance += (-amount if out else amount) - (tax or 0) + r.choice([0, 0, 0, 0, 1])
            lines.append((amount, r.choice([balance, balance, None]), tax, r.choice([200.0 if out else 300.0] * 4 + [None])))
        data += [(stmt, i, opening, *x) for i, x in enumerate(lines, 1)]
        expected.update({(stmt, i): x for i, x in enumerate(fold(opening, lines), 1)})
    got = chain.verify_chain(spark.createDataFrame(data, KIND), 250.0).collect()
    assert {(g.stmt_id, g.seq): (g.verified, g.withdrawal, g.deposit) for g in got} == expected


TRUST = "stmt_id long, seq long, verified boolean, has_notes boolean, is_tax boolean, page_held boolean, balance long, opening_confirmed boolean, closing_met boolean, per_line boolean"


def trust_rows(spark, good, opening_confirmed=False, closing_met=True, tax=(), per_line=False, balances=None):
    return spark.createDataFrame([(1, i, g, False, i in tax, False, (balances or [9] * 99)[i - 1], opening_confirmed, closing_met, per_line) for i, g in enumerate(good, 1)], TRUST)


@pytest.mark.parametrize(
    ("good", "kwargs", "sent"),
    [
        ([True, False, True, True], {}, [4]),
        ([True, True, True], {}, [2, 3]),
        ([True, True, True], {"opening_confirmed": True}, [1, 2, 3]),
        ([True, True, True], {"closing_met": False}, [2]),
        ([True, True, True, True], {"tax": (3,)}, [2, 3, 4]),
        ([True, False, True, True], {"tax": (3,)}, [4]),
    ],
)
def test_confirmed_rows(spark, good, kwargs, sent):
    got = trust.confirmed_rows(trust_rows(spark, good, **kwargs)).where("confirmed").orderBy("seq").collect()
    assert [r.seq for r in got] == sent


def test_linked_runs_equal_the_fold(spark):
    r = random.Random(4)
    data, expected = [], {}
    for stmt in range(300):
        n, oc, cm = r.randint(1, 6), r.random() < 0.5, r.random() < 0.5
        ok = [r.random() < 0.75 for _ in range(n)]
        balance = [r.choice([0, 1, 2, None]) for _ in range(n)]
        data += [(stmt, i + 1, ok[i], False, False, False, balance[i], oc, cm, False) for i in range(n)]
        linked, run = set(), oc
        for i in range(n):
            run = run and ok[i] and (i == 0 or balance[i - 1] != 0)
            linked |= {i} if run else set()
        run = cm
        for i in reversed(range(n)):
            linked |= {i} if run else set()
            run = run and ok[i] and (i == 0 or balance[i - 1] != 0)
        expected.update({(stmt, i + 1): i in linked for i in range(n)})
    got = trust.linked_rows(spark.createDataFrame(data, TRUST)).collect()
    assert {(g.stmt_id, g.seq): g.linked for g in got} == expected


def test_no_wrong_row_is_confirmed(spark):
    """One figure of a true ledger is changed: no row with a wrong figure is sent."""
    r = random.Random(11)
    data, truth = [], {}
    for stmt in range(200):
        balance, lines = 1000, []
        for _ in range(8):
            amount, out = r.randint(1, 500), r.random() < 0.5
            balance += -amount if out else amount
            lines.append([amount, balance, None, 200.0 if out else 300.0])
        truth.update({(stmt, i): tuple(x) for i, x in enumerate(lines, 1)})
        hit, part = r.randrange(8), r.randrange(2)
        lines[hit][part] += r.choice([-1, 1, 10])
        data += [(stmt, i, 1000, *x) for i, x in enumerate(lines, 1)]
    d = chain.verify_chain(spark.createDataFrame(data, KIND), 250.0).withColumn("has_notes", F.col("note").isNotNull() | F.col("side_note").isNotNull())
    d = d.selectExpr("*", "false as is_tax", "false as page_held", "true as opening_confirmed", "true as closing_met", "false as per_line")
    for g in trust.confirmed_rows(d).where("confirmed").collect():
        assert (g.amount, g.balance) == truth[g.stmt_id, g.seq][:2]


def test_dates(spark):
    d = spark.createDataFrame([(1, 1, "2026-07-24"), (1, 2, "2026-07-20"), (1, 3, "2026-07-29"), (1, 4, None), (1, 5, "2026-07-29")], "stmt_id long, seq long, day string").withColumn("day", F.to_date("day"))
    assert [(r.seq, str(r.above)) for r in trust.dates_backwards(d).collect()] == [(2, "2026-07-24")]
    got = {r.seq: (r.too_early, r.too_late) for r in trust.doubtful_dates(d).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, False), 5: (False, False)}


def test_checks_and_status(spark):
    d = chain.verify_chain(rows(spark, 100, [(10, 90, None, None), (5, 95, None, None)])).selectExpr("*", "date '2026-01-01' as day", "false as is_tax", "false as has_notes")
    facts = spark.createDataFrame([(1, 10, 5, 1, None, 95, False, False)], "stmt_id long, withdraw_total long, deposit_total long, withdraw_count long, deposit_count long, closing_stated long, from_photo boolean, untested boolean")
    got = checks.checks(checks.totals(d), facts).orderBy("ord").collect()
    assert [(r.ord, r.passed) for r in got] == [(1, True), (2, True), (3, True), (4, True), (5, True), (6, True), (13, True)]
    assert got[2].detail == "computed 0.95 vs printed 0.95"
    listed = checks.checks(checks.totals(d), facts)
    assert checks.status(listed, facts).collect()[0].status == "green"
    assert checks.status(listed, facts.withColumn("untested", F.lit(True))).collect()[0].status == "yellow"
    assert checks.status(listed.withColumn("passed", F.lit(False)), facts).collect()[0].status == "red"
