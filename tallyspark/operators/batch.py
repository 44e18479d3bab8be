"""Many statements of one account: overlaps, gaps, and closings that are the next opening.

The comparison is a fold - a statement that overlaps is left out and the one before stays the
reference - so it is an ``aggregate`` over an account's statements in order.  An account has few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def account_key(profile: str = "profile", account: str = "account", name: str = "name"):
    """Statements of an unread account aren't merged with others."""
    return F.concat_ws("|", F.col(profile), F.coalesce(F.nullif(F.col(account), F.lit("")), F.concat(F.lit("? "), F.col(name))))


def batch_links(statements: DataFrame) -> DataFrame:
    """``account, name, state, gap_from, gap_to`` per statement, states: first, overlap, gap, linked, broken, unreadable.

    Statements: ``account, name, period_from, period_to, opening, closing``.
    """
    kind = "struct<name:string,state:string,gap_from:date,gap_to:date>"
    order = F.struct(F.coalesce("period_from", F.lit("9999-12-31").cast("date")).alias("at"), "name", "period_from", "period_to", "opening", "closing")
    grouped = statements.groupBy("account").agg(F.sort_array(F.collect_list(order)).alias("s"))
    unread = F.exists("s", lambda x: x["period_from"].isNull() | x["period_to"].isNull())
    start = F.struct(F.lit(None).cast("date").alias("to"), F.lit(None).cast("bigint").alias("closing"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc, x):
        follows = F.date_add(acc["to"], 1)
        state = F.when(acc["to"].isNull(), "first").when(x["period_from"] <= acc["to"], "overlap").when(x["period_from"] != follows, "gap").when(acc["closing"].eqNullSafe(x["opening"]), "linked").otherwise("broken")
        gap = state == "gap"
        entry = F.struct(x["name"].alias("name"), state.alias("state"), F.when(gap, follows).alias("gap_from"), F.when(gap, F.date_sub(x["period_from"], 1)).alias("gap_to"))
        stays = state == "overlap"
        return F.struct(
            F.when(stays, acc["to"]).otherwise(x["period_to"]).alias("to"), F.when(stays, acc["closing"]).otherwise(x["closing"]).alias("closing"),
            F.concat(acc["out"], F.array(entry.cast(kind))).alias("out"),
        )

    folded = F.aggregate("s", start, step, lambda acc: acc["out"])
    refused = F.transform("s", lambda x: F.struct(x["name"].alias("name"), F.lit("unreadable").alias("state"), F.lit(None).cast("date").alias("gap_from"), F.lit(None).cast("date").alias("gap_to")))
    return grouped.select("account", F.inline(F.when(unread, refused.cast(f"array<{kind}>")).otherwise(folded)))


def batch_checks(links: DataFrame) -> DataFrame:
    """Per account: how many statements, links that agree, gaps, overlaps and broken links, and whether all is well."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return links.groupBy("account").agg(
        F.count(F.lit(1)).alias("statements"), n("linked").alias("agreeing"), n("gap").alias("gaps"), n("overlap").alias("overlaps"), n("broken").alias("broken"), n("unreadable").alias("unreadable")
    ).withColumn("ok", (F.col("gaps") + F.col("overlaps") + F.col("broken") + F.col("unreadable")) == 0)


def lifted(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Yellow statements whose closing the next one's opening confirms turn green; left-out ones are told.

    The next statement is the next by period that isn't left out.  Statuses: ``account, name, period_from, status``.
    """
    from pyspark.sql.window import Window as W

    d = links.join(statuses, ["account", "name"])
    start = F.coalesce("period_from", F.lit("9999-12-31").cast("date"))
    out = F.col("state") == "overlap"
    following = F.lead("state").over(W.partitionBy("account", out).orderBy(start, "name"))
    d = d.withColumn("next_state", F.when(~out, following))
    return d.select("account", "name", "state", (F.col("state") == "overlap").alias("left_out"), F.when((F.col("status") == "yellow") & (F.col("next_state") == "linked"), "green").otherwise(F.col("status")).alias("status"))
