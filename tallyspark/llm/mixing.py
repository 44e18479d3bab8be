"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, DataFrame functions only.

Targets: each source's share of ``share`` times all words goes by its weight, no
source above ``most`` times its own size; the excess is shared again by weight
(water filling, solved in closed form over the sources sorted by cap / weight).

Quotas: the mix consists of blocks of ``block`` words.  Blocks go to sources by
highest quotients target / (2 k + 1) and a source's blocks to its shards the same
way by their sizes.  Only seats near the cut are ranked: a divisor slightly above
the mean gives the seats that are certain, one slightly below gives the last that
can count, so the number of ranked quotients is some twice the number of parties,
whatever the number of blocks.

Selection: a shard's documents stand in a seeded order on a ring of words; its
quota is whole rounds of the ring and then a run of blocks from a seeded start.  A
document is taken as often as its words are covered.  A shard holds about
``shard_docs`` documents, so no window spans a large source; the quotients of a source's
shards are ranked over ranges of a sort, not in one window.  A shard's quota lies within half a
block of its share, so where a source is just below its cap a shard may lose up to half a block to its own cap.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; a null id takes part, and rows without id are dealt to shards by their place in the files.  Empty texts and sources of size 0 take nothing.
Long texts: only their sizes
go on.  Ties in quotients: the source earlier in order, the smaller shard.  Repeated rows:
each is a document of its own with its own place (rows that are alike in id and
size may exchange theirs).  Empty tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORDS, free_name, keep, text_or_empty


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size: number of words between ASCII white space; and the columns of ``carry``."""
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORDS)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), *carry)


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n -> with ``place`` (0, 1, ... by code point, null last), ``weight`` and ``target``.

    The windows here span the sources, one row each.
    """
    named = sources.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = named.withColumn("weight", F.get(cycle, F.col("place") % len(weights))).withColumn("cap", most * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "place")
    all_rows = W.partitionBy()
    leveled = (
        weighed.withColumn("total", share * F.sum("source_size").over(all_rows))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))
    level = F.min(fits).over(all_rows)["level"]
    # Without a source below its cap, all are at it.
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return leveled.select("source", "place", "source_size", "n", "weight", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], order: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds ``quota`` to each party; ``seats`` (a column) are dealt within each group.

    The seats that two divisors around votes / seats settle aren't ranked; the others are, by
    quotient and then ``order``.  A group may hold any number of parties: none is gathered in one task.
    """
    sums = parties.groupBy(*within).agg(F.sum(votes).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    d = parties.join(sums, within)
    slack = F.col("_n") / 2 + 1
    high = F.when(F.col(seats) > slack, F.col("_sum") / (F.col(seats) - slack))
    low = F.col("_sum") / (F.col(seats) + slack)
    of = lambda divisor: F.floor(F.col(votes) / divisor + 0.5)
    d = d.withColumn("_sure", F.when((F.col(seats) > slack) & (F.col(votes) > 0), of(high)).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("_last", F.when((F.col(seats) > 0) & (F.col(votes) > 0), of(low)).otherwise(F.lit(0).cast("long")))
    open_seats = d.groupBy(*within).agg(F.first(seats).alias("_seats"), F.sum("_sure").alias("_all")).select(*within, (F.col("_seats") - F.col("_all")).alias("_left"))
    quotients = d.where("_last > _sure").select(*within, order, votes, F.explode(F.sequence(F.col("_sure"), F.col("_last") - 1)).alias("_k"))
    quotients = quotients.withColumn("_q", -F.col(votes) / (2 * F.col("_k") + 1))
    won = ranked(quotients, within, ["_q", order, "_k"]).join(open_seats, within).where("_rank <= _left").groupBy(*within, order).agg(F.count(F.lit(1)).alias("_won"))
    return d.join(won, [*within, order], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sum", "_n", "_sure", "_last", "_won")


def ranked(rows: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """Adds ``_rank`` (from 1) in each group by columns that tell its rows apart: a sort dealt by ranges, whose lengths are added up."""
    dealt = keep(rows.repartitionByRange(*within, *by).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    lengths = dealt.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_length"))
    before = F.sum("_length").over(W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    lengths = lengths.select(*within, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = W.partitionBy(*within, "_range").orderBy(*by)
    return dealt.join(lengths, [*within, "_range"]).withColumn("_rank", F.col("_before") + F.row_number().over(own))


def _unit(seed: int, salt: str, *columns: str):
    """32 bits of a digest of the columns, the same in any engine."""
    text = F.concat_ws("|", F.lit(f"{seed}{salt}"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 16,
    shard_docs: int = 128,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, and ``source``, ``shard``.

    ``carry``: columns of ``docs`` to return too, such as one that tells rows of one id apart; they come last in a shard's order.
    """
    row = free_name(docs, "_row")
    slim = keep(sized(docs, id_col, text_col, source_col, carry).withColumn(row, F.monotonically_increasing_id()), "mix-sizes")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    seats = F.round(F.col("target") / block)
    goals = targets(per_source, weights, share, most).withColumn("group", F.lit(0))
    goals = goals.withColumn("all_blocks", F.round(F.sum("target").over(W.partitionBy("group")) / block).cast("long"))
    goals = keep(
        apportion(goals, ["group"], "place", "target", "all_blocks").select(
            "source", "place", "source_size", "target", F.col("quota").alias("blocks"), F.ceil(F.col("n") / shard_docs).alias("shards")
        ), "mix-goals",
    )
    dealt = F.when(F.col("doc_id").isNull(), _unit(seed, "shard", row, "size")).otherwise(_unit(seed, "shard", "doc_id", "size"))
    placed = slim.join(goals, slim["source"].eqNullSafe(goals["source"])).select(
        "doc_id", slim["source"], "size", "place", "source_size", "target", "blocks", (dealt % F.col("shards")).alias("shard"), row, *carry
    )
    placed = keep(placed, "mix-placed")
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = keep(apportion(shards, ["place"], "shard", "shard_size", "blocks").select("place", "shard", "shard_size", "quota"), "mix-quotas")
    ring = W.partitionBy("place", "shard")
    seated = placed.join(quotas, ["place", "shard"]).withColumn("order", _unit(seed, "order", "doc_id"))
    end = F.sum("size").over(ring.orderBy("order", "doc_id", "size", *carry, row).rowsBetween(W.unboundedPreceding, 0))
    cap = (most * F.col("shard_size")).cast("long")
    # A source that takes all it may takes that of each shard, so no seat over a shard's cap is lost.
    wanted = F.when(F.col("target") >= most * F.col("source_size"), cap).otherwise(F.least(F.col("quota") * block, cap))
    one = F.greatest("shard_size", F.lit(1))
    seated = seated.select(
        "doc_id", "source", "size", "source_size", "target", "shard", end.alias("end"), "shard_size",
        F.floor(wanted / one).alias("rounds"), (wanted % one).alias("rest"),
        ((_unit(seed, "start", "place", "shard") % F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))) * block).alias("start"), *carry,
    )

    def covered(low, high):
        return F.greatest(F.lit(0), F.least(F.col("end"), high) - F.greatest(F.col("end") - F.col("size"), low))

    stop = F.col("start") + F.col("rest")
    run = covered(F.col("start"), F.least(stop, F.col("shard_size"))) + covered(F.lit(0), stop - F.col("shard_size"))
    taken = F.col("rounds") * F.col("size") + run
    return seated.select(F.col("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", *carry)
