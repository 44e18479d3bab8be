"""Exact dedup: stateful streaming deduplication over digests, with full bytes checked on hits.

Rows enter a Structured Streaming aggregation keyed by the SHA-256 of the
normalised text.  Its state lives on disk (RocksDB), has no watermark and so
never expires, and keeps for each digest the stable identifier (smallest id),
that row's content locator and the row count.  The aggregation combines rows of
a key before the shuffle, so a digest that holds a third of all rows costs each
task one row.  A later run with the same ``state_dir`` goes on from that state.

On a hit (a digest with more than one row) the full normalised bytes of each
member are compared with those of the row that stays, which are read at its locator
where it came in an earlier run; members that differ (a digest collision) are grouped
again by their full text, with the earlier rows of the digest.  Keepers of large groups
are sent to each of several salted parts, so no task takes a whole group.

Nulls: a null text counts as empty; all empty texts are equal to one another.
A row with a null id takes part, and never stays while a row of the same text has
an id.  Repeated rows (same id and text): the copies count in ``group_size``; one
row of them stays, each output row carries ``kept`` by that rule.  Long texts: only
digests and locators are kept in the state; texts are shuffled on hits alone.  Empty
tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, keep, scratch, text_or_empty

#: Members of a group that are compared with one copy of the keeper's text.
PART = 64


def normalise(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def located(docs: DataFrame, name: str = "locator") -> DataFrame:
    """``docs`` with ``name``: file and row of its content; what isn't read from files is written to some first."""
    at = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index")).alias(name)
    try:
        return docs.select("*", at)
    except AnalysisException:
        return keep(docs, "dedup-content").select("*", at)


#: The stream's own settings: a store is closed after its task and its local files go; what lasts is in the shared folder.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the stream's settings, so that other queries of ``spark`` don't see them."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    for key, value in STREAM.items():
        own.conf.set(key, value)
    return own


def update_state(
    spark: SparkSession, slim_path: str, schema, state_dir: str, bytes_per_trigger: int = 64 << 30
) -> DataFrame:
    """Run what is new in ``slim_path`` (doc_id, digest, locator) through the keyed state; return all digests' entries.

    The changed entries of each micro-batch are written under its number, so a
    batch that is repeated after a failure replaces its own output.
    """
    rows = _stream_session(spark).readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(slim_path)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")
    entries = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.locator").alias("first_at"), "n").write.mode("overwrite").parquet(f"{state_dir}/entries/batch={number}")

    query = (
        entries.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(write).start()
    )
    query.awaitTermination()
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    entry = f"digest string, first_id {kinds['doc_id']}, first_at {kinds['locator']}, n long, batch int"
    found = spark.read.schema(entry).parquet(f"{state_dir}/entries") if _any(spark, f"{state_dir}/entries") else spark.createDataFrame([], entry)
    if not _any(spark, f"{state_dir}/entries/batch=1"):
        return found.drop("batch")
    return found.groupBy("digest").agg(F.max(F.struct("batch", "first_id", "first_at", "n")).alias("e")).select("digest", "e.first_id", "e.first_at", "e.n")


def _any(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    state_dir: str | None = None,
    digest_bits: int = 256,
    locator_col: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, locator``.

    ``state_dir``: a shared folder with the state of earlier runs; by default a
    new one.  With earlier state, ``keep_id`` and ``group_size`` also count rows
    seen before; the files of earlier runs must still be there.
    ``digest_bits``: digest length of the key; tests shorten it to force collisions.
    ``locator_col``: the locators of rows that ``located`` has been called on already.
    """
    spark = docs.sparkSession
    state_dir = state_dir or scratch(spark, "dedup-state")
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    rows = docs.select(*own, F.col(locator_col).alias("locator")) if locator_col else located(docs.select(*own))
    rows = rows.withColumn("text", normalise("text"))
    hashed = rows.withColumn("sha", F.sha2("text", 256)).select("doc_id", "sha", F.substring("sha", 1, digest_bits // 4).alias("digest"), "locator")
    slim_path = f"{state_dir}/slim"
    earlier = spark.read.schema(hashed.schema).parquet(slim_path) if _any(spark, slim_path) else None
    if earlier is not None:
        earlier = keep(earlier, "dedup-earlier")
        slim = keep(hashed, "dedup-slim")
        slim.write.mode("append").parquet(slim_path)
    else:
        hashed.write.parquet(slim_path)
        slim = spark.read.schema(hashed.schema).parquet(slim_path)
    entries = update_state(spark, slim_path, slim.schema, state_dir)
    members = slim.join(entries, "digest", "left")
    texts = rows.select("text", "locator")
    if earlier is not None:
        firsts = members.where("n > 1").select(F.col("first_at").alias("locator")).distinct()
        before = firsts.join(earlier, "locator", "left_semi")
        texts = texts.unionByName(texts_at(spark, before, text_col))
    differing = _differing(texts, members, entries)
    out = members.select(
        "doc_id", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("locator") == F.col("first_at")).alias("kept"), F.col("sha").alias("text_sha256"), "locator", "digest",
    )
    if differing is None:
        return out.drop("digest")
    split = differing.select("digest").distinct()
    fresh = slim.join(split, "digest", "left_semi").withColumn("_new", F.lit(True))
    texts = rows.select("text", "locator")
    if earlier is not None:
        old = keep(earlier.join(split, "digest", "left_semi"), "dedup-again")
        texts = texts.unionByName(texts_at(spark, old.select("locator"), text_col))
        fresh = fresh.unionByName(old.withColumn("_new", F.lit(False)))
    return out.join(split, "digest", "left_anti").drop("digest").unionByName(_by_full_text(texts, fresh))


def texts_at(spark: SparkSession, wanted: DataFrame, text_col: str) -> DataFrame:
    """The normalised texts at some locators, read from the files they name (whose names alone come to the driver)."""
    wanted = keep(wanted.select("locator"), "dedup-wanted")
    files = [r["f"] for r in wanted.select(F.substring_index("locator", "#", 1).alias("f")).distinct().collect()]
    if not files:
        return wanted.select(F.lit("").alias("text"), "locator")
    return located(spark.read.parquet(*files).select(F.col(text_col).alias("text"))).select(normalise("text").alias("text"), "locator").join(wanted, "locator", "left_semi")


def _differing(texts: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame | None:
    """Members whose full bytes differ from those of the row that stays; None if there are none, as nearly always."""
    hits = members.where("n > 1").select("doc_id", "locator", "digest", "first_at", "n")
    parts = F.ceil(F.col("n") / PART).cast("int")
    checked = hits.where(F.col("locator") != F.col("first_at")).select(
        "digest", "locator", F.pmod(F.xxhash64("locator"), parts).cast("int").alias("part")
    ).join(texts, "locator").select("digest", "part", F.col("text").alias("own"))
    keepers = entries.where("n > 1").select("digest", F.col("first_at").alias("locator"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    kept = keepers.join(texts, "locator").select("digest", "part", F.col("text").alias("stays"))
    differing = keep(checked.join(kept, ["digest", "part"]).where(~F.col("own").eqNullSafe(F.col("stays"))).select("digest"), "dedup-differing")
    return None if differing.isEmpty() else differing


def _by_full_text(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the colliding digests, grouped by the full normalised text; those of earlier runs count and aren't returned."""
    own = members.join(texts, "locator")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")
    groups = own.groupBy("text").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return own.join(groups, "text").where("_new").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("first.locator")).alias("kept"), F.col("sha").alias("text_sha256"), "locator"
    )
