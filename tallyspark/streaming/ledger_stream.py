"""Ledgers as streams: daily windows with late rows, and the balance chain.

State is in the shared folder's checkpoint (that of windows in RocksDB); sinks write each micro-batch under its
number, so a repeated batch replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..scratch import scratch

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def run(spark: SparkSession, stream: DataFrame, mode: str, label: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that its source has now; return what it wrote."""
    where = checkpoint or scratch(spark, label)
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    try:
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{where}/out")


def daily_windows(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Tumbling days per account: rows and sum; rows later than ``delay`` are too late for their day."""
    return (
        events.withWatermark("ts", delay).groupBy("stmt_id", F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select("stmt_id", F.to_date("w.start").alias("day"), "n", "cents")
    )


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """Of a stream's changes in update mode, the last of each key."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("v")).select(*keys, *[f"v.{c}" for c in values])


def chain_stream(rows: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run a stream of rows, each proved against its account's last balance; rows behind it in order are flagged, not dropped.

    Rows: ``stmt_id, seq, amount, balance``.  Output adds ``state``: proved, broken, late, or open (no balance
    printed).  Within a micro-batch the proof is a window over sorted rows; between micro-batches only each
    account's last place and balance last, written under the micro-batch's number.  ``folder`` continues an earlier run.
    """
    spark = rows.sparkSession
    where = folder or scratch(spark, label)
    last_kind = "stmt_id long, last_seq long, last_balance long, batch int"

    def prove(batch: DataFrame, number: int) -> None:
        own = W.partitionBy("stmt_id").orderBy("seq", "_again")
        known = batch.sparkSession.read.schema(last_kind).parquet(f"{where}/last") if number else batch.sparkSession.createDataFrame([], last_kind)
        before = known.where(F.col("batch") < number).groupBy("stmt_id").agg(F.max_by(F.struct("last_seq", "last_balance"), "batch").alias("l")).select("stmt_id", "l.*")
        again = F.row_number().over(W.partitionBy("stmt_id", "seq").orderBy("amount", "balance")) > 1
        d = batch.withColumn("_again", again).join(before, "stmt_id", "left")
        d = d.withColumn("_late", F.col("_again") | F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False)))
        carried = F.last(F.when(~F.col("_late"), F.col("balance")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
        running = F.coalesce(carried, "last_balance", F.lit(0))
        state = F.when(F.col("_late"), "late").when(F.col("balance").isNull(), "open").when(F.abs(F.col("balance") - running) == F.col("amount"), "proved").otherwise("broken")
        told = d.withColumn("state", state)
        told.select("stmt_id", "seq", "amount", "balance", "state").write.mode("overwrite").parquet(f"{where}/out/batch={number}")
        fresh = told.where(~F.col("_late")).groupBy("stmt_id").agg(
            F.max("seq").alias("last_seq"), F.coalesce(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq"))), F.first("last_balance")).alias("last_balance")
        )
        fresh.write.mode("overwrite").parquet(f"{where}/last/batch={number}")

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(prove).start().awaitTermination()
    return spark.read.schema("stmt_id long, seq long, amount long, balance long, state string, batch int").parquet(f"{where}/out")
