"""Where streams and writers keep their files: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the session's ``spark.checkpoint.dir``.

    Only where that is unset (a local session, as in tests) a temporary folder of this machine is
    used, one for each application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="spark-tally-")
        base = _local[app]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what several aggregates read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
