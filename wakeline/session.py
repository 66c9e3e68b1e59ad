"""Session settings and the shared folder for staged intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# One fallback folder per driver process, used on a local master only.
_local_fallback: str | None = None


# Adaptive execution sizes the shuffles, splits skewed joins and picks broadcast joins from the sizes it has measured.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Folding sequences costs far more per byte than reading, so even small partitions deserve a task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# What may be broadcast; left alone where the session has a limit of its own.
BROADCAST_LIMIT = "spark.sql.autoBroadcastJoinThreshold"
BROADCASTS = {
    # A broadcast table is gathered and hashed in the driver's heap, at several times its size, and joins broadcast at once.
    BROADCAST_LIMIT: "8m",
    # Column files hold far more rows than bytes tell (a key counted up, one path in all rows): only a tiny file is known
    # to hold a small table. Others are broadcast if their rows, measured in a shuffle, prove to be few.
    "spark.sql.sources.fileCompressionFactor": "256",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every job here relies on.

    All times are UTC, whatever the session says. The rest are defaults: what the session already sets stays.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    given = spark.conf.getAll
    for key, value in (DEFAULTS if BROADCAST_LIMIT in given else DEFAULTS | BROADCASTS).items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder is made, but only on a local master; on a cluster a folder
    of one machine would lose data, so this raises instead.
    """
    global _local_fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_fallback is None:
        _local_fallback = tempfile.mkdtemp(prefix="wakeline-")
    return _local_fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application so that it can be expired."""
    return os.path.join(shared_folder(spark), spark.conf.get("spark.app.id"), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later branches: the work is done once, the lineage is cut, and a
    lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
