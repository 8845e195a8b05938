"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the runtime work: it joins small shuffle partitions,
# splits skewed join partitions and turns a join into a broadcast only when the
# measured side is below the threshold.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str, app: str = "tidefold", shuffle_partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private folder is used only in local mode; on a cluster executors and
    driver would not see each other's files, so a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidefold-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors, keeps the partitioning."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def store(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a result other jobs read several times as a columnar table and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into the configured number of shuffle partitions.

    Work done per key in Python is heavy for few bytes, and adaptive execution
    would pack such partitions together by size.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
