"""Session helpers: time zone, checkpoint folder and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "vacantia") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; local mode without one gets a temporary folder."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # executors of local-cluster are processes of their own
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="vacantia-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back. Each row is computed once, later
    readers take only the columns they need, and lost executors cost a re-read instead of a recomputation."""
    path = work_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than the cluster has slots, shuffled by key so that costly row work uses them
    all; a scan that already has enough splits stays as it is. The number of partitions is the session's, so a join on the key needs no second shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if df.rdd.getNumPartitions() < slots else df


def hold_filters(df: DataFrame) -> DataFrame:
    """Keep later filters on computed columns above their computation, by an observed row count.

    Pushed below, such a filter would repeat the computation, here dozens of text searches, and outgrow
    generated code. Columns nobody reads are still pruned down to the scan.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))
