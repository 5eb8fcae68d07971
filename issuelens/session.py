"""Session settings and the scratch folder used for tables written between jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_BLOCK = 128 << 20
LOCAL_MEMORY = "8g"


def build_session(
    app_name: str = "issuelens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    largest_shuffle_bytes: int | None = None,
) -> SparkSession:
    """A session with the settings the jobs here are written for.

    On a cluster leave ``master`` unset and give the size of the largest shuffle, about
    the size of the text for a de-duplication: shuffles then start with blocks of 128 MB
    and adaptive execution merges them where there is less data.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        # One local process does everything; the default heap of 1 GB is too small for it.
        builder = builder.config("spark.driver.memory", LOCAL_MEMORY)
    if largest_shuffle_bytes is not None:
        blocks = max(1, -(-largest_shuffle_bytes // SHUFFLE_BLOCK))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(blocks)).config(
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLE_BLOCK)
        )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only on ``local[*]``.

    A machine-local folder is refused on a real cluster, since executors on other
    machines could not read it back.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="issuelens-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below :func:`scratch_root`."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df, name: str = "stage"):
    """Write ``df`` to the scratch folder as Parquet and read it back.

    Cuts lineage at a point several later jobs start from, so an expensive
    upstream (text cleaning, scoring) runs once and a lost executor re-reads files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
