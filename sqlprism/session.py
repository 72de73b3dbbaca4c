"""Spark session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sqlprism") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the caller's existing session wins: ``getOrCreate`` returns it
    and the master/partition arguments are ignored.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SQLPRISM_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint dir.

    Clusters name a shared folder in ``spark.checkpoint.dir``; that setting always holds. Only a
    session with a local master (tests, bench) gets a fresh folder below the system's temporary one where nothing
    is set; on a cluster that would be a different disk for every executor, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="sqlprism-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df):
    """Compute ``df`` once and cut its lineage: written as Parquet below the session's checkpoint dir and read back. Columnar and
    compressed, unlike ``materialize``, and read by the column, so the choice wherever partitioning need not be kept."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the session's checkpoint
    dir (the cluster's shared folder when configured). Used where one relation feeds many
    branches of a plan, so the branches read it instead of recomputing it. The physical
    partitioning of ``df`` is kept, so key-partitioned consumers still avoid a shuffle."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

