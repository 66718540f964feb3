"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pricelens", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark. On a cluster the submitting job owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PRICELENS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pricelens-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if str(cpus).isdigit():
        builder = builder.config("spark.pricelens.inputPartitions", str(cpus))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """Stand-in for single-machine runs, where no shared folder is named."""
    return tempfile.mkdtemp(prefix="pricelens-")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. One of our own only on a single machine, never on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one."""
    return f"{checkpoint_folder(spark)}/pricelens/{purpose}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table in the shared folder: made once, and each reader reads the columns that it needs."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
