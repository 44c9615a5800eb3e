"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "siftlake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_base(spark: SparkSession) -> str:
    """The folder that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_base(spark))


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, for tables a job writes and reads back."""
    return f"{checkpoint_base(spark).rstrip('/')}/siftlake/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def case_sensitive(spark: SparkSession):
    """Column names that differ only in case are different columns of an artifact table."""
    return _setting(spark, "spark.sql.caseSensitive", "true")


def timestamps_with_ranges(spark: SparkSession):
    """Files keep times in a form that has a least and a greatest one, which scans skip by."""
    return _setting(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def bench_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
