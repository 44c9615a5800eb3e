"""Incremental discovery and processing of packages.

Each micro-batch writes one folder of the ledger, named by its batch id and overwritten when
the batch is repeated, so a restart never adds a row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlake.operators import ledger
from siftlake.session import path_exists
from siftlake.streaming import generations

MINUTE = "1 minute"
MAX_KEYS = 10_000  # a batch up to this size is broadcast to the ledger
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def listing_stream(spark: SparkSession, path: str, source: str, files_per_trigger: int = MAX_KEYS) -> DataFrame:
    """New `*.zip` files below a path; their content is not read."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip")
    return files.option("maxFilesPerTrigger", files_per_trigger).load(path).select(
        F.col("path").alias("package"), F.col("length").alias("size"), F.lit(source).alias("source"))


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table that other jobs add files to, as a stream."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """`every=None` handles what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch folders of a path; no folders yet means no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)


ENTRY = ("package string, row_key string, upload_id string, status string, session string, source string, "
         "duration string, updated_at timestamp, started_at timestamp, host string, size bigint")


def discover(listing: DataFrame, path: str, checkpoint: str, now: Column | None = None,
             every: str | None = None) -> StreamingQuery:
    """Writes a `new` ledger entry for every package that has none yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = batch.dropDuplicates(["package"]).persist()
        keys = found.select("package")
        if found.count() <= MAX_KEYS:  # then the whole ledger is only scanned, not shuffled
            keys = F.broadcast(keys)
        known = generations.read(spark, path, ENTRY).where(F.col("batch") != batch_id)
        fresh = ledger.new_packages(found, known.join(keys, "package", "left_semi"))
        stamp = now if now is not None else F.current_timestamp()
        entries = ledger.status_entry(fresh, F.lit("new"), F.lit(None), stamp)
        entries.write.mode("overwrite").parquet(batch_folder(path, batch_id))
        found.unpersist()

    return start(listing, write, checkpoint, every=every)


def compact_ledger(spark: SparkSession, path: str) -> int | None:
    """Merges the batches of `discover`, so that a lookup reads one generation and what came after it."""
    return generations.compact(spark, path, ENTRY, generations.newest_by("package"))


def process(work: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
            every: str | None = None) -> StreamingQuery:
    """Runs queued packages. `run` gives rows with (package, error, ...): a package that
    fails is an error row and becomes `failed`, the others finish. A repeated batch gives
    the same upload ids and replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = run(batch).withColumn("status", F.when(F.col("error").isNull(), "finished").otherwise("failed"))
        done.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return start(work, write, checkpoint, every=every)
