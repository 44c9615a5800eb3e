"""Batch folders and their compaction.

A stream adds one folder per batch; a reader would meet more of them every day. `compact` merges
the batches there are into a generation, a folder named by the last batch it holds, and readers
take the newest complete generation and the batches after it. Nothing is renamed or replaced: a
generation counts once its write has been committed, so readers and the stream go on meanwhile,
and a compaction that fails leaves only a folder that nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.session import path_exists

GENERATIONS = "_generations"
# Fixed value: the file that Spark leaves where a write is complete.
COMMITTED = "_SUCCESS"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the `batch=` folders below a path."""
    if not path_exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def newest_complete(spark: SparkSession, path: str) -> int | None:
    """The last of the `batch=` folders whose write has been committed."""
    return next((n for n in reversed(_numbers(spark, path)) if path_exists(spark, f"{path}/batch={n}/{COMMITTED}")), None)


def newest_generation(spark: SparkSession, path: str) -> int | None:
    return newest_complete(spark, f"{path}/{GENERATIONS}")


def read(spark: SparkSession, path: str, schema: str, till: int | None = None) -> DataFrame:
    """Rows of the newest generation and of the batches after it (up to `till`), with their
    `batch`; those of a generation have the batch it ends with. Nothing there gives no rows."""
    newest = newest_generation(spark, path)
    rows = spark.createDataFrame([], f"{schema}, batch bigint")
    reader = spark.read.schema(f"{schema}, batch bigint")
    if newest is not None:
        base = f"{path}/{GENERATIONS}"
        rows = reader.option("basePath", base).parquet(f"{base}/batch={newest}")
    later = [n for n in _numbers(spark, path) if (newest is None or n > newest) and (till is None or n <= till)]
    if later:
        more = reader.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in later])
        rows = rows.unionByName(more) if newest is not None else more
    return rows


def compact(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
    """Merges all batches but the last, which the stream may still repeat, into a generation.

    `merge` turns the rows read (with `batch`) into the rows to keep; merging merged rows with
    later ones must give what merging all of them gives. Returns the new generation's number, or
    None where there is nothing new to merge.
    """
    numbers, newest = _numbers(spark, path), newest_generation(spark, path)
    till = numbers[-2] if len(numbers) > 1 else None
    if till is None or (newest is not None and till <= newest):
        return None
    columns = [c.split()[0] for c in schema.split(",")]
    merged = merge(read(spark, path, schema, till)).select(*columns)
    merged.write.mode("overwrite").parquet(f"{path}/{GENERATIONS}/batch={till}")
    return till


def newest_by(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the newest row of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        return newest.select(*keys, "_row.*")

    return merge
