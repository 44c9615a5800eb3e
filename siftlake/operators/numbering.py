"""Global numbering and running sums without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import ensure_checkpoint_dir

BLOCK = 65_536


def ordered_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Zero-based position of every row in the order of `order`.

    Rows are range-partitioned and sorted, and the sorted table is checkpointed so that its
    partitions stay as they are even when an executor is lost. The offset of a partition is
    the row count of the earlier ones: one row per partition, which bounds the broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    row = F.monotonically_increasing_id()
    numbered = ranged.withColumn("_part", F.shiftright(row, 33)).withColumn(
        "_row", row.bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    out = numbered.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_row")).select(*df.columns, name)


def running_sum(df: DataFrame, by: list[str], order: str, value: Column, name: str = "running",
                block: int = BLOCK) -> DataFrame:
    """Inclusive running sum per group along an integer order column.

    Blocks of the order column are summed first; only block sums meet in one window, and the
    rows of a block in another, so one large group is spread over its blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block).cast("bigint")).withColumn("_value", value)
    sums = blocked.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(bases, [*by, "_block"]).withColumn(name, F.col("_base") + F.sum("_value").over(inside))
    return out.select(*df.columns, F.col(name).cast("bigint").alias(name))


def pack_batches(packages: DataFrame, order: list[str], threshold: int, per_batch: int = 20,
                 size: str = "size") -> DataFrame:
    """Work batches: each package of at least `threshold` bytes alone, the others in groups
    of `per_batch` in discovery order. Adds `batch_kind` and `batch_no` (per kind)."""
    kind = F.when(F.col(size) >= threshold, "large").otherwise("small")
    numbered = ordered_index(packages.withColumn("batch_kind", kind), ["batch_kind", *order], "_index")
    first = numbered.groupBy("batch_kind").agg(F.min("_index").alias("_first"))
    per = F.when(F.col("batch_kind") == "large", 1).otherwise(per_batch)
    out = numbered.join(F.broadcast(first), "batch_kind")  # two rows
    batch_no = F.floor((F.col("_index") - F.col("_first")) / per).cast("bigint")
    return out.withColumn("batch_no", batch_no).drop("_index", "_first")
