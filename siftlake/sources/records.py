"""Record sources: JSON lines from files, members or memory, as VARIANT records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import paths

LINEAGE = ["src_host", "src_package", "src_upload"]


def read_jsonl(spark: SparkSession, path: str | list[str], recursive: bool = False,
               glob: str = "*.jsonl") -> DataFrame:
    """(file, pos, line) of every `.jsonl` file below a folder. `pos` orders the lines of
    one file: block start in the file, then the running row number of its task."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    lines = reader.text(path).select(
        paths.url_decode(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("line"),
    )
    pos = F.struct(F.col("block"), F.monotonically_increasing_id().alias("row"))
    return lines.withColumn("pos", pos).drop("block")


def from_memory(spark: SparkSession, data: dict | list[dict], file: str = "memory") -> DataFrame:
    """The same shape for a dict or a short list of dicts."""
    items = [data] if isinstance(data, dict) else list(data)
    rows = [(file, i, json.dumps(item, ensure_ascii=False)) for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "file string, pos bigint, line string")


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `record` (VARIANT); a line that is not JSON gives null."""
    return lines.withColumn("record", F.try_parse_json(line))


def record_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Only lines that hold something."""
    return lines.where(F.trim(F.col(line)) != "")


def with_lineage(df: DataFrame, host: Column, package: Column, upload: Column) -> DataFrame:
    """The three lineage columns, always last, replacing a field of the same name."""
    others = [c for c in df.columns if c not in LINEAGE]
    return df.select(
        *[F.col(f"`{c}`") for c in others],
        host.cast("string").alias(LINEAGE[0]),
        package.cast("string").alias(LINEAGE[1]),
        upload.cast("string").alias(LINEAGE[2]),
    )


def lineage_last(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in LINEAGE] + [c for c in LINEAGE if c in columns]
