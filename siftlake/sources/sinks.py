"""Sinks: artifact tables with an add-only catalog, ledgers, snapshots and exports."""

from __future__ import annotations

import json
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions import paths
from siftlake.operators import ledger, schema
from siftlake.operators.schema import FieldType
from siftlake.operators.skew import lookup_join
from siftlake.session import case_sensitive, path_exists, timestamps_with_ranges
from siftlake.sources import records

CATALOG_SCHEMA = "table_name string, column_name string, column_type string, position int, version bigint"
#: A clustered load's files hold at most so many rows, its row groups about so many bytes.
FILE_ROWS = 5_000_000
ROW_GROUP_BYTES = 16 << 20
#: How often a load tries to add its columns, and waits for an unfinished version before it takes it over.
COMMIT_TRIES = 100
CLOSING_TRIES = 20
CLOSING_WAIT = 0.5
UPLOAD_RESULT = "table_name string, rows bigint, initiated boolean, duration_in_sec double, error string"
REJECTED = "table_name string, rejected bigint"


class ArtifactTables:
    """One append-only Parquet table per artifact below `root`.

    The catalog is a list of numbered versions, each a small file that adds columns (table,
    column, type). The first type a column was given wins, so adding columns never rewrites data
    and reading never has to merge file footers. A version is only ever created where none
    stands, so of two loads that add columns at once one comes first, and the other reads its
    version and merges again before it writes. The store has to refuse to create a file that
    exists, as HDFS, local disks and conditional object writes do.

    With `cluster`, the columns a table is mostly filtered by (host, then a time), each load is
    dealt into ranges of them and sorted: a filter skips all files and row groups whose ranges
    do not meet it, and a host with many rows is many ranges of time. Columns that a table does
    not have are left out; without any, rows stay where they were read.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "", cluster: tuple[str, ...] = ()):
        self.spark, self.root, self.prefix, self.cluster = spark, root.rstrip("/"), prefix, cluster

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table_name(self, file: str) -> str:
        """prefix + sanitised file stem; a split part belongs to the table of its file."""
        name = file.rsplit("/", 1)[-1]
        head, dot, tail = name.rpartition(".")
        if dot and tail.startswith("part") and tail[4:].isdigit():
            name = head
        head, dot, _ = name.rpartition(".")
        return self.prefix + paths.sanitize_name_py(head if head else name)

    def _catalog(self) -> list[Row]:
        """Rows of the complete versions, those with their closing row. They are columns of
        tables, not records."""
        path = f"{self.root}/_catalog"
        if not path_exists(self.spark, path):
            return []
        rows = self.spark.read.schema(CATALOG_SCHEMA).json(path).collect()
        closed = {r["version"] for r in rows if r["table_name"] is None and r["position"] == -1}
        return sorted((r for r in rows if r["table_name"] is not None and r["version"] in closed),
                      key=lambda r: (r["table_name"], r["version"], r["position"]))

    def _last_version(self) -> int:
        """The highest version that is there and whole; one that is not gets time to be closed."""
        if not path_exists(self.spark, f"{self.root}/_catalog"):
            return -1
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_catalog")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        numbers = [int(name[:-5]) for name in (f.getPath().getName() for f in store.listStatus(folder)) if name[:-5].isdigit()]
        if not numbers:
            return -1
        for _ in range(CLOSING_TRIES):
            rows = self.spark.read.schema(CATALOG_SCHEMA).json(self._version_path(max(numbers)))
            if rows.where("table_name IS NULL AND position = -1").take(1):
                return max(numbers)
            time.sleep(CLOSING_WAIT)
        return max(numbers) - 1  # its writer has died; the number is taken over

    def _version_path(self, version: int) -> str:
        return f"{self.root}/_catalog/{version:020d}.json"

    def _commit(self, version: int, rows: list[tuple]) -> bool:
        """Creates a version; False if another load was first."""
        token = uuid.uuid4().hex
        names = [c.split()[0] for c in CATALOG_SCHEMA.split(", ")]
        lines = [json.dumps(dict(zip(names, row, strict=True))) for row in rows]
        lines.append(json.dumps({"position": -1, "version": version, "column_name": token}))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._version_path(version))
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        unclosed = store.exists(path) and not self.spark.read.schema(CATALOG_SCHEMA).json(self._version_path(version)).where("position = -1").take(1)
        content = "\n".join(lines).encode() + b"\n"
        try:
            if store.getScheme() == "file":  # whose Hadoop client looks first and creates then
                local = path.toUri().getPath()
                os.makedirs(os.path.dirname(local), exist_ok=True)
                with open(os.open(local, os.O_CREAT | os.O_WRONLY | (os.O_TRUNC if unclosed else os.O_EXCL), 0o644), "wb") as out:
                    out.write(content)
            else:
                out = store.create(path, unclosed)
                out.write(bytearray(content))
                out.close()
        except FileExistsError:
            return False
        except Py4JJavaError as exc:
            if "AlreadyExists" in exc.java_exception.getClass().getName():
                return False
            raise
        # Whoever takes over an unclosed version may have been followed by its writer, or by another.
        last = self.spark.read.schema(CATALOG_SCHEMA).json(self._version_path(version)).where("position = -1").select("column_name").first()
        return last is not None and last[0] == token

    def all_columns(self) -> dict[str, T.StructType]:
        """Current columns of every table: the first type that each was given."""
        tables: dict[str, dict[str, T.StructField]] = {}
        for r in self._catalog():
            kind = T.StructType.fromDDL(f"x {r['column_type']}")["x"].dataType
            tables.setdefault(r["table_name"], {}).setdefault(r["column_name"], T.StructField(r["column_name"], kind))
        return {name: schema.lineage_last(T.StructType(list(fields.values()))) for name, fields in tables.items()}

    def columns(self, table: str) -> T.StructType | None:
        """Current columns of a table, or None when it does not exist."""
        return self.all_columns().get(table)

    def evolve(self, incoming: dict[str, T.StructType]) -> dict[str, T.StructType]:
        """Create tables or add their new columns; existing types stay. One version for all."""
        for _ in range(COMMIT_TRIES):
            version = self._last_version() + 1
            existing, rows, merged = self.all_columns(), [], {}
            for table, columns in incoming.items():
                merged[table] = schema.merge_schema(existing.get(table), columns)
                kinds = {f.name: f.dataType.simpleString() for f in merged[table].fields}
                added = schema.new_columns(existing.get(table), columns)
                rows += [(table, n, kinds[n], merged[table].names.index(n), version) for n in added]
            if not rows or self._commit(version, rows):
                return merged
        raise RuntimeError(f"{self.root}: {COMMIT_TRIES} other loads added columns first")

    def append(self, df: DataFrame, table: str, target: T.StructType | None = None,
               run: str | None = None) -> tuple:
        """Add typed rows; returns (table, rows, initiated, duration, error). A failure is a
        result, not an exception, so other tables go on. Each run has its own folder, and
        loading a run again replaces what it had written."""
        started = time.time()
        try:
            target = target or self.evolve({table: df.schema})[table]
            seen = Observation()
            typed = schema.conform(df, target)
            keys = [F.col(f"`{name}`") for name in self.cluster if name in target.names]
            if keys:
                typed = typed.repartitionByRange(*keys).sortWithinPartitions(*keys)
            counted = typed.observe(seen, F.count(F.lit(1)).alias("rows"))
            writer = counted.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS if keys else 0)
            with timestamps_with_ranges(self.spark):
                writer.option("parquet.block.size", ROW_GROUP_BYTES if keys else 128 << 20).parquet(
                    f"{self.path(table)}/run={run or uuid.uuid4().hex}")
            return table, int(seen.get["rows"]), True, time.time() - started, None
        except Exception as exc:
            return table, None, False, time.time() - started, f"{type(exc).__name__}: {exc}".splitlines()[0]

    def read(self, table: str, current: T.StructType | None = None) -> DataFrame:
        """Rows of all loads; `current` are the table's columns where they have been asked for already."""
        current = current or self.columns(table)
        if current is None:
            raise ValueError(f"no table {table}")
        twins = len(current.names) - len({n.lower() for n in current.names})
        if twins and self.spark.conf.get("spark.sql.caseSensitive") != "true":
            raise ValueError(f"{table} has columns that differ only in case: set spark.sql.caseSensitive to true")
        rows = self.spark.read.schema(current).option("basePath", self.path(table)).parquet(self.path(table))
        return rows.select(*[F.col(f"`{n}`") for n in current.names])

    def results(self, outcomes: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(outcomes, UPLOAD_RESULT)


def typed_records(parsed: DataFrame, voted: list[FieldType], host: Column, package: Column,
                  upload: Column) -> DataFrame:
    """VARIANT records as the voted columns, lineage last."""
    own = [f for f in voted if f.name not in records.LINEAGE]
    return parsed.where("record is not null").select(
        *schema.typed_columns(F.col("record"), own),
        host.alias(records.LINEAGE[0]), package.alias(records.LINEAGE[1]), upload.alias(records.LINEAGE[2]))


def _column_types(landed: DataFrame, sample: int | None, numbered: bool) -> DataFrame:
    """(table_name, file, key, kind) of every column that any line has. A sample may decide the
    type of a column that it holds; columns beyond it are voted on with all their values."""
    by = ["table_name", "file"]
    if sample is None:
        return schema.vote(landed, by, "pos", None, whole=True)
    voted = schema.vote(schema.head_lines(landed, by, "pos", sample, numbered), by, "pos", sample, whole=True)
    values = schema.fields(landed, *by, "pos").join(voted.select(*by, "key"), [*by, "key"], "left_anti")
    return voted.unionByName(schema.majority(schema.classify(values, "value").drop("value"), [*by, "key"], "pos", whole=True))


def ingest(lines: DataFrame, tables: ArtifactTables, raw_path: str, sample: int | None = None,
           parallel: int = 4, run: str | None = None, numbered: bool = False, rejects: str | None = None) -> DataFrame:
    """Lines (table_name, file, pos, line, host, package, upload) to artifact tables; returns
    one outcome row per table.

    Lines are landed once, partitioned by table, so that each load reads only its own
    partition. One job votes on the columns of all tables; as when files are loaded one by
    one, the first file that has a column gives its type. The loop is over artifact types,
    never over packages. `numbered` says that `pos` is the line number in the file. Columns are
    found over all lines; lines that are no JSON object are counted as `rejected` and written
    below `rejects`, one folder a run.
    """
    spark = lines.sparkSession
    held = F.trim("line") != ""
    if "error" in lines.columns:  # members that could not be read stay visible in the landed rows
        held = held | F.col("error").isNotNull()
    lines.where(held).write.mode("overwrite").partitionBy("table_name").parquet(raw_path)
    read = records.parsed(spark.read.schema(lines.schema).parquet(raw_path))
    is_record = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    landed = read.where(is_record)
    bad = read.where(~is_record & F.col("line").isNotNull())
    kept = [c for c in ("table_name", "file", "pos", "line", "host", "package", "upload") if c in lines.columns]
    if rejects:
        bad.select(*kept).write.mode("overwrite").parquet(f"{rejects}/run={run or uuid.uuid4().hex}")
    refused = {r["table_name"]: r["count"] for r in bad.groupBy("table_name").count().collect()}  # one row a table
    per_file = _column_types(landed, sample, numbered)
    voted: dict[str, list[FieldType]] = {}
    for row in schema.first_file_types(per_file, ["table_name"], "file").orderBy("table_name", "key").collect():
        voted.setdefault(row["table_name"], []).append(FieldType(row["key"], row["kind"]))
    targets = tables.evolve({name: schema.struct_of(fields) for name, fields in voted.items()})

    def load(name: str) -> tuple:
        own = landed.where(F.col("table_name") == name)
        typed = typed_records(own, voted[name], F.col("host"), F.col("package"), F.col("upload"))
        return tables.append(typed, name, targets[name], run)

    # Loads of different tables are independent jobs.
    with case_sensitive(spark), timestamps_with_ranges(spark), ThreadPoolExecutor(parallel) as pool:
        outcomes = list(pool.map(load, voted))
    outcomes += [(name, 0, False, 0.0, "no line is a JSON object") for name in sorted(refused.keys() - voted.keys())]
    counts = spark.createDataFrame(list(refused.items()), REJECTED)
    return tables.results(outcomes).join(counts, "table_name", "left").fillna(0, ["rejected"])


# --- ledgers, snapshots, exports ------------------------------------------------------------


def write_run_ledgers(runs: DataFrame, root: str, run: str | None = None) -> None:
    """Write the summary, upload and post-processing rows of finished runs. The runs are stored
    once and flattened from there; all of it is in folders of this call, which a repeat under the
    same `run` replaces."""
    run = run or uuid.uuid4().hex
    runs.write.mode("overwrite").parquet(f"{root}/_runs/run={run}")
    stored = runs.sparkSession.read.schema(runs.schema).parquet(f"{root}/_runs/run={run}")
    ledger.flatten_summary(stored).write.mode("overwrite").parquet(f"{root}/summary/run={run}")
    for section in ("uploads", "postprocessing", "logs"):
        ledger.flatten(stored, section).write.mode("overwrite").parquet(f"{root}/{section}/run={run}")


def snapshot_documents(df: DataFrame, section: str, upload_id: str = "uploadid") -> DataFrame:
    """(upload_id, section, document): each row as JSON with ISO times. Rows of one run stay
    separate lines, so a run of any size is never gathered in one place."""
    body = F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                                             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return df.select(F.col(upload_id).alias("upload_id"), F.lit(section).alias("section"), body.alias("document"))


def write_snapshots(documents: DataFrame, path: str, version: int) -> None:
    """Append a new version of the snapshots of the upload ids in `documents`. One folder per
    id would give millions of small files, so the newest version of an id counts instead."""
    documents.withColumn("version", F.lit(version).cast("bigint")).write.mode("append").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of every upload id."""
    stored = spark.read.schema("upload_id string, section string, document string, version bigint").json(path)
    newest = stored.groupBy("upload_id").agg(F.max("version").alias("version"))
    return lookup_join(stored, newest, ["upload_id", "version"], "inner").drop("version")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_format(df: DataFrame, path: str, fmt: str) -> None:
    """csv, json or jsonl; nested columns become JSON text in csv."""
    if fmt == "csv":
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
                else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def log_rows(df: DataFrame, when: Column, level: Column, message: Column, by: list[str]) -> DataFrame:
    """Run log rows, per package and artifact."""
    return df.select(*by, when.cast("string").alias("timestamp"), level.alias("level"), message.alias("message"))
