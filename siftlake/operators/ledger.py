"""The append-only status ledger and the three run ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions import text, times
from siftlake.operators import rules
from siftlake.operators.skew import lookup_join

# The statuses of a package, in the order of a normal run.
STATUSES = ["new", "queued", "unqueued", "processing", "downloading", "downloaded",
            "postprocessing", "uploading", "finished", "failed", "downloadfailed"]
IN_PROGRESS = ["processing", "downloading", "downloaded", "postprocessing", "uploading"]
ELIGIBLE = ["new", "unqueued"]

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(columns: str) -> T.StructType:
    """A flat schema from `name type, ...`, without a session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SUMMARY = _struct(
    "zipfile_basename string, zipfile_fullpath string, zipfile_size bigint, sessionid string, "
    "uploadid string, source_name string, starttime_script timestamp, is_encrypted boolean, "
    "hostname string, started_postprocessing timestamp, duration_in_sec double"
)
UPLOAD = _struct(
    "location_in_zip string, basename string, size bigint, upload_initiated boolean, "
    "upload_initiated_timestamp double, upload_duration_in_sec double, upload_error string, "
    "was_postprocessed_with string, ignored_upload boolean, ignored_reason string, "
    "ignored_pattern string, added_hostname boolean, added_hostname_duration double, "
    "added_hostname_error string"
)
POSTPROCESSING = _struct(
    "fullpath string, basename string, artifact string, cmd string, size bigint, success boolean, "
    "duration_in_sec double, error string, stdout string, stderr string, returncode int, logfile string"
)
LOG = _struct("timestamp string, level string, message string")
RUN = T.StructType(
    [
        T.StructField("summary", SUMMARY),
        T.StructField("uploads", T.ArrayType(UPLOAD)),
        T.StructField("postprocessing", T.ArrayType(POSTPROCESSING)),
        T.StructField("logs", T.ArrayType(LOG)),
    ]
)
ENTRY_COLUMNS = ["package", "row_key", "upload_id", "status", "session", "source", "duration",
                 "updated_at", "started_at", "host", "size"]


def shaped(df: DataFrame, schema: T.StructType, lead: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a ledger with every field present, after the `lead` columns; fields not given
    are null."""
    have = set(df.columns)
    return df.select(*lead, *[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def status_entry(df: DataFrame, status: Column, duration: Column, updated_at: Column) -> DataFrame:
    """Ledger rows from (package, upload_id, session, source, started_at, host, size)."""
    have = set(df.columns)
    text_of = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    started = F.col("started_at") if "started_at" in have else F.lit(None).cast("timestamp")
    return df.select(
        text_of("package").alias("package"),
        text.short_key(text_of("package")).alias("row_key"),
        text_of("upload_id").alias("upload_id"),
        status.alias("status"),
        text_of("session").alias("session"),
        text_of("source").alias("source"),
        duration.cast("string").alias("duration"),
        updated_at.alias("updated_at"),
        started.alias("started_at"),
        text_of("host").alias("host"),
        F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"),
    )


def latest(ledger: DataFrame, key: str = "package", order: tuple[str, ...] = ("updated_at", "seq"),
           merge: bool = False) -> DataFrame:
    """Current row per key: the last update wins. With `merge`, the last non-null value of
    each field. An aggregation with a partial step, so a key with many updates is reduced
    before the shuffle."""
    rest = [c for c in ledger.columns if c != key]
    when = F.struct(*order)
    if merge:
        return ledger.groupBy(key).agg(*[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in rest
        ]).select(*ledger.columns)
    newest = ledger.groupBy(key).agg(F.max_by(F.struct(*rest), when).alias("_row"))
    return newest.select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in ledger.columns])


def new_packages(listing: DataFrame, ledger: DataFrame, key: str = "package") -> DataFrame:
    """Discovered packages without an entry."""
    return listing.join(ledger.select(key).distinct(), key, "left_anti")


def processing_gate(listing: DataFrame, current: DataFrame | None, key: str = "package",
                    max_retry: int | None = None) -> DataFrame:
    """Adds `process`: only new or unqueued packages; no entry means no; without a ledger
    every package. `current` is unique by key; with `max_retry` its `failures` column also
    admits failed packages that were tried less often."""
    if current is None:
        return listing.withColumn("process", F.lit(True))
    eligible = F.col("_status").isin(ELIGIBLE)
    cols = [F.col(key), F.col("status").alias("_status")]
    if max_retry is not None:
        cols.append(F.col("failures").alias("_failures"))
        eligible = eligible | ((F.col("_status") == "failed") & (F.col("_failures") < max_retry))
    joined = listing.join(current.select(*cols), key, "left")
    return joined.withColumn("process", F.coalesce(eligible, F.lit(False))).select(*listing.columns, "process")


def with_status(current: DataFrame, status: str, key: str) -> DataFrame:
    """Entries in one status."""
    return current.where(F.col("status") == status).select(key)


def requeue(ledger: DataFrame, selected: DataFrame, updated_at: Column, key: str = "package") -> DataFrame:
    """Ledger events that set the selected, known packages back to unqueued. Only the key,
    the status and the time are set; the other fields stay as they were (merge form)."""
    known = ledger.select(key).distinct().join(selected.select(key).distinct(), key, "left_semi")
    return known.select(key, F.lit("unqueued").alias("status"), updated_at.alias("updated_at"))


def confirm(finished: DataFrame, visible_ids: DataFrame, now: Column, timeout_minutes: int = 30) -> DataFrame:
    """Adds `confirmation` to finished entries (upload_id, updated_at): confirmed when the id
    is visible, timeout when it is older than the limit, otherwise pending. Entries without
    a usable id, or with a final `confirmation` already, are left out."""
    if "confirmation" in finished.columns:
        final = F.coalesce(F.col("confirmation").isin("confirmed", "timeout"), F.lit(False))
        finished = finished.where(~final).drop("confirmation")
    ids = visible_ids.select("upload_id").distinct().withColumn("_seen", F.lit(True))
    checked = lookup_join(finished.where(rules.safe_id(F.col("upload_id"))), ids, ["upload_id"])
    cutoff = now - F.make_dt_interval(mins=F.lit(timeout_minutes))
    state = F.when(F.col("_seen"), "confirmed").when(
        F.coalesce(F.col("updated_at"), F.lit("0001-01-01").cast("timestamp_ntz")) < cutoff, "timeout"
    ).otherwise("pending")
    return checked.withColumn("confirmation", state).select(*finished.columns, "confirmation")


# --- run ledgers -------------------------------------------------------------------------


def summary_rows(packages: DataFrame, infos: DataFrame | None = None) -> DataFrame:
    """Summary rows, with host and post-processing start when `infos` is given (unique by
    zipfile_basename)."""
    out = packages if infos is None else lookup_join(packages, infos, ["zipfile_basename"])
    return shaped(out, SUMMARY)


def flatten(runs: DataFrame, section: str) -> DataFrame:
    """Rows of one list of a run (`uploads`, `postprocessing`, `logs`), each led by the
    upload id and the package name."""
    return runs.select(
        F.col("summary.uploadid").alias("uploadid"),
        F.col("summary.zipfile_basename").alias("zipfile"),
        F.explode(section).alias("_item"),
    ).select("uploadid", "zipfile", "_item.*")


def flatten_summary(runs: DataFrame) -> DataFrame:
    head = [F.col("summary.uploadid").alias("uploadid"), F.col("summary.zipfile_basename").alias("zipfile")]
    return runs.select(*head, *[F.col(f"summary.{n}").alias(n) for n in SUMMARY.names if n != "uploadid"])


def run_ledger_join(summary: DataFrame, uploads: DataFrame, postprocessing: DataFrame) -> DataFrame:
    """The three ledgers per run. Uploads and artifact runs are each reduced to one row per
    run before they meet, so a run with a third of all rows gives no pairs."""
    key = ["uploadid", "zipfile"]
    up = uploads.groupBy(*key).agg(
        F.count("*").alias("upload_rows"),
        F.count_if("upload_initiated").alias("initiated"),
        F.count_if("ignored_upload").alias("ignored"),
    )
    post = postprocessing.groupBy(*key).agg(
        F.count("*").alias("artifact_rows"),
        F.count_if("success").alias("artifacts_ok"),
        F.count_if(~F.col("success")).alias("artifacts_failed"),
    )
    zero = ["upload_rows", "initiated", "ignored", "artifact_rows", "artifacts_ok", "artifacts_failed"]
    return summary.join(up, key, "left").join(post, key, "left").fillna(0, zero)


def entry_view(current: DataFrame, now: Column | None = None) -> DataFrame:
    """What a status page shows of each entry, newest start first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = [blank(c) for c in ["row_key", "package", "host", "status", "source", "upload_id"] if c in current.columns]
    size = F.col("size").try_cast("bigint")
    cols = [*kept, F.when(size != 0, size).alias("size"), F.col("started_at")]
    if now is not None:
        cols.append(times.run_duration(F.col("status"), F.col("duration"), F.col("started_at"), now).alias("elapsed"))
    return current.select(*cols).orderBy(F.desc_nulls_last("started_at"), "package")


def union_ledgers(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
