"""Packages or folders in, artifact tables and ledgers out.

Every step is one Spark job over all packages. What one step leaves for the next is a
written table below the root, so a lost executor repeats tasks, never the whole run, and
running a session again replaces its own rows.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.artifacts import registry
from siftlake.functions import documents, paths, text
from siftlake.operators import ledger, numbering, rules
from siftlake.operators.skew import lookup_join
from siftlake.session import path_exists
from siftlake.sources import packages, records, sinks

#: From the loaded tables to artifact calls (name, arguments) and the tables they read.
Post = Callable[[sinks.ArtifactTables], tuple[list[tuple[str, dict]], dict[str, DataFrame]]]
STATUS = ("package string, row_key string, upload_id string, status string, session string, source string, "
          "duration string, updated_at timestamp, started_at timestamp, host string, size bigint, seq int")


def _now(now: datetime | None) -> Column:
    return F.lit(now or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def current_status(spark: SparkSession, root: str, before: str | None = None) -> DataFrame | None:
    """Newest status per package, optionally without the entries of one run."""
    if not path_exists(spark, f"{root}/_status"):
        return None
    rows = spark.read.schema(f"{STATUS}, run string").option("basePath", f"{root}/_status").parquet(f"{root}/_status")
    if before is not None:
        rows = rows.where(F.col("run") != before)
    return ledger.latest(rows.drop("run"), order=("updated_at", "seq"))


def _write_status(entries: DataFrame, root: str, run: str, step: str, seq: int) -> None:
    entries.withColumn("seq", F.lit(seq)).write.mode("overwrite").parquet(f"{root}/_status/run={run}/{step}")


def _failures(spark: SparkSession, root: str, before: str) -> DataFrame:
    rows = spark.read.schema(f"{STATUS}, run string").option("basePath", f"{root}/_status").parquet(f"{root}/_status")
    failed = (F.col("run") != before) & (F.col("status") == "failed")
    return rows.where(failed).groupBy(F.col("package").alias("_name")).agg(F.count("*").alias("_failures"))


def eligible(listing: DataFrame, root: str, run: str, use_ledger: bool = True, max_retry: int = 0) -> DataFrame:
    """Packages of the listing to process: unknown ones, known ones that are new or were queued
    again, and failed ones that have failed at most `max_retry` times."""
    known = current_status(listing.sparkSession, root, before=run) if use_ledger else None
    if known is None:
        return listing
    # the ledger knows packages by file name, the listing by address
    names = known.select(F.col("package").alias("_name"), "status")
    joined = lookup_join(listing.withColumn("_name", paths.basename(F.col("package"))), names, ["_name"])
    open_ = F.col("status").isNull() | F.col("status").isin(ledger.ELIGIBLE)
    if max_retry:
        joined = lookup_join(joined, _failures(listing.sparkSession, root, run), ["_name"])
        open_ = open_ | ((F.col("status") == "failed") & (F.coalesce("_failures", F.lit(0)) <= max_retry))
    return joined.where(open_).select(*listing.columns)


def _checked(session: str) -> str:
    if not re.fullmatch(paths.ID_PATTERN, session):
        raise ValueError(f"session must match {paths.ID_PATTERN}: {session!r}")
    return session


def run_key(inputs: DataFrame, session: str, column: str = "package") -> str:
    """Folder name of a run: the session and a digest of the set of its inputs. A session may be
    called for one message after another, and each call keeps its own rows; only a repeat with
    the same inputs replaces what it had written."""
    hashed = inputs.select(F.xxhash64(F.lit(1), column).alias("a"), F.xxhash64(F.lit(2), column).alias("b")).distinct()
    row = hashed.agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b"), F.sum(F.col("a").cast("decimal(20,0)"))).first()
    return f"{_checked(session)}-{hashlib.sha256(repr(tuple(row)).encode()).hexdigest()[:16]}"


def _entries(packages_: DataFrame, session: str, status: str | Column, at: Column, duration: Column | None = None) -> DataFrame:
    """Status rows of packages; the ledger knows them by file name."""
    duration = F.lit(None) if duration is None else duration
    named = packages_.withColumns({"package": paths.basename(F.col("package")), "session": F.lit(session), "started_at": at})
    return ledger.status_entry(named, F.lit(status) if isinstance(status, str) else status, duration, at)


def mark(packages_: DataFrame, root: str, session: str, status: str, now: datetime | None = None) -> None:
    """Enters a status of packages (package, size, source) outside of a run."""
    run = f"{run_key(packages_, session)}-{status}"
    _write_status(_entries(packages_.select("package", "size", "source"), session, status, _now(now)), root, run, status, 2)


def queue_packages(spark: SparkSession, listing: DataFrame, root: str, session: str, threshold: int,
                   per_batch: int = 20, now: datetime | None = None) -> DataFrame:
    """Discovered packages (package, size, source) to work messages (batch_kind, batch_no,
    message). Unknown packages enter the ledger as `new`, packed ones become `queued`."""
    found = listing.select("package", "size", "source")
    run = run_key(found, session)
    at, work = _now(now), f"{root}/_work/{run}"
    known = current_status(spark, root, before=run)
    if known is None:
        fresh = found
    else:
        names = found.withColumn("_name", paths.basename(F.col("package")))
        fresh = ledger.new_packages(names, known.select(F.col("package").alias("_name")), "_name").select(*found.columns)
    todo = _store(eligible(found, root, run), f"{work}/todo")
    _write_status(_entries(fresh, session, "new", at), root, run, "new", 0)
    batches = numbering.pack_batches(todo, ["source", "package"], threshold, per_batch)
    item = F.struct(F.col("package").alias("triagepackage"), F.col("source").alias("source_name"))
    messages = batches.groupBy("batch_kind", "batch_no").agg(  # at most per_batch items each
        documents.encode_message(F.sort_array(F.collect_list(item))).alias("message"))
    messages = _store(messages, f"{work}/messages")
    _write_status(_entries(todo, session, "queued", at), root, run, "queued", 1)
    return messages


def take_messages(messages: DataFrame, root: str, session: str, now: datetime | None = None) -> DataFrame:
    """Messages to packages (package, size, source) for `intake_packages`; they become
    `unqueued`. The size is not part of a message. Messages that name no package are kept below
    `rejects/messages`."""
    run = run_key(messages, session, "message")
    decoded = messages.withColumn("_items", documents.decode_message(F.col("message")))
    named = F.exists("_items", lambda item: item["triagepackage"].isNotNull())
    _store(decoded.where(~F.coalesce(named, F.lit(False))).select("message"), f"{root}/rejects/messages/run={run}")
    items = decoded.select(F.inline("_items"))
    taken = items.select(F.col("triagepackage").alias("package"), F.lit(None).cast("bigint").alias("size"),
                         F.col("source_name").alias("source"))
    taken = _store(taken.where("package is not null"), f"{root}/_work/{run}/taken")
    _write_status(_entries(taken, session, "unqueued", _now(now)), root, run, "unqueued", 2)
    return taken


def _post_rows(known: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The outcome of each artifact for each package that could be read; `outcomes` has one row an artifact."""
    done = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in ledger.POSTPROCESSING.fields]) for r in outcomes.collect()]
    by = known.where("package_error is null").select(F.col("upload_id").alias("uploadid"), paths.basename(F.col("package")).alias("zipfile"))
    kind = T.ArrayType(ledger.POSTPROCESSING)
    return by.select("uploadid", "zipfile", F.inline(F.array(*done).cast(kind)))


def intake_packages(spark: SparkSession, listing: DataFrame, root: str, session: str,
                    ignore: rules.IgnoreRules | None = None, prefix: str = "", sample: int | None = None,
                    registry_hosts: DataFrame | None = None, now: datetime | None = None,
                    use_ledger: bool = True, tasks: int | None = None, password: str | None = None,
                    max_retry: int = 0, post: Post | None = None) -> DataFrame:
    """Process packages (package, size, source) and return the upload rows of the run.

    Below `root`: `tables`, `rejects` (lines that are no JSON record), `ledgers` (summary,
    uploads, postprocessing, logs), `snapshots`, the status ledger and the work tables of the run.

    With `post` artifacts run over the loaded tables: it gives the calls and their input tables.
    Each runs once for all packages, below `artifacts`, and every package that was read gets its
    outcome. All packages of a run are one job, so their durations are those of the run, and an
    upload's are those of its table's load.
    """
    run, begun = run_key(listing, session), time.time()
    started, work = _now(now), f"{root}/_work/{run}"
    todo = eligible(listing.select("package", "size", "source"), root, run, use_ledger, max_retry)
    runs = _store(todo.withColumn("upload_id", text.run_id(F.col("package"), F.lit(session))), f"{work}/runs")
    _write_status(_entries(runs, session, "processing", started), root, run, "start", 3)

    inner = _store(packages.unpack_inner(runs, f"{work}/inner", tasks, password), f"{work}/unpacked")
    opened = lookup_join(runs.select("package"), inner, ["package"])
    members = _store(packages.member_inventory(opened, tasks, password), f"{work}/members")
    hosts = packages.package_hosts(packages.client_infos(opened, tasks, password), registry_hosts)
    facts = packages.has_raw_evidence(members).join(
        members.where("error is not null").groupBy("package").agg(F.first("error").alias("package_error")), "package", "left")
    known = lookup_join(lookup_join(lookup_join(runs, hosts, ["package"]), facts, ["package"]), inner, ["package"])
    known = _store(known, f"{work}/known")

    decided = rules.with_ignore_decision(members.where("member is not null"), ignore or rules.IgnoreRules())
    named = decided.withColumn("table_name", paths.table_name(F.col("member"), prefix))
    tagged = lookup_join(named, known.select("package", "host", "upload_id", *packages.UNPACKED), ["package"], "inner")
    kept = tagged.where("not ignored_upload")
    lines = packages.member_lines(kept, tasks, carry=("table_name", "host", "upload_id"), password=password)
    store = sinks.ArtifactTables(spark, f"{root}/tables", prefix)
    landing = lines.select("table_name", F.concat_ws("/", "package", "member").alias("file"), F.col("line_no").alias("pos"),
                           "line", "host", paths.basename(F.col("package")).alias("package"), F.col("upload_id").alias("upload"), "error")
    load_begun = time.time()
    loaded = sinks.ingest(landing, store, f"{work}/lines", sample, run=run, numbered=True, rejects=f"{root}/rejects/lines")

    # With the schema: no package may have had a line.
    unread = spark.read.schema(landing.schema).parquet(f"{work}/lines").where("error is not null").select(
        F.col("file").alias("_file"), F.col("error").alias("_unread")).distinct()
    outcome = loaded.select("table_name", F.col("initiated").alias("_loaded"), F.col("error").alias("_load_error"),
                             F.col("duration_in_sec").alias("_load_seconds"))
    rows = lookup_join(tagged.withColumn("_file", F.concat_ws("/", "package", "member")), outcome, ["table_name"])
    rows = lookup_join(rows, unread, ["_file"])
    error = F.coalesce("_unread", "_load_error")
    uploads = rows.select(
        F.col("upload_id").alias("uploadid"), paths.basename(F.col("package")).alias("zipfile"),
        F.col("member").alias("location_in_zip"), "basename", "size",
        (~F.col("ignored_upload") & error.isNull() & F.coalesce("_loaded", F.lit(False))).alias("upload_initiated"),
        F.when(F.col("_loaded"), F.lit(load_begun)).alias("upload_initiated_timestamp"),
        F.when(F.col("_loaded"), F.col("_load_seconds")).alias("upload_duration_in_sec"),
        F.when(~F.col("ignored_upload"), error).alias("upload_error"), "ignored_upload", "ignored_reason", "ignored_pattern")
    uploads = ledger.shaped(uploads, ledger.UPLOAD, lead=("uploadid", "zipfile"))
    uploads = _store(uploads, f"{root}/ledgers/uploads/run={run}")

    post_begun = F.lit(None).cast("timestamp")
    if post is not None:
        post_begun = _now(now)
        _write_status(_entries(known.where("package_error is null"), session, "postprocessing", post_begun), root, run, "post", 4)
        _store(_post_rows(known, registry.collect(spark, *post(store), f"{root}/artifacts/run={run}")),
               f"{root}/ledgers/postprocessing/run={run}")

    seconds = F.lit(time.time() - begun)
    summary = known.select(
        paths.basename(F.col("package")).alias("zipfile_basename"), F.col("package").alias("zipfile_fullpath"),
        F.col("size").alias("zipfile_size"), F.lit(session).alias("sessionid"), F.col("upload_id").alias("uploadid"),
        F.col("source").alias("source_name"), started.alias("starttime_script"), "is_encrypted",
        F.col("host").alias("hostname"), F.when(F.col("package_error").isNull(), post_begun).alias("started_postprocessing"), seconds.alias("duration_in_sec"))
    summary = _store(ledger.shaped(summary, ledger.SUMMARY), f"{root}/ledgers/summary/run={run}")
    by = ["uploadid", "zipfile"]
    failed = known.where("package_error is not null").select(
        F.col("upload_id").alias("uploadid"), paths.basename(F.col("package")).alias("zipfile"),
        F.col("package_error").alias("_message"))
    partly = uploads.where("upload_error is not null").select(
        *by, F.concat_ws(": ", "location_in_zip", "upload_error").alias("_message"))
    _store(sinks.log_rows(failed.unionByName(partly), started, F.lit("ERROR"), F.col("_message"), by),
           f"{root}/ledgers/logs/run={run}")
    documents = sinks.snapshot_documents(summary, "summary").unionByName(sinks.snapshot_documents(uploads, "uploads"))
    sinks.write_snapshots(documents, f"{root}/snapshots", time.time_ns())
    state = F.when(F.col("package_error").isNull(), "finished").otherwise("failed")
    _write_status(_entries(known, session, state, _now(now), text.duration_hms(seconds)), root, run, "end", 5)
    return uploads


def intake_folder(spark: SparkSession, folder: str, root: str, session: str, recursive: bool = False,
                  ignore: rules.IgnoreRules | None = None, prefix: str = "", sample: int | None = None) -> DataFrame:
    """Load the `.jsonl` files of a folder, tagged with the host of its client information
    and the folder name; returns one outcome row per table."""
    lines = records.read_jsonl(spark, folder, recursive)
    decision = rules.ignore_decision(F.col("file"), F.col("file_size"), ignore or rules.IgnoreRules())
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    info = f"{folder.rstrip('/')}/{packages.CLIENT_INFO}"
    host = ""
    if path_exists(spark, info):  # one small document
        document = spark.read.option("wholetext", True).text(info).select(F.get_json_object("value", "$.os_info.fqdn"))
        host = document.first()[0] or ""
    run = run_key(spark.createDataFrame([(folder.rstrip("/"),)], "package string"), session)
    kept = lines.where(~decision["ignored"]).select(
        paths.table_name(F.col("file"), prefix).alias("table_name"), "file", "pos", "line",
        F.lit(host).alias("host"), F.lit(name).alias("package"),
        text.run_id(F.lit(name), F.lit(session)).alias("upload"))
    store = sinks.ArtifactTables(spark, f"{root}/tables", prefix)
    return sinks.ingest(kept, store, f"{root}/_work/{run}/lines", sample, run=run, rejects=f"{root}/rejects/lines")
