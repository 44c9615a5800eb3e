"""Streams over the test tables, run until the available data is handled."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import text
from siftlake.operators.ledger import STATUSES
from siftlake.plans.base import PKG, REC, lit_ntz, query, stamp, stamp_sql, table
from siftlake.session import scratch_path
from siftlake.streaming import discovery, reactions, status

_STATUS_EVENTS = f"""
 SELECT package, 'new' AS status, started_at AS t FROM {PKG.sql}
 UNION ALL SELECT package, 'processing', started_at + INTERVAL 1 MINUTE FROM {PKG.sql} WHERE orderkey % 2 = 0
 UNION ALL SELECT package, 'uploading', started_at + INTERVAL 2 MINUTE FROM {PKG.sql} WHERE orderkey % 4 = 0
 UNION ALL SELECT package, 'finished', started_at + INTERVAL 3 MINUTE FROM {PKG.sql} WHERE orderkey % 8 = 0
 UNION ALL SELECT package, 'downloading', started_at + INTERVAL 4 MINUTE FROM {PKG.sql} WHERE orderkey % 16 = 0
 UNION ALL SELECT package, 'failed', started_at + INTERVAL 5 MINUTE FROM {PKG.sql} WHERE orderkey % 6 = 0
 UNION ALL SELECT package, 'unqueued', started_at + INTERVAL 6 MINUTE FROM {PKG.sql} WHERE orderkey % 6 = 0
 UNION ALL SELECT package, 'processing', started_at + INTERVAL 50 MINUTE FROM {PKG.sql} WHERE orderkey % 12 = 0"""
_STATUS_STATE = f"""
 WITH e AS ({_STATUS_EVENTS}),
 r AS (SELECT *, list_position({STATUSES}, status) AS rank FROM e),
 m AS (SELECT *, lag(status) OVER w AS before, lag(rank) OVER w AS rank_before FROM r WINDOW w AS (PARTITION BY package ORDER BY t, rank)),
 s AS (SELECT package, arg_max(status, t) AS status, max(t) FILTER (before IS NULL OR before <> status) AS entered, count(*) AS events,
   coalesce(bool_or(before <> status AND status <> 'unqueued'
     AND (rank < rank_before OR before IN ('failed', 'downloadfailed', 'finished'))), FALSE) AS illegal FROM m GROUP BY package)"""


def _stream(spark, sf, view, *columns):
    source = discovery.table_stream(spark, sf, f"{view.source}.parquet")
    return source.selectExpr(*[f"{view.columns[c]} AS {c}" for c in columns])


def _run(query_):
    query_.awaitTermination()


@query("STM-01 JN-01 PRJ-04", f"""
 SELECT package, substr(md5(package), 1, 8) AS row_key, 'new' AS status, source, size FROM {PKG.sql}""")
def stream_discovery(spark, sf):
    out = scratch_path(spark, "discovery")
    listing = lambda: _stream(spark, sf, PKG, "package", "source", "size")
    now = F.lit("2026-01-01").cast("timestamp")
    _run(discovery.discover(listing(), f"{out}/ledger", f"{out}/checkpoint", now))
    # the same files again, found by another watcher: known packages are not entered twice
    _run(discovery.discover(listing().union(listing()), f"{out}/ledger", f"{out}/second", now))
    return discovery.read_batches(spark, f"{out}/ledger", discovery.ENTRY).select(
        "package", "row_key", "status", "source", "size")


@query("STM-02 FN-08", f"""
 SELECT package, concat('id', substr(md5(concat(package, '|', session)), 1, 16)) AS upload_id,
   CASE WHEN status = 'processing' THEN 'cannot open' END AS error,
   CASE WHEN status = 'processing' THEN 'failed' ELSE 'finished' END AS status FROM {PKG.sql}""")
def stream_processing(spark, sf):
    out = scratch_path(spark, "processing")

    def run(batch):
        error = F.when(F.col("status") == "processing", "cannot open")
        return batch.select("package", text.run_id(F.col("package"), F.col("session")).alias("upload_id"),
                            error.alias("error"))

    work = _stream(spark, sf, PKG, "package", "session", "status")
    _run(discovery.process(work, run, f"{out}/runs", f"{out}/checkpoint"))
    return discovery.read_batches(
        spark, f"{out}/runs", "package string, upload_id string, error string, status string").drop("batch")


def _status_changes(spark, sf):
    pkg = _stream(spark, sf, PKG, "package", "orderkey", "started_at")
    steps = [("new", 1, 0), ("processing", 2, 1), ("uploading", 4, 2), ("finished", 8, 3), ("downloading", 16, 4),
             ("failed", 6, 5), ("unqueued", 6, 6), ("processing", 12, 50)]
    events = F.filter(F.array(*[
        F.struct((F.col("orderkey") % n == 0).alias("on"), F.lit(s).alias("status"),
                 (F.col("started_at").cast("timestamp") + F.make_dt_interval(mins=F.lit(m))).alias("updated_at"))
        for s, n, m in steps]), lambda s: s["on"])
    return pkg.select("package", F.inline(events)).drop("on")


@query("STM-03", f"""{_STATUS_STATE}
 SELECT package, status, {stamp_sql('entered')} AS entered_at, events, illegal FROM s""")
def stream_status(spark, sf):
    out = scratch_path(spark, "status")
    _run(status.follow_status(_status_changes(spark, sf), out, f"{out}/checkpoint"))
    return status.current(spark, out).withColumn("entered_at", stamp("entered_at"))


@query("STM-04", f"""
 WITH e AS (SELECT *, event_id - 1 AS prev FROM {REC.sql}),
 m AS (SELECT least(max(ts) FILTER (artifact = 'signup'), max(ts) FILTER (artifact <> 'signup')) - INTERVAL 10 MINUTE AS mark FROM e),
 j AS (SELECT f.event_id AS upload_id, f.ts AS finished_at, v.ts AS visible_at FROM e f
   LEFT JOIN e v ON v.prev = f.event_id AND v.artifact <> 'signup' AND v.ts >= f.ts - INTERVAL 1 DAY AND v.ts <= f.ts + INTERVAL 30 MINUTE
   WHERE f.artifact = 'signup')
 SELECT upload_id, {stamp_sql('finished_at')} AS finished_at,
   CASE WHEN visible_at IS NOT NULL THEN 'confirmed' ELSE 'timeout' END AS confirmation FROM j, m
 WHERE visible_at IS NOT NULL OR finished_at + INTERVAL 30 MINUTE < date_trunc('milliseconds', mark)""")
def stream_confirm(spark, sf):
    out = scratch_path(spark, "confirm")
    rec = lambda: _stream(spark, sf, REC, "event_id", "artifact", "ts").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    finished = rec().where("artifact = 'signup'").selectExpr("event_id AS upload_id", "ts AS finished_at")
    visible = rec().where("artifact <> 'signup'").selectExpr("event_id - 1 AS upload_id", "ts AS visible_at")
    stream = status.confirmations(finished, visible, "10 minutes", early="1 day")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(discovery.batch_folder(f"{out}/rows", batch_id))

    _run(discovery.start(stream, write, f"{out}/checkpoint"))
    rows = discovery.read_batches(
        spark, f"{out}/rows", "upload_id bigint, finished_at timestamp, visible_at timestamp, confirmation string")
    return rows.select("upload_id", stamp("finished_at"), "confirmation")


@query("STM-04 JN-02 AG-08", f"""
 WITH f AS (SELECT event_id AS upload_id, ts AS finished_at FROM {REC.sql} WHERE artifact = 'signup'),
 v AS (SELECT DISTINCT event_id - 1 AS upload_id FROM {REC.sql} WHERE artifact <> 'signup'),
 c AS (SELECT max(finished_at) AS clock FROM f)
 SELECT concat('id', f.upload_id) AS upload_id, {stamp_sql('finished_at')} AS finished_at, CASE WHEN v.upload_id IS NOT NULL THEN 'confirmed'
   WHEN finished_at < clock - INTERVAL 30 MINUTE THEN 'timeout' ELSE 'pending' END AS confirmation
 FROM f LEFT JOIN v USING (upload_id), c""")
def stream_confirm_pending(spark, sf):
    out = scratch_path(spark, "pending")
    finished = _stream(spark, sf, REC, "event_id", "artifact", "ts").where("artifact = 'signup'").select(
        F.concat(F.lit("id"), "event_id").alias("upload_id"), F.col("ts").cast("timestamp").alias("finished_at"))
    visible = lambda spark: REC.df(spark, sf).where("artifact <> 'signup'").select(
        F.concat(F.lit("id"), F.col("event_id") - 1).alias("upload_id"))
    _run(status.follow_confirmations(finished, visible, out, f"{out}/checkpoint"))
    return status.decided(spark, out).withColumn("finished_at", stamp("finished_at"))


@query("STM-05 ART-12", f"""
 SELECT user_id AS client_id, CASE WHEN user_id % 4 = 0 THEN 'Linux' WHEN user_id % 4 = 1 THEN 'Workstation'
   WHEN user_id % 4 = 2 THEN 'Server' END AS label, {stamp_sql('min(ts)')} AS first_seen
 FROM {REC.sql} WHERE user_id % 4 <> 3 AND artifact <> 'view' GROUP BY user_id""")
def stream_labels(spark, sf):
    out = scratch_path(spark, "labels")
    u = F.col("user_id") % 4
    done = _stream(spark, sf, REC, "user_id", "artifact", "ts").select(
        F.col("user_id").alias("client_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.array(F.when(F.col("artifact") == "view", "Other").otherwise("Generic.Client.Info/WindowsInfo")).alias(
            "artifacts_with_results"),
        F.when(u == 0, "linux").otherwise("windows").alias("os"),
        F.when(u == 1, "Standalone Workstation").when(u == 2, "Member Server").otherwise("none").alias("domain_role"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(discovery.batch_folder(f"{out}/rows", batch_id))

    _run(discovery.start(reactions.labels(done, "ts"), write, f"{out}/checkpoint", mode="update"))
    rows = discovery.read_batches(spark, f"{out}/rows", "client_id bigint, label string, first_seen timestamp")
    return rows.groupBy("client_id", "label").agg(F.min("first_seen").alias("t")).select(
        "client_id", "label", stamp("t", "first_seen"))


@query("STM-06 JN-10 FN-22", f"""
 SELECT user_id AS client_id, concat('F.', event_id) AS flow_id,
   concat('F.', event_id, '/Host ', host, ' F.', event_id, ' ', strftime(ts, '%Y%m%d'), '.zip') AS export_name
 FROM {REC.sql} WHERE regexp_matches(artifact, 'CLICK|sign', 'i')""")
def stream_exports(spark, sf):
    out = scratch_path(spark, "exports")
    done = _stream(spark, sf, REC, "user_id", "event_id", "artifact", "ts", "host").select(
        F.col("user_id").alias("client_id"), F.concat(F.lit("F."), "event_id").alias("flow_id"),
        F.col("host").alias("fqdn"), F.array("artifact").alias("artifacts_with_results"), "ts")
    named = reactions.exports(done, "ts", "CLICK|sign", per_flow_folder=True)
    sink = named.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option(
        "path", f"{out}/rows").trigger(availableNow=True).start()
    _run(sink)
    return spark.read.schema("client_id bigint, flow_id string, export_name string").parquet(f"{out}/rows")


@query("STM-06 JN-10 FN-22", f"""
 SELECT user_id AS client_id, concat('F.', event_id) AS flow_id, concat('Host ', coalesce(c_name, cast(user_id AS varchar)),
   ' F.', event_id, ' ', strftime(ts, '%Y%m%d'), '.zip') AS export_name
 FROM {REC.sql} LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 <> 0 WHERE regexp_matches(artifact, 'CLICK|sign', 'i')""")
def stream_exports_named(spark, sf):
    """Completed flows as a stream, joined with the table of clients for their names."""
    out = scratch_path(spark, "exports-named")
    done = _stream(spark, sf, REC, "user_id", "event_id", "artifact", "ts").select(
        F.col("user_id").alias("client_id"), F.concat(F.lit("F."), "event_id").alias("flow_id"),
        F.array("artifact").alias("artifacts_with_results"), "ts")
    clients = table(spark, sf, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS client_id", "c_name AS fqdn")
    named = reactions.exports(done, "ts", "CLICK|sign", clients=clients)
    _run(named.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option(
        "path", f"{out}/rows").trigger(availableNow=True).start())
    return spark.read.schema("client_id bigint, flow_id string, export_name string").parquet(f"{out}/rows")


@query("STM-07 AG-04", f"""{_STATUS_STATE}
 SELECT status, count(*) AS packages, max(epoch(TIMESTAMP '2026-01-01') - epoch(entered))::BIGINT AS longest_seconds FROM s GROUP BY status""")
def stream_counters(spark, sf):
    out = scratch_path(spark, "counters")
    now = F.lit("2026-01-01").cast("timestamp")
    _run(status.follow_status(_status_changes(spark, sf), out, f"{out}/checkpoint"))
    return status.current_counters(spark, out, now)


@query("STM-08 STM-03", f"""
 SELECT package, 'unqueued' AS status, FALSE AS illegal FROM {PKG.sql} WHERE orderkey % 3 = 0
 UNION ALL SELECT package, 'failed', FALSE FROM {PKG.sql} WHERE orderkey % 3 <> 0""")
def stream_retry(spark, sf):
    out = scratch_path(spark, "retry")
    base = lambda: _stream(spark, sf, PKG, "package", "orderkey", "started_at").withColumn(
        "updated_at", F.col("started_at").cast("timestamp"))
    failed = base().select("package", F.lit("failed").alias("status"), "updated_at")
    retried = base().where("orderkey % 3 = 0").select(
        "package", F.lit("unqueued").alias("status"), F.lit("2030-01-01").cast("timestamp").alias("updated_at"))
    _run(status.follow_status(failed.union(retried), out, f"{out}/checkpoint"))
    return status.current(spark, out).select("package", "status", "illegal")
