"""Queries over totals, counters and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import documents, paths
from siftlake.operators import reports, schema
from siftlake.operators.skew import nearest_before
from siftlake.plans.base import PKG, POST_SQL, REC, UPL, post, query, stamp, stamp_sql, table

_PRICE = "cast(duration_in_sec AS decimal(18,2))"
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _size_sql(n: str) -> str:
    """Size as text; a size divided by a power of two is exact, so printf rounds half even."""
    return (f"CASE WHEN {n} < 1024 THEN concat({n}, ' B') WHEN {n} < 1048576 THEN printf('%.2f KB', {n} / 1024.0::double) "
            f"WHEN {n} < 1073741824 THEN printf('%.2f MB', {n} / 1048576.0::double) "
            f"ELSE printf('%.2f GB', {n} / 1073741824.0::double) END")


@query("AG-01", f"""
 SELECT package, host, cast(sum({_PRICE}) AS double) AS total_processing, cast(sum(size) AS bigint) AS total_size_bytes,
   count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS fail_count
 FROM {POST_SQL} GROUP BY package, host""")
def package_totals(spark, sf):
    return reports.package_totals(post(spark, sf), ["package", "host"])


@query("AG-02", f"""
 WITH t AS (SELECT package, artifact, grouping(artifact) AS g, cast(sum(size) AS bigint) AS output_size,
   sum({_PRICE}) AS d, count(*) FILTER (success) AS good, count(*) FILTER (NOT success) AS bad, count(*) AS n,
   max(returncode) AS rc FROM {POST_SQL} GROUP BY GROUPING SETS ((package, artifact), (package)))
 SELECT package, CASE g WHEN 1 THEN 'TOTALS' ELSE artifact END AS artifact, output_size,
   CASE WHEN d <> 0 THEN concat(d, ' sec') ELSE '' END AS duration,
   CASE WHEN g = 1 THEN concat(good, ' out of ', n) WHEN bad > 0 THEN 'FAILED' WHEN good > 0 THEN 'OK' ELSE '' END AS status,
   CASE g WHEN 0 THEN rc END AS returncode FROM t""")
def artifact_table_totals(spark, sf):
    return reports.artifact_table(post(spark, sf))


@query("AG-03 AG-09 FN-03", f"""
 WITH p AS (SELECT package, host, sum({_PRICE}) AS d, cast(sum(size) AS bigint) AS s,
     count(*) FILTER (success) AS good, count(*) FILTER (NOT success) AS bad FROM {POST_SQL} GROUP BY package, host),
 t AS (SELECT package, host, grouping(package) AS g, sum(d) AS d, cast(sum(s) AS bigint) AS s,
     cast(sum(good) AS bigint) AS good, cast(sum(bad) AS bigint) AS bad FROM p GROUP BY GROUPING SETS ((package, host), ()))
 SELECT package, host, concat(d, ' sec') AS total_duration, {_size_sql('s')} AS total_output,
   CASE g WHEN 0 THEN good END AS ok, CASE g WHEN 0 THEN bad END AS failed FROM t""")
def master_totals(spark, sf):
    return reports.master_table(reports.package_totals(post(spark, sf), ["package", "host"]))


@query("AG-04 FLT-02", f"""
 SELECT count(*) AS total, count(*) FILTER (status = 'finished') AS finished,
   count(*) FILTER (status IN ('processing', 'downloading', 'downloaded', 'postprocessing', 'uploading')) AS processing,
   count(*) FILTER (status = 'failed') AS failed FROM {PKG.sql} WHERE contains(lower(host), 'host-1')""")
def status_counters(spark, sf):
    from siftlake.operators import rules

    entries = PKG.df(spark, sf).where(rules.contains_text("Host-1", F.col("host")))
    return reports.status_counters(entries)


@query("AG-05", f"""
 WITH u AS (SELECT package, count(*) FILTER (upload_initiated AND upload_error IS NULL) AS uploads, 0 AS artifacts
   FROM {UPL.sql} GROUP BY package UNION ALL SELECT package, 0, count(*) FILTER (success AND error IS NULL)
   FROM {POST_SQL} GROUP BY package)
 SELECT package, cast(sum(artifacts) AS bigint) AS artifacts, cast(sum(uploads) AS bigint) AS uploads,
   concat('Package ', package, ' is done: ', sum(artifacts), ' artifacts run, ', sum(uploads), ' result files uploaded') AS message FROM u GROUP BY package""")
def notification_counts(spark, sf):
    return reports.notifications(UPL.df(spark, sf), post(spark, sf))


_CLASS = "CASE WHEN ignored_upload THEN 'ignored' WHEN upload_error IS NOT NULL OR NOT upload_initiated THEN 'failed' ELSE 'uploaded' END"


@query("AG-06", f"SELECT package, {_CLASS} AS upload_class, count(*) AS files FROM {UPL.sql} GROUP BY 1, 2")
def upload_classes(spark, sf):
    return reports.upload_classes(UPL.df(spark, sf), ["package"])


@query("AG-14", f"""
 SELECT count(*) FILTER (c = 'uploaded') AS initiated, count(*) FILTER (c = 'failed') AS failed,
   count(*) FILTER (c = 'ignored') AS skipped FROM (SELECT {_CLASS} AS c FROM {UPL.sql})""")
def upload_outcomes(spark, sf):
    return reports.upload_outcomes(UPL.df(spark, sf))


@query("AG-10 FN-05", "SELECT package, " + ", ".join(
    f"CASE WHEN count(*) FILTER (artifact = '{p}') > 0 THEN concat(sum({_PRICE}) FILTER (artifact = '{p}'), ' seconds') END AS {p}"
    for p in PART_TYPES) + f", concat(sum({_PRICE}), ' seconds') AS total FROM {POST_SQL} GROUP BY package")
def duration_summary(spark, sf):
    return reports.duration_summary(post(spark, sf), "artifact", PART_TYPES)


@query("ART-13", f"""
 WITH c(artifact) AS (VALUES ('click'), ('view'), ('login'), ('purchase'), ('shellbags')),
 h AS (SELECT DISTINCT host FROM {REC.sql}), n AS (SELECT host, artifact, count(*) AS n FROM {REC.sql} GROUP BY 1, 2)
 SELECT h.host, c.artifact, coalesce(n.n, 0) AS records FROM h CROSS JOIN c
   LEFT JOIN n ON n.host = h.host AND n.artifact = c.artifact""")
def artifact_coverage(spark, sf):
    wanted = ["click", "view", "login", "purchase", "shellbags"]
    return reports.coverage(REC.df(spark, sf), wanted)


@query("SNK-08", f"""
 SELECT host, CASE artifact WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
   count(*) AS messages FROM {REC.sql} WHERE artifact <> 'view' GROUP BY 1, 2""")
def run_log_levels(spark, sf):
    from siftlake.sources import sinks

    rec = REC.df(spark, sf)
    level = F.when(F.col("artifact") == "error", "ERROR").when(F.col("artifact") == "signup", "WARNING").when(
        F.col("artifact") == "view", "DEBUG").otherwise("INFO")
    logs = sinks.log_rows(rec, F.col("ts"), level, F.concat_ws(" ", "artifact", "value"), ["host"])
    return reports.log_levels(logs, ["host"], ["ERROR", "WARNING", "INFO"])


@query("SO-04 SO-05 JS-03 UD-02 FN-02", """
 WITH f AS (SELECT event_type AS name, min(event_id) AS first_pos FROM events GROUP BY 1)
 SELECT name, first_pos, name IN ('click', 'view') AS listed FROM f""")
def ordered_dedup(spark, sf):
    calls = table(spark, sf, "events").select(
        paths.artifact_call_name(F.concat("event_type", F.lit("(key='a')"))).alias("name"), "event_id")
    # one document per table, its two lists unfolded to rows
    lists = table(spark, sf, "region").select(
        F.lit('{"default": ["click()", "view(x=1)", "click()"], "skip": ["view()"]}').alias("doc"))
    listed = documents.artifact_list(lists, "doc").select(paths.artifact_call_name(F.col("call")).alias("name"))
    first = reports.first_seen(calls, "name", "event_id")
    known = listed.distinct().withColumn("listed", F.lit(True))
    missing = first.join(known, "name", "left_anti").withColumn("listed", F.lit(False))
    present = first.join(known, "name", "left_semi").withColumn("listed", F.lit(True))
    return present.unionByName(missing)


@query("JN-04", f"""
 WITH l AS (SELECT * FROM {REC.sql} WHERE artifact = 'error'), r AS (SELECT * FROM {REC.sql} WHERE artifact = 'click')
 SELECT l.event_id, l.host, count(r.event_id) AS near_count,
   last(r.event_id ORDER BY r.ts, r.event_id) AS near_event_id
 FROM l LEFT JOIN r ON r.host = l.host AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 6 HOUR GROUP BY 1, 2""")
def host_timeline(spark, sf):
    rec = REC.df(spark, sf).select("event_id", "host", "ts", "artifact")
    errors, clicks = rec.where("artifact = 'error'"), rec.where("artifact = 'click'")
    near = nearest_before(errors, clicks, "host", "ts", 6 * 3600, ["event_id"])
    return near.select("event_id", "host", "near_count", "near_event_id")


@query("JN-04 SO-03 FLT-06", f"""
 SELECT 'clicks' AS table_name, event_id, {stamp_sql('ts')} AS ts, value AS amount, cast(NULL AS varchar) AS detail
   FROM {REC.sql} WHERE host = 'host-7' AND artifact = 'click'
 UNION ALL SELECT 'errors', event_id, {stamp_sql('ts')}, NULL, props FROM {REC.sql}
   WHERE host = 'host-7' AND artifact = 'error'""")
def artifact_timeline(spark, sf):
    rec = REC.df(spark, sf).where("host = 'host-7'")
    clicks = rec.where("artifact = 'click'").select(
        F.lit("clicks").alias("table_name"), "event_id", "ts", F.col("value").alias("amount"))
    errors = rec.where("artifact = 'error'").select(
        F.lit("errors").alias("table_name"), "event_id", "ts", F.col("props").alias("detail"))
    both = schema.union_tables([clicks, errors])
    return both.orderBy("ts", "event_id").select("table_name", "event_id", stamp("ts"), "amount", "detail")
