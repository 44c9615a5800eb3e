"""Queries over listings, the status ledger and the run ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import documents, paths, text, times
from siftlake.operators import ledger, numbering, rules, splitting
from siftlake.operators.skew import lookup_join
from siftlake.plans.base import (MEM, PKG, POST_SQL, REC, UPL, View, lit_ntz, post, query, stamp, stamp_sql,
                                 table)
from siftlake.sources import packages

NOW = "1998-01-01 00:15:00"
LATER = "2030-01-01 00:00:05"  # after every start

# --- listing and gates -----------------------------------------------------------------------


@query("SRC-02 SRC-10 SO-01 AG-13", f"""
 SELECT CASE WHEN source IN ('1-URGENT', '2-HIGH') THEN 'blob' ELSE 'sftp' END AS source, count(*) AS packages,
   cast(sum(size) AS bigint) AS total_size FROM {PKG.sql} GROUP BY 1""")
def package_listing(spark, sf):
    listing = PKG.df(spark, sf).select("path", "size", "source")
    urgent = F.col("source").isin("1-URGENT", "2-HIGH")
    stores = {"blob": listing.where(urgent).drop("source"), "sftp": listing.where(~urgent).drop("source")}
    return packages.packages_per_source(packages.union_sources(stores))


@query("FLT-03 SRC-03 ST-05", f"""
 SELECT DISTINCT path FROM {PKG.sql}
 WHERE starts_with(regexp_extract(path, '[^/]*$'), 'pkg-1') AND ends_with(path, '7.zip')""")
def package_name_filter(spark, sf):
    listing = PKG.df(spark, sf).select("path")
    again = listing.where(F.col("path").contains("URGENT"))
    named = packages.filter_names(listing.unionByName(again), "path", "pkg-1", "7.zip")
    return packages.unique_packages(named)


RULES = rules.IgnoreRules(["Windows.Collected%2FUploads.json", "1?.json"], ["uploads/src1*", "results/*5*"])


@query("FLT-01 FN-09 FN-01", f"""
 WITH m AS (SELECT *, regexp_extract(member, '[^/]*$') AS basename FROM {MEM.sql}),
 d AS (SELECT *, CASE WHEN ends_with(member, '/') THEN 'directory'
   WHEN NOT (ends_with(member, '.json') OR ends_with(member, '.jsonl')) THEN 'not_json'
   WHEN size = 0 THEN 'empty'
   WHEN basename = 'Windows.Collected%2FUploads.json' THEN 'name_rule'
   WHEN regexp_full_match(basename, '1.[.]json') THEN 'name_rule'
   WHEN member LIKE 'uploads/src1%' THEN 'path_rule' WHEN member LIKE 'results/%5%' THEN 'path_rule' END AS reason
   FROM m)
 SELECT doc_id, package, member, basename, reason IS NOT NULL AS ignored_upload, reason AS ignored_reason,
   CASE reason WHEN 'name_rule' THEN CASE WHEN starts_with(basename, '1') THEN '1?.json'
       ELSE 'Windows.Collected%2FUploads.json' END
     WHEN 'path_rule' THEN CASE WHEN starts_with(member, 'uploads/src1') THEN 'uploads/src1*' ELSE 'results/*5*' END
   END AS ignored_pattern FROM d""")
def ignore_decisions(spark, sf):
    return rules.with_ignore_decision(MEM.df(spark, sf), RULES).drop("size", "encrypted")


@query("FLT-05 FLT-14", f"""
 SELECT package, bool_or(starts_with(member, 'uploads/')) AS raw_evidence, bool_or(encrypted) AS is_encrypted
 FROM {MEM.sql} GROUP BY package""")
def raw_evidence_gate(spark, sf):
    return packages.has_raw_evidence(MEM.df(spark, sf).select("package", "member", "encrypted"))


@query("FLT-06 FLT-07 ST-03", f"""
 SELECT event_id, {stamp_sql('ts')} AS ts, artifact, value FROM {REC.sql} WHERE host = 'host-7'
   AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 100""")
def host_time_filter(spark, sf):
    rec = REC.df(spark, sf)
    hit = rec.where((F.col("host") == "host-7") & times.time_range(
        F.col("ts"), lit_ntz("2024-01-05"), lit_ntz("2024-01-20")))
    return hit.orderBy("ts", "event_id").limit(100).select("event_id", stamp("ts"), "artifact", "value")


@query("FLT-08 FLT-09", f"""
 SELECT event_id, artifact, host FROM {REC.sql} WHERE ts > TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-21'
   AND regexp_matches(artifact, 'CLICK|^vie', 'i') AND regexp_matches(host, 'T-1.$', 'i')""")
def exclusive_bounds(spark, sf):
    bounds = times.within(F.col("ts"), lit_ntz("2024-01-03 12:00:00"), lit_ntz("2024-01-21"))
    rec = REC.df(spark, sf).where(
        bounds & rules.matches(F.col("artifact"), "CLICK|^vie") & rules.matches(F.col("host"), "T-1.$"))
    return rec.select("event_id", "artifact", "host")


@query("FLT-02 ST-01 PRJ-06", f"""
 SELECT substr(md5(package), 1, 8) AS row_key, package, c_name AS host, status, source, upload_id,
   CASE WHEN size <> 0 THEN size END AS size, {stamp_sql('started_at')} AS started_at
 FROM {PKG.sql} LEFT JOIN customer ON custkey = c_custkey
 WHERE lower(status) = 'new' AND (contains(lower(package), '#00000012') OR contains(lower(coalesce(c_name, '')), '#00000012'))""")
def status_search(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS custkey", "c_name AS host")
    entries = lookup_join(PKG.df(spark, sf).drop("host"), customers, ["custkey"])
    entries = entries.withColumn("row_key", text.short_key(F.col("package")))
    hit = entries.where(rules.has_status(F.col("status"), "NEW") & rules.contains_text(
        "#00000012", F.col("package"), F.col("host")))
    return ledger.entry_view(hit).withColumn("started_at", stamp("started_at"))


_KNOWN = f"(SELECT package, status FROM {PKG.sql} WHERE orderkey % 2 = 0)"


@query("FLT-04 JN-01", f"""
 SELECT p.package, l.package IS NULL AS is_new, coalesce(l.status IN ('new', 'unqueued'), FALSE) AS process
 FROM {PKG.sql} p LEFT JOIN {_KNOWN} l ON p.package = l.package""")
def processing_gate(spark, sf):
    listing = PKG.df(spark, sf).select("package")
    known = PKG.df(spark, sf).where("orderkey % 2 = 0").select("package", "status")
    new = ledger.new_packages(listing, known).select("package", F.lit(True).alias("_new"))
    gated = ledger.processing_gate(listing, known)
    return lookup_join(gated, new, ["package"]).select("package", F.coalesce("_new", F.lit(False)).alias("is_new"), "process")


@query("FLT-11 FLT-12 FLT-13", f"""
 SELECT package, member, upload_error FROM {UPL.sql}
 WHERE upload_error IS NOT NULL AND contains(lower(member), '/1') AND regexp_full_match(package, '[A-Za-z0-9._-]+')""")
def failed_entries(spark, sf):
    failed = UPL.df(spark, sf).where(F.col("upload_error").isNotNull() & rules.safe_id(F.col("package")))
    return failed.where(rules.contains_text("/1", F.col("member"))).select("package", "member", "upload_error")


@query("FLT-12 SNK-08", f"SELECT path FROM {PKG.sql} WHERE status = 'processing'")
def entries_in_status(spark, sf):
    return ledger.with_status(PKG.df(spark, sf), "processing", "path")


# --- joins ---------------------------------------------------------------------------------------


@query("JN-02 AG-08 FN-07", f"""
 SELECT f.package, f.upload_id, CASE WHEN v.upload_id IS NOT NULL THEN 'confirmed'
   WHEN started_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE THEN 'timeout' ELSE 'pending' END AS confirmation
 FROM {PKG.sql} f LEFT JOIN (SELECT DISTINCT concat('id', substr(md5(package), 1, 8)) AS upload_id FROM {UPL.sql}
   WHERE upload_error IS NOT NULL) v ON f.upload_id = v.upload_id WHERE status = 'finished'""")
def confirm_uploads(spark, sf):
    finished = PKG.df(spark, sf).where("status = 'finished'").select(
        "package", "upload_id", F.col("started_at").alias("updated_at"))
    visible = UPL.df(spark, sf).where("upload_error IS NOT NULL").select(
        F.concat(F.lit("id"), text.short_key(F.col("package"))).alias("upload_id"))
    return ledger.confirm(finished, visible, lit_ntz(NOW)).drop("updated_at")


@query("JN-03", f"""
 SELECT p.package AS zipfile, p.upload_id AS uploadid, p.source, coalesce(u.n, 0) AS upload_rows,
   coalesce(u.initiated, 0) AS initiated, coalesce(u.ignored, 0) AS ignored, coalesce(r.n, 0) AS artifact_rows,
   coalesce(r.good, 0) AS artifacts_ok, coalesce(r.bad, 0) AS artifacts_failed
 FROM {PKG.sql} p
 LEFT JOIN (SELECT package, count(*) AS n, count(*) FILTER (upload_initiated) AS initiated,
   count(*) FILTER (ignored_upload) AS ignored FROM {UPL.sql} GROUP BY package) u ON p.package = u.package
 LEFT JOIN (SELECT package, count(*) AS n, count(*) FILTER (success) AS good, count(*) FILTER (NOT success) AS bad
   FROM {POST_SQL} GROUP BY package) r ON p.package = r.package""")
def ledger_join(spark, sf):
    key = lambda df: df.withColumn("uploadid", F.concat(
        F.lit("id"), text.short_key(F.col("package")))).withColumnRenamed("package", "zipfile")
    summary = PKG.df(spark, sf).select(F.col("package").alias("zipfile"), F.col("upload_id").alias("uploadid"), "source")
    return ledger.run_ledger_join(
        summary,
        key(UPL.df(spark, sf).select("package", "upload_initiated", "ignored_upload")),
        key(post(spark, sf).select("package", "success")))


# --- status -----------------------------------------------------------------------------------------


_GENERATIONS = """
 SELECT package, 'new' AS status, started_at AS updated_at, 1 AS seq, cast(NULL AS varchar) AS host, size FROM {pkg}
 UNION ALL SELECT package, 'queued', started_at, 2, NULL, NULL FROM {pkg} WHERE orderkey % 3 <> 0
 UNION ALL SELECT package, 'finished', started_at + INTERVAL 5 MINUTE, 3, host, NULL FROM {pkg} WHERE orderkey % 5 = 0"""


def _generations(spark, sf):
    pkg = PKG.df(spark, sf)
    first = pkg.select("package", F.lit("new").alias("status"), F.col("started_at").alias("updated_at"),
                       F.lit(1).alias("seq"), F.lit(None).cast("string").alias("host"), "size")
    queued = pkg.where("orderkey % 3 <> 0").select(
        "package", F.lit("queued").alias("status"), F.col("started_at").alias("updated_at"), F.lit(2).alias("seq"))
    done = pkg.where("orderkey % 5 = 0").select(
        "package", F.lit("finished").alias("status"),
        (F.col("started_at") + F.make_dt_interval(mins=F.lit(5))).alias("updated_at"), F.lit(3).alias("seq"), "host")
    return ledger.union_ledgers(first, queued, done)


@query("WN-03 FN-08", f"""
 WITH g AS ({_GENERATIONS.format(pkg=PKG.sql)}),
 r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY updated_at DESC, seq DESC) AS rn FROM g)
 SELECT package, substr(md5(package), 1, 8) AS row_key, status, {stamp_sql('updated_at')} AS updated_at, host
 FROM r WHERE rn = 1""")
def latest_status(spark, sf):
    current = ledger.latest(_generations(spark, sf))
    return current.select("package", text.short_key(F.col("package")).alias("row_key"), "status",
                          stamp("updated_at"), "host")


@query("WN-03", f"""
 WITH g AS ({_GENERATIONS.format(pkg=PKG.sql)})
 SELECT package, arg_max(status, seq) AS status, max(host) AS host, max(size) AS size,
   {stamp_sql('max(updated_at)')} AS updated_at FROM g GROUP BY package""")
def merged_status(spark, sf):
    current = ledger.latest(_generations(spark, sf), merge=True)
    return current.select("package", "status", "host", "size", stamp("updated_at"))


@query("PRJ-04 FN-08", f"""
 SELECT package, substr(md5(package), 1, 8) AS row_key, upload_id, status, session, source, '1m 5s' AS duration,
   '{NOW}.000000' AS updated_at, {stamp_sql('started_at')} AS started_at, '' AS host, size FROM {PKG.sql}""")
def status_entries(spark, sf):
    rows = ledger.status_entry(PKG.df(spark, sf).drop("host"), F.col("status"),
                               text.duration_ms(F.lit(65.9)), lit_ntz(NOW))
    return rows.withColumns({"updated_at": stamp("updated_at"), "started_at": stamp("started_at")})


@query("STM-08 WN-03", f"""
 SELECT package, CASE WHEN orderkey % 7 = 0 THEN 'unqueued' ELSE status END AS status, host FROM {PKG.sql}""")
def retry_requeue(spark, sf):
    events = PKG.df(spark, sf).select("package", "status", "host", F.col("started_at").alias("updated_at"))
    selected = PKG.df(spark, sf).where("orderkey % 7 = 0").select("package")
    retried = ledger.requeue(events, selected, lit_ntz("2030-01-01"))
    merged = ledger.latest(ledger.union_ledgers(events, retried), order=("updated_at",), merge=True)
    return merged.select("package", "status", "host")


@query("FN-06 FN-04", f"""
 WITH s AS (SELECT *, date_diff('second', started_at, TIMESTAMP '{LATER}') AS d FROM {PKG.sql})
 SELECT package, CASE WHEN status = 'finished' THEN CASE WHEN orderkey % 2 = 0 THEN '0h 5m 0s' ELSE '-' END
   ELSE concat(cast(floor(d / 3600.0) AS bigint), 'h ', cast(floor(d / 60.0) AS bigint) % 60, 'm ', d % 60, 's') END AS elapsed
 FROM s""")
def run_duration(spark, sf):
    runs = PKG.df(spark, sf)
    stored = F.when(F.col("orderkey") % 2 == 0, text.duration_hms(F.lit(300)))
    return runs.select("package", times.run_duration(
        F.col("status"), stored, F.col("started_at"), lit_ntz(LATER)).alias("elapsed"))


# --- packing and splitting ----------------------------------------------------------------------------


@query("WN-01", f"""
 WITH k AS (SELECT source, package, size, CASE WHEN size >= 250000000 THEN 'large' ELSE 'small' END AS batch_kind
   FROM {PKG.sql} WHERE status = 'new'),
 n AS (SELECT *, row_number() OVER (PARTITION BY batch_kind ORDER BY source, package) - 1 AS i FROM k)
 SELECT source, package, size, batch_kind,
   cast(CASE batch_kind WHEN 'large' THEN i ELSE floor(i / 20.0) END AS bigint) AS batch_no FROM n""")
def batch_packing(spark, sf):
    todo = PKG.df(spark, sf).where("status = 'new'").select("source", "package", "size")
    return numbering.pack_batches(todo, ["source", "package"], threshold=250_000_000)


@query("JS-01 JS-02 WN-01", f"""
 SELECT package AS triagepackage, source AS source_name FROM {PKG.sql} WHERE status = 'new'
 UNION ALL SELECT package, source FROM {PKG.sql} WHERE status = 'processing'""")
def queue_roundtrip(spark, sf):
    pkg = PKG.df(spark, sf)
    batches = numbering.pack_batches(
        pkg.where("status = 'new'").select("source", "package", "size"), ["source", "package"], threshold=250_000_000)
    item = F.struct(F.col("package").alias("triagepackage"), F.col("source").alias("source_name"))
    # a batch holds at most 20 packages
    messages = batches.groupBy("batch_kind", "batch_no").agg(
        documents.encode_message(F.collect_list(item)).alias("message")).select("message")
    single = pkg.where("status = 'processing'").select(F.base64(F.to_json(item).cast("binary")).alias("message"))
    return messages.unionByName(single).select(F.inline(documents.decode_message(F.col("message"))))


_LINES = View("documents", {"file": "source", "line_no": "doc_id", "size": "n_chars + 1"})
_TARGET = 20_000


@query("WN-02 SNK-06", f"""
 WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM {_LINES.sql}),
 g AS (SELECT file, line_no, size, rn, size AS used, cast(1 AS bigint) AS part FROM n WHERE rn = 1
   UNION ALL SELECT n.file, n.line_no, n.size, n.rn,
     CASE WHEN g.used + n.size > {_TARGET} THEN n.size ELSE g.used + n.size END,
     g.part + CASE WHEN g.used + n.size > {_TARGET} THEN 1 ELSE 0 END
   FROM g JOIN n ON n.file = g.file AND n.rn = g.rn + 1)
 SELECT file, line_no, size, part FROM g""")
def byte_split(spark, sf):
    lines = _LINES.df(spark, sf)
    block = 1024
    last = lines.agg(F.max("line_no")).first()[0]
    return splitting.greedy_parts(lines, _TARGET, max_file_blocks=last // block + 1, block=block)


@query("WN-02", f"""
 SELECT file, line_no, size, cast(floor((sum(size) OVER (PARTITION BY file ORDER BY line_no) - size) / {_TARGET}.0)
   AS bigint) + 1 AS part FROM {_LINES.sql}""")
def byte_split_even(spark, sf):
    return splitting.even_parts(_LINES.df(spark, sf), _TARGET)


# --- run ledgers ------------------------------------------------------------------------------------------


@query("PRJ-02 PRJ-03 PRJ-05", f"""
 SELECT p.package AS zipfile, p.upload_id AS uploadid, p.path AS zipfile_fullpath, p.size AS zipfile_size,
   p.session AS sessionid, p.source AS source_name, m.encrypted AS is_encrypted, p.host AS hostname,
   cast(NULL AS double) AS duration_in_sec
 FROM {PKG.sql} p LEFT JOIN (SELECT package, bool_or(encrypted) AS encrypted FROM {MEM.sql} GROUP BY package) m
   ON p.package = m.package""")
def summary_rows(spark, sf):
    base = PKG.df(spark, sf).select(
        F.col("package").alias("zipfile_basename"), F.col("path").alias("zipfile_fullpath"),
        F.col("size").alias("zipfile_size"), F.col("session").alias("sessionid"),
        F.col("upload_id").alias("uploadid"), F.col("source").alias("source_name"),
        F.col("started_at").alias("starttime_script"), F.col("host").alias("hostname"))
    infos = packages.has_raw_evidence(MEM.df(spark, sf)).select(
        F.col("package").alias("zipfile_basename"), "is_encrypted")
    runs = ledger.summary_rows(base, infos).select(F.struct(*ledger.SUMMARY.names).alias("summary"))
    flat = ledger.flatten_summary(runs)
    return flat.drop("zipfile_basename", "starttime_script", "started_postprocessing")


@query("PRJ-02 PRJ-05 PRJ-07 FN-24", f"""
 SELECT concat('id', substr(md5(package), 1, 8)) AS uploadid, package AS zipfile, artifact,
   CASE WHEN size < 1024 THEN CASE WHEN size = 0 THEN '-' ELSE concat(size, ' B') END
     ELSE concat(cast(round(cast(size AS decimal(20,6)) / 1024, 1) AS decimal(18,1)), ' KB') END AS size,
   CASE WHEN success THEN 'Yes' ELSE 'No' END AS success,
   concat(cast(round(cast(duration_in_sec AS decimal(18,6)), 1) AS decimal(18,1)), 's') AS duration,
   coalesce(error, '-') AS error FROM {POST_SQL}""")
def run_details(spark, sf):
    from siftlake.operators import reports

    rows = post(spark, sf)
    item = F.struct(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in ledger.POSTPROCESSING.fields])
    # the nested form of a run, one artifact per document here, flattened again
    runs = rows.select(
        F.struct(F.concat(F.lit("id"), text.short_key(F.col("package"))).alias("uploadid"),
                 F.col("package").alias("zipfile_basename")).alias("summary"),
        F.array(item).alias("postprocessing"))
    return reports.run_detail(ledger.flatten(runs, "postprocessing"))
