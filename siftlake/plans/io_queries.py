"""Sources and sinks, written from the test tables and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from siftlake.functions import paths, text
from siftlake.operators import ledger, rules, schema, splitting
from siftlake.plans.base import MEM, PKG, POST_SQL, UPL, post, query, stamp, stamp_sql, table
from siftlake.session import scratch_path
from siftlake.sources import packages, records, sinks

# --- packages -------------------------------------------------------------------------------------

_PER_PACKAGE = 20
#: Bytes of text that a task packs, about: whoever opens packages may get all of a task's at once.
_TASK_BYTES = 8 << 20


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One zip of a few documents: some with the evidence in an inner archive, some cut short."""
    number = int(key[0])
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        for r in pdf.sort_values("doc_id").itertuples():
            z.writestr(f"uploads/doc-{r.doc_id}.txt", r.text)
            z.writestr(f"results/{r.source}/doc-{r.doc_id}.jsonl", r.line + "\n" + r.line + "\n")
        if number % 3 == 0:
            z.writestr("client_info.json", f'{{"hostname": "host-{number}", "os_info": {{"fqdn": "x"}}}}')
        if number % 3 == 1:
            z.writestr("client_info.json", f'{{"hostname": "", "os_info": {{"fqdn": "host-{number}.corp"}}}}')
    content = inner.getvalue()
    if number % 5 == 1:
        outer = io.BytesIO()
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("metadata.json", "{}")
            z.writestr("data.zip", content)
        content = outer.getvalue()
    if number % 17 == 16:
        content = content[: len(content) // 2]
    return pd.DataFrame({"package": [f"pkg-{number}.zip"], "content": [content]})


def _packages(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "text", F.to_json(F.struct("doc_id", "text")).alias("line"),
        F.floor(F.col("doc_id") / _PER_PACKAGE).cast("bigint").alias("n"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, size // _TASK_BYTES + 1)
    return docs.repartition(tasks, "n").groupBy("n").applyInPandas(_pack, "package string, content binary")


_N = f"(doc_id // {_PER_PACKAGE})"
_READABLE = f"{_N} % 17 <> 16"


@query("SRC-01 SRC-04 SRC-06 SRC-10", f"""
 SELECT concat('pkg-', {_N}, '.zip') AS package, concat('uploads/doc-', doc_id, '.txt') AS member,
   cast(strlen(text) AS bigint) AS size, CASE WHEN {_N} % 5 = 1 THEN 'data.zip' END AS container, FALSE AS failed
 FROM documents WHERE {_READABLE}
 UNION ALL SELECT concat('pkg-', {_N}, '.zip'), concat('results/', source, '/doc-', doc_id, '.jsonl'), NULL,
   CASE WHEN {_N} % 5 = 1 THEN 'data.zip' END, FALSE FROM documents WHERE {_READABLE}
 UNION ALL SELECT DISTINCT concat('pkg-', {_N}, '.zip'), 'client_info.json', cast(NULL AS bigint),
   CASE WHEN {_N} % 5 = 1 THEN 'data.zip' END, FALSE FROM documents WHERE {_READABLE} AND {_N} % 3 <> 2
 UNION ALL SELECT DISTINCT concat('pkg-', {_N}, '.zip'), NULL, cast(NULL AS bigint), NULL, TRUE FROM documents
   WHERE NOT ({_READABLE})""")
def zip_inventory(spark, sf):
    members = packages.member_inventory(_packages(spark, sf))
    size = F.when(F.col("member").endswith(".txt"), F.col("size"))
    return members.select("package", "member", size.alias("size"), "container",
                          F.col("error").isNotNull().alias("failed"))


@query("SRC-05 SRC-06 SRC-07", f"""
 SELECT concat('pkg-', {_N}, '.zip') AS package, doc_id, md5(text) AS digest, 2 AS lines FROM documents
 WHERE {_READABLE}""")
def zip_records(spark, sf):
    lines = packages.package_lines(_packages(spark, sf)).where("error is null")
    rec = records.parsed(lines.where(F.col("member").startswith("results/")))
    rows = rec.select("package", F.try_variant_get("record", "$.doc_id", "bigint").alias("doc_id"),
                      F.md5(F.try_variant_get("record", "$.text", "string")).alias("digest"))
    return rows.groupBy("package", "doc_id", "digest").agg(F.count("*").cast("int").alias("lines"))


@query("SRC-09", f"""
 SELECT DISTINCT concat('pkg-', {_N}, '.zip') AS package, CASE WHEN {_READABLE} AND {_N} % 3 = 0 THEN concat('host-', {_N})
   WHEN {_READABLE} AND {_N} % 3 = 1 THEN concat('host-', {_N}, '.corp') WHEN {_N} % 2 = 0 THEN concat('reg-', {_N})
   ELSE '' END AS host FROM documents""")
def package_hosts(spark, sf):
    number = F.floor(F.col("doc_id") / _PER_PACKAGE).cast("bigint")
    registry = table(spark, sf, "documents").select(number.alias("n")).distinct().where("n % 2 = 0").select(
        F.concat(F.lit("pkg-"), "n", F.lit(".zip")).alias("package"), F.concat(F.lit("reg-"), "n").alias("registry_host"))
    return packages.package_hosts(packages.client_infos(_packages(spark, sf)), registry)


# --- record files ------------------------------------------------------------------------------------


@query("SRC-07 SRC-08 SNK-07 PRJ-01 FLT-01", f"""
 SELECT event_id, event_type, value, {stamp_sql('ts')} AS ts, concat('ev_', event_type) AS table_name,
   'host-a' AS src_host, 'folder' AS src_package, 'id7' AS src_upload FROM events WHERE event_type <> 'error'""")
def jsonl_folder(spark, sf):
    out = scratch_path(spark, "folder")
    events = table(spark, sf, "events").withColumn("kind", F.col("event_type")).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    events.write.partitionBy("kind").json(out)
    lines = records.read_jsonl(spark, out, recursive=True, glob="*.json")
    decision = rules.ignore_decision(F.col("file"), F.col("file_size"), rules.IgnoreRules(paths=["*/kind=error/*"]))
    kept = records.parsed(lines.where(~decision["ignored"]))
    fields = [schema.FieldType(*f) for f in [
        ("event_id", "long"), ("event_type", "string"), ("value", "real"), ("ts", "datetime")]]
    folder = F.regexp_extract("file", "/kind=([^/]+)/", 1)
    typed = kept.select(*schema.typed_columns(F.col("record"), fields),
                        paths.table_name(F.concat(folder, F.lit(".jsonl")), "ev_").alias("table_name"))
    typed = typed.withColumn("ts", stamp("ts"))
    return records.with_lineage(typed, F.lit("host-a"), F.lit("folder"), F.lit("id7"))


@query("SNK-06 WN-02", """
 WITH RECURSIVE n AS (SELECT source AS file, doc_id, strlen(text) + 1 AS size, row_number() OVER (
     PARTITION BY source ORDER BY doc_id) AS rn FROM (SELECT source, doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents)),
 g AS (SELECT file, size, rn, size AS used, 1 AS part FROM n WHERE rn = 1
   UNION ALL SELECT n.file, n.size, n.rn, CASE WHEN g.used + n.size > 50000 THEN n.size ELSE g.used + n.size END,
     g.part + CASE WHEN g.used + n.size > 50000 THEN 1 ELSE 0 END FROM g JOIN n ON n.file = g.file AND n.rn = g.rn + 1)
 SELECT file, cast(part AS bigint) AS part, count(*) AS lines, cast(sum(size) AS bigint) AS bytes FROM g GROUP BY 1, 2""")
def byte_split_files(spark, sf):
    out = scratch_path(spark, "parts")
    line = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").alias("line_no"), line.alias("line"))
    sizes = docs.select("file", "line_no", splitting.line_bytes(F.col("line")).alias("size"))
    last = docs.agg(F.max("line_no")).first()[0]
    parts = splitting.greedy_parts(sizes, 50_000, max_file_blocks=last // 1024 + 1, block=1024)
    splitting.write_parts(docs.join(parts.drop("size"), ["file", "line_no"]), out)
    back = spark.read.schema("value string, file string, part bigint").text(out)
    return back.groupBy("file", "part").agg(
        F.count("*").alias("lines"), F.sum(splitting.line_bytes(F.col("value"))).cast("bigint").alias("bytes"))


# --- artifact tables -----------------------------------------------------------------------------------


@query("SNK-01 SCH-04 SCH-06 SCH-08 SCH-09 SRC-07", """
 SELECT concat('ev_', event_type) AS table_name, event_id, user_id, value, cast(NULL AS varchar) AS note,
   concat('host-', user_id % 3) AS src_host FROM events
 UNION ALL SELECT 'ev_click', event_id, CASE WHEN event_id % 2 = 0 THEN user_id END, NULL, concat('n', event_id),
   'host-9' FROM events WHERE event_type = 'click'""")
def table_ingest(spark, sf):
    out = scratch_path(spark, "tables")
    store = sinks.ArtifactTables(spark, f"{out}/tables", prefix="ev_")
    events = table(spark, sf, "events")

    def lines(df, host):
        return df.select(F.concat(F.lit("ev_"), "event_type").alias("table_name"), F.col("event_type").alias("file"),
                         F.col("event_id").alias("pos"), "line", host.alias("host"), F.lit("p.zip").alias("package"),
                         F.lit("id1").alias("upload"))

    first = events.withColumn("line", F.to_json(F.struct("event_id", "user_id", "value")))
    sinks.ingest(lines(first, F.concat(F.lit("host-"), (F.col("user_id") % 3).cast("string"))), store, f"{out}/raw1")
    # the second load adds a column and gives another type to user_id: even ids still fit it
    changed = F.concat(F.when(F.col("event_id") % 2 == 0, "").otherwise("u"), "user_id")
    second = events.where("event_type = 'click'").withColumn("line", F.to_json(F.struct(
        "event_id", changed.alias("user_id"), F.concat(F.lit("n"), "event_id").alias("note"))))
    sinks.ingest(lines(second, F.lit("host-9")), store, f"{out}/raw2")
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]  # the artifact types
    loaded = [store.read(f"ev_{k}").withColumn("table_name", F.lit(f"ev_{k}")) for k in sorted(kinds)]
    return schema.union_tables(loaded).select("table_name", "event_id", "user_id", "value", "note", "src_host")


def _runs(spark, sf):
    """Run documents: summary plus one upload and one artifact entry per row."""
    upload = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in UPL.columns and f.name != "location_in_zip"
                        else F.col("member" if f.name == "location_in_zip" else f.name).cast(f.dataType).alias(f.name)
                        for f in ledger.UPLOAD.fields])
    summary = F.struct(*[F.col("package").alias("zipfile_basename") if f.name == "zipfile_basename" else
                         F.concat(F.lit("id"), text.short_key(F.col("package"))).alias("uploadid") if f.name == "uploadid"
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in ledger.SUMMARY.fields])
    empty = [F.array().cast(t).alias(n) for n, t in [
        ("postprocessing", ledger.RUN["postprocessing"].dataType), ("logs", ledger.RUN["logs"].dataType)]]
    return UPL.df(spark, sf, wide=True).select(summary.alias("summary"), F.array(upload).alias("uploads"), *empty)


@query("SNK-02 PRJ-02", f"""
 SELECT concat('id', substr(md5(package), 1, 8)) AS uploadid, package AS zipfile, member AS location_in_zip, basename, size,
   upload_initiated, ignored_upload, upload_error FROM {UPL.sql}""")
def ledger_roundtrip(spark, sf):
    out = scratch_path(spark, "ledgers")
    sinks.write_run_ledgers(_runs(spark, sf), out)
    return spark.read.parquet(f"{out}/uploads").select(
        "uploadid", "zipfile", "location_in_zip", "basename", "size", "upload_initiated", "ignored_upload", "upload_error")


@query("SNK-03", f"""
 SELECT concat('u', orderkey) AS upload_id, 'summary' AS section, concat('pkg-', orderkey, '.zip') AS package,
   CASE WHEN orderkey % 2 = 0 THEN 'finished' ELSE 'uploading' END AS state,
   strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') AS started FROM {PKG.sql}""")
def snapshot_roundtrip(spark, sf):
    out = scratch_path(spark, "snapshots")
    pkg = PKG.df(spark, sf).withColumn("uploadid", F.concat(F.lit("u"), "orderkey"))
    live = pkg.withColumn("state", F.lit("uploading")).select("uploadid", "package", "state", "started_at")
    sinks.write_snapshots(sinks.snapshot_documents(live, "summary"), out, 1)
    done = pkg.where("orderkey % 2 = 0").withColumn("state", F.lit("finished")).select(*live.columns)
    sinks.write_snapshots(sinks.snapshot_documents(done, "summary"), out, 2)
    doc = lambda n: F.get_json_object("document", f"$.{n}")
    return sinks.read_snapshots(spark, out).select(
        "upload_id", "section", doc("package").alias("package"), doc("state").alias("state"),
        doc("started_at").alias("started"))


@query("SNK-04 SNK-05 SNK-07 AG-01", f"""
 SELECT package, cast(sum(cast(duration_in_sec AS decimal(18,2))) AS double) AS total_processing,
   cast(sum(size) AS bigint) AS total_size_bytes, concat('a "quoted", ', package) AS note FROM {POST_SQL} GROUP BY package""")
def csv_roundtrip(spark, sf):
    from siftlake.operators import reports

    out = scratch_path(spark, "csv")
    totals = reports.package_totals(post(spark, sf), ["package"]).select(
        "package", "total_processing", "total_size_bytes", F.concat(F.lit('a "quoted", '), "package").alias("note"))
    sinks.export_csv(totals, f"{out}/export")
    back = spark.read.schema(totals.schema).option("header", True).option("escape", '"').csv(f"{out}/export")
    half = F.xxhash64("package") % 2 == 0
    sinks.append_csv(back.where(half).drop("note"), f"{out}/master")
    sinks.append_csv(back.where(~half).drop("note"), f"{out}/master")
    master = spark.read.schema("package string, total_processing double, total_size_bytes bigint").option(
        "header", True).csv(f"{out}/master")
    return master.join(back.select("package", "note"), "package")


@query("SNK-07 SNK-05", f"""
 SELECT package, status, upload_id FROM {PKG.sql}""")
def format_roundtrip(spark, sf):
    out = scratch_path(spark, "formats")
    rows = PKG.df(spark, sf).select(
        "package", "status", F.struct("upload_id").alias("run"))
    sinks.write_format(rows, f"{out}/csv", "csv")
    csv = spark.read.option("header", True).option("escape", '"').schema("package string, status string, run string").csv(
        f"{out}/csv").select("package", "status", F.get_json_object("run", "$.upload_id").alias("upload_id"))
    sinks.write_format(csv, f"{out}/jsonl", "jsonl")
    return spark.read.schema(csv.schema).json(f"{out}/jsonl")
