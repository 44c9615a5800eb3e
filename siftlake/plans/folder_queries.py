"""Archives and folders written from the test tables, then listed, opened, loaded and processed."""

from __future__ import annotations

import datetime
import io
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import artifacts, intake
from siftlake.functions import documents, paths, times
from siftlake.operators import rules, schema
from siftlake.plans.base import query, stamp, stamp_sql, table
from siftlake.session import scratch_path
from siftlake.sources import packages, sinks
from siftlake.streaming import delivery, discovery

_PER_PACKAGE = 50
_N = f"(doc_id // {_PER_PACKAGE})"
_STORE = f"CASE WHEN {_N} % 2 = 0 THEN 'blob' ELSE 'share' END"
_READABLE = f"{_N} % 7 <> 6"
_HOST = f"CASE WHEN {_N} % 3 = 0 THEN concat('host-', {_N}) ELSE '' END"
_TABLE = "concat('tri_', coalesce(source, 'none'))"
#: Rows of a file of collected events, about.
_FILE_ROWS = 20_000
NOW = datetime.datetime(2026, 1, 1)


def _archive(number: int, rows: pd.DataFrame) -> bytes:
    """Records by source; some archives hold an inner one, some are cut short."""
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        ordered = sorted(zip(rows["source"], rows["doc_id"], rows["line"]), key=lambda r: r[:2])
        for source, part in groupby(ordered, key=lambda r: r[0]):
            z.writestr(f"results/{source}.jsonl", "".join(line + "\n" for _, _, line in part))
        z.writestr("uploads/raw.bin", b"raw")
        if number % 3 == 0:
            z.writestr(packages.CLIENT_INFO, f'{{"hostname": "host-{number}"}}')
    data = content.getvalue()
    if number % 5 == 1:
        outer = io.BytesIO()
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("data.zip", data)
        data = outer.getvalue()
    return data[:len(data) // 2] if number % 7 == 6 else data


def _written(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        _, scheme, path = packages.store_of(folder)
        system, base = fs.FileSystem.from_uri(f"{scheme}:{path}")
        for batch in batches:
            for row in batch.itertuples():
                place = f"{base}/{row.store}"
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/{row.name}") as out:
                    out.write(row.content)
            yield batch[["name"]]

    return write


def _archives(spark: SparkSession, sf: str, folder: str) -> None:
    """Packages of 50 documents each in the folders `blob` and `share`, as files."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        store = "blob" if number % 2 == 0 else "share"
        return pd.DataFrame({"store": [store], "name": [f"pkg-{number}.zip"], "content": [_archive(number, rows)]})

    docs = table(spark, sf, "documents").select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.to_json(F.struct("doc_id", "text")).alias("line"),
        F.floor(F.col("doc_id") / _PER_PACKAGE).cast("bigint").alias("n"))
    files = docs.groupBy("n").applyInPandas(pack, "store string, name string, content binary")
    notes = spark.createDataFrame([("blob", "notes.txt", b"no package"), ("share", "other.zipx", b"no package")], files.schema)
    files.unionByName(notes).mapInPandas(_written(folder), "name string").count()


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    return packages.list_sources(spark, {"blob": f"{folder}/blob", "share": f"{folder}/share"})


@query("SRC-01 SRC-02 SRC-10 AG-13", f"""
 SELECT DISTINCT concat('pkg-', {_N}, '.zip') AS package, {_STORE} AS source, TRUE AS has_bytes,
   (SELECT count(DISTINCT {_N}) FROM documents d WHERE {_STORE.replace('doc_id', 'd.doc_id')} = {_STORE.replace('doc_id', 'documents.doc_id')}) AS in_source
 FROM documents""")
def store_listing(spark, sf):
    out = scratch_path(spark, "stores")
    _archives(spark, sf, out)
    listing = _listing(spark, out)
    totals = packages.packages_per_source(listing).select("source", F.col("packages").alias("in_source"))
    return listing.join(F.broadcast(totals), "source").select(
        paths.basename(F.col("path")).alias("package"), "source", (F.col("size") > 0).alias("has_bytes"), "in_source")


@query("SRC-03 SO-01 ST-05", f"""
 SELECT DISTINCT concat('pkg-', {_N}, '.zip') AS package FROM documents WHERE {_N} % 2 = 0 OR {_N} % 10 = 1""")
def package_patterns(spark, sf):
    out = scratch_path(spark, "patterns")
    _archives(spark, sf, out)
    # one folder as a whole and some names of the other; names of both are found once
    found = packages.find_packages(spark, [f"{out}/blob/*", f"{out}/blob/pkg-*", f"{out}/share/pkg-1.z*", f"{out}/share/pkg-*1.zip"])
    return found.select(paths.basename(F.col("path")).alias("package"))


_LOADED = f"""
 SELECT {_TABLE} AS table_name, doc_id, md5(text) AS digest, {_HOST} AS src_host, concat('pkg-', {_N}, '.zip') AS src_package
 FROM documents WHERE {_READABLE}"""


def _loaded(spark: SparkSession, root: str) -> DataFrame:
    store = sinks.ArtifactTables(spark, f"{root}/tables", prefix="tri_")
    rows = schema.union_tables([store.read(name, columns).withColumn("table_name", F.lit(name)) for name, columns in sorted(store.all_columns().items())])
    return rows.select("table_name", "doc_id", F.md5("text").alias("digest"), "src_host", "src_package")


@query("SRC-02 SRC-04 SRC-05 SRC-06 SRC-09 SNK-01 FLT-04", _LOADED)
def package_intake(spark, sf):
    """Two calls of one session, the second over all packages: the first ones are not loaded again."""
    out = scratch_path(spark, "intake")
    _archives(spark, sf, f"{out}/in")
    listing = _listing(spark, f"{out}/in").withColumnRenamed("path", "package")
    ignore = rules.IgnoreRules(paths=["uploads/*", packages.CLIENT_INFO])
    for part in (listing.where("source = 'blob'"), listing):
        intake.intake_packages(spark, part, f"{out}/root", "s1", ignore, "tri_", now=NOW)
    return _loaded(spark, f"{out}/root")


@query("PRJ-03 SNK-02 AG-01 AG-10 UD-05 STM-03", f"""
 WITH p AS (SELECT {_N} AS n, count(DISTINCT source) AS tables, count(*) AS docs FROM documents GROUP BY 1)
 SELECT concat('pkg-', n, '.zip') AS package, CASE WHEN n % 7 <> 6 THEN 'finished' ELSE 'failed' END AS status, TRUE AS timed,
   CASE WHEN n % 7 <> 6 THEN 1 ELSE 0 END::BIGINT AS succeeded, CASE WHEN n % 7 <> 6 THEN 1 ELSE 0 END::BIGINT AS failed,
   CASE WHEN n % 7 <> 6 THEN tables ELSE 0 END::BIGINT AS uploads, n % 7 <> 6 AS postprocessed FROM p""")
def intake_facts(spark, sf):
    """Durations, upload times and post-processing rows that the intake writes of itself."""
    out = scratch_path(spark, "facts")
    root = f"{out}/root"
    _archives(spark, sf, f"{out}/in")
    artifacts.register("LongTexts", lambda rows, least=1000: rows.where(F.length("text") >= least), ["rows"],
                       [artifacts.registry.Parameter("least", 1000, "int")])

    def post(store):
        rows = schema.union_tables([store.read(name, columns) for name, columns in sorted(store.all_columns().items())])
        return [("LongTexts", {"least": 500}), ("LongTexts", {"no_such_parameter": 1})], {"rows": rows}

    listing = _listing(spark, f"{out}/in").withColumnRenamed("path", "package")
    ignore = rules.IgnoreRules(paths=["uploads/*", packages.CLIENT_INFO])
    uploads = intake.intake_packages(spark, listing, root, "s1", ignore, "tri_", now=NOW, post=post)
    ledgers = {name: spark.read.parquet(f"{root}/ledgers/{name}") for name in ("summary", "postprocessing")}
    done = ledgers["postprocessing"].groupBy(F.col("zipfile").alias("package")).agg(
        F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
    sent = uploads.where("upload_initiated AND upload_duration_in_sec >= 0 AND upload_initiated_timestamp > 0").groupBy(
        F.col("zipfile").alias("package")).agg(F.count("*").alias("uploads"))
    status = intake.current_status(spark, root).select("package", "status", F.col("duration").alias("shown"))
    rows = ledgers["summary"].withColumnRenamed("zipfile_basename", "package").join(status, "package").join(done, "package", "left").join(sent, "package", "left")
    return rows.select("package", "status", ((F.col("duration_in_sec") > 0) & F.col("shown").isNotNull()).alias("timed"),
                       *[F.coalesce(c, F.lit(0)).alias(c) for c in ("succeeded", "failed", "uploads")],
                       F.col("started_postprocessing").isNotNull().alias("postprocessed"))


@query("SRC-08 SNK-01 SNK-07 FLT-01", f"""
 SELECT concat('ev_', event_type) AS table_name, event_id, value, {stamp_sql('ts')} AS ts, 'host-f' AS src_host, 'collected' AS src_package
 FROM events WHERE event_type <> 'error'""")
def folder_intake(spark, sf):
    out = scratch_path(spark, "folder-intake")
    folder = f"{out}/collected"
    events = table(spark, sf, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    # Each type is dealt out to folders of about _FILE_ROWS rows, so that no task holds a whole type.
    largest = events.groupBy("event_type").count().agg(F.max("count")).scalar()
    folders = F.greatest(F.ceil(largest / F.lit(_FILE_ROWS)), F.lit(1)).cast("bigint")
    line = F.to_json(F.struct("event_id", "value", "ts"))
    files = events.select(F.concat("event_type", F.lit(".jsonl")).alias("name"), line.alias("line"), "event_id").withColumn(
        "store", F.concat(F.lit("part-"), F.pmod(F.xxhash64("event_id", "line"), folders).cast("string")))

    def one_file(rows: pd.DataFrame) -> pd.DataFrame:
        lines = "".join(line + "\n" for line in rows.sort_values("event_id")["line"])
        return pd.DataFrame({"store": [rows["store"].iloc[0]], "name": [rows["name"].iloc[0]], "content": [lines.encode()]})

    made = files.groupBy("store", "name").applyInPandas(one_file, "store string, name string, content binary")
    info = spark.createDataFrame([("", packages.CLIENT_INFO, b'{"os_info": {"fqdn": "host-f"}}')], made.schema)
    made.unionByName(info).mapInPandas(_written(folder), "name string").count()
    intake.intake_folder(spark, folder, f"{out}/root", "s1", True, rules.IgnoreRules(paths=["*error.jsonl"]), "ev_")
    store = sinks.ArtifactTables(spark, f"{out}/root/tables", prefix="ev_")
    rows = schema.union_tables([store.read(name, columns).withColumn("table_name", F.lit(name)) for name, columns in sorted(store.all_columns().items())])
    return rows.select("table_name", "event_id", "value", stamp("ts"), "src_host", "src_package")


@query("STM-01 STM-02 SRC-05 SRC-06 FLT-04", f"""
 SELECT DISTINCT concat('pkg-', {_N}, '.zip') AS package, CASE WHEN {_READABLE} THEN 'finished' ELSE 'failed' END AS status,
   CASE WHEN {_READABLE} THEN 1 ELSE 3 END AS attempts, cast(CASE WHEN {_READABLE} THEN 0 ELSE 3 END AS bigint) AS failures,
   CASE WHEN {_READABLE} THEN count(*) OVER (PARTITION BY {_N}) ELSE 0 END AS records
 FROM documents""")
def triggered_processing(spark, sf):
    """New archives are found by a stream and processed; broken ones are tried three times."""
    out = scratch_path(spark, "triggered")
    root = f"{out}/root"
    _archives(spark, sf, f"{out}/in")
    messages = discovery.listing_stream(spark, f"{out}/in", "store")
    settings = {"ignore": rules.IgnoreRules(paths=["uploads/*", packages.CLIENT_INFO]), "prefix": "tri_"}
    delivery.follow(messages, root, "s1", f"{out}/checkpoint", NOW, **settings).awaitTermination()
    # before the lease ends nothing is due; after it the broken packages are tried again
    for seconds in (10, 31, 62, 93):
        delivery.poll(spark, root, "s1", NOW + datetime.timedelta(seconds=seconds), **settings)
    tries = delivery.outcomes(spark, root).groupBy(paths.basename(F.col("package")).alias("package")).agg(
        F.max("attempts").alias("attempts"), F.max_by("outcome", "attempts").alias("status"))
    entries = spark.read.schema(intake.STATUS).parquet(f"{root}/_status/*/*")
    failures = entries.where("status = 'failed'").groupBy("package").agg(F.count("*").alias("failures"))
    records = _loaded(spark, root).groupBy(F.col("src_package").alias("package")).agg(F.count("*").alias("records"))
    return tries.join(failures, "package", "left").join(records, "package", "left").select(
        "package", "status", "attempts", F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("records", F.lit(0)).alias("records"))


# --- layout ----------------------------------------------------------------------------------------


@query("FLT-06 FLT-07 SNK-01", f"""
 SELECT event_id, concat('host-', user_id % 20) AS src_host, {stamp_sql('ts')} AS ts, value FROM events, (SELECT min(ts) AS first FROM events) AS f
 WHERE user_id % 20 = 7 AND ts >= first + INTERVAL 1 DAY AND ts < first + INTERVAL 20 DAY""")
def clustered_filter(spark, sf):
    """A table loaded in ranges of (host, time), and the question its layout is for."""
    out = scratch_path(spark, "clustered")
    store = sinks.ArtifactTables(spark, f"{out}/tables", "ev_", cluster=("src_host", "ts"))
    events = table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")))
    sinks.ingest(events.select(
        F.lit("ev_all").alias("table_name"), F.lit("all").alias("file"), F.col("event_id").alias("pos"), line.alias("line"),
        F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"), F.lit("p.zip").alias("package"),
        F.lit("id1").alias("upload")), store, f"{out}/raw")
    first = events.agg(F.min("ts").cast("timestamp")).scalar()
    day = lambda n: F.make_dt_interval(days=F.lit(n))
    rows = store.read("ev_all").where(F.col("src_host") == "host-7").where(
        times.time_range(F.col("ts"), first + day(1), first + day(20)))
    return rows.select("event_id", "src_host", stamp("ts"), "value")


# --- artifact lists ------------------------------------------------------------------------------

_BRANDS = "SELECT p_brand, count(*) AS parts, min(p_partkey) AS first_part FROM part GROUP BY p_brand"


@query("JS-03 UD-01 UD-02 UD-03", f"""
 WITH b AS ({_BRANDS}), d AS (SELECT *, replace(p_brand, '#', '_') AS name FROM b WHERE parts % 3 <> 0)
 SELECT name AS artifact, count(*) AS rows, cast(min(p_size) AS int) AS smallest, row_number() OVER (ORDER BY first_part) AS position
 FROM d JOIN part USING (p_brand) WHERE p_size >= 10 GROUP BY name, first_part""")
def artifact_selection(spark, sf):
    """Artifacts named by the table, listed in documents made from it, registered and run as the lists say."""
    part = table(spark, sf, "part")
    call = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("()"))
    brands = part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part")).withColumn("call", call)
    entry = F.struct("first_part", "call")
    document = brands.agg(F.to_json(F.struct(*[  # one document, a name for each brand
        F.transform(F.array_sort(F.collect_list(F.when(chosen, entry))), lambda e: e["call"]).alias(category)
        for category, chosen in (("default", F.col("parts") % 3 != 0), ("skip", F.col("parts") % 3 == 0))])).alias("doc"))
    rows = documents.artifact_list(document, "doc").orderBy("category", "position").collect()  # the lists of a registry
    lists: dict[str, list[str]] = {"default": [], "skip": []}
    for row in rows:  # a repeated entry and one that is known already change nothing
        lists[row["category"]] += [row["call"]] * 2
        lists = artifacts.add_to_list(lists, row["call"].removesuffix("()"))
    calls = artifacts.selected(lists)
    for name in (c.removesuffix("()") for c in calls):
        brand = name.replace("_", "#")
        artifacts.register(name, lambda parts, least, brand=brand: parts.where((F.col("p_brand") == brand) & (F.col("p_size") >= least)),
                           ["part"], [artifacts.registry.Parameter("least", 10, "int")])
    described = {name for name, parameter, default, kind in artifacts.registry.describe() if (parameter, default, kind) == ("least", "10", "int")}
    out = scratch_path(spark, "selection")
    ran = artifacts.collect(spark, [(c.removesuffix("()"), {}) for c in calls if c.removesuffix("()") in described], {"part": part}, out)
    order = spark.createDataFrame([(c.removesuffix("()"), i) for i, c in enumerate(calls, 1)], "artifact string, position bigint")
    results = spark.read.schema(part.schema).parquet(*[r["fullpath"] for r in ran.where("success").collect()])  # one an artifact
    found = results.groupBy(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")).alias("artifact")).agg(
        F.count("*").alias("rows"), F.min("p_size").cast("int").alias("smallest"))
    return found.join(F.broadcast(order), "artifact").select("artifact", "rows", "smallest", "position")
