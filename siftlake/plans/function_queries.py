"""Queries over the scalar functions: each works on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.artifacts.system import ACCOUNT_TYPES, FLAG_NAMES
from siftlake.functions import binary, documents, paths, text, times
from siftlake.plans.base import PKG, REC, query, spread_scan, stamp, stamp_sql, table


@query("FN-10 FN-11 FN-12", f"""
 SELECT event_id, {stamp_sql('ts')} AS ts, {stamp_sql('ts')} AS ts_words, event_id * 7 % 65536 AS low16,
   event_id * 7 AS u32, -event_id - 1 AS i64 FROM events""")
def filetime_decode(spark, sf):
    ticks = binary.filetime_ticks(F.col("ts").cast("timestamp"))
    raw = spread_scan(table(spark, sf, "events").select("event_id", "ts")).select(
        "event_id",
        F.concat(F.lit(b"\x00" * 4), binary.pack_le(ticks, 8), binary.pack_le(F.col("event_id") * 7, 4),
                 binary.pack_le(-F.col("event_id") - 1, 8)).alias("blob"))
    b = F.col("blob")
    words = binary.filetime_words(binary.uint32(b, 8), binary.uint32(b, 4))
    out = raw.select(
        "event_id", binary.filetime(binary.int64(b, 4)).alias("ts"), words.alias("ts_words"),
        binary.uint16(b, 12).alias("low16"), binary.uint32(b, 12).alias("u32"), binary.int64(b, 16).alias("i64"))
    return out.select("event_id", stamp("ts"), stamp("ts_words"), "low16", "u32", "i64")


@query("FN-12", """
 SELECT p_partkey, p_partkey * 3 % 65536 AS u16, (p_partkey * 1000003) % 4294967296 AS u32,
   cast(18446744073709551615 - cast(p_partkey AS decimal(20,0)) AS varchar) AS u64 FROM part""")
def integer_decode(spark, sf):
    k = F.col("p_partkey")
    blob = F.concat(binary.pack_le(k * 3 % 65536, 2), binary.pack_le((k * 1000003) % 4294967296, 4),
                    binary.pack_le(-k - 1, 8))
    raw = table(spark, sf, "part").select("p_partkey", blob.alias("b"))
    return raw.select("p_partkey", binary.uint16(F.col("b"), 0).alias("u16"), binary.uint32(F.col("b"), 2).alias("u32"),
                      binary.uint64(F.col("b"), 6).cast("string").alias("u64"))


_FLAGS_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN (p_size * 41) & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(FLAG_NAMES)) + ")"


@query("FN-13 FN-14", f"""
 SELECT p_partkey, {_FLAGS_SQL} AS flags, CASE p_size WHEN 11 THEN 'Custom Limited Acct' WHEN 12 THEN 'Default Admin User'
   WHEN 13 THEN 'Default Guest Acct' ELSE cast(p_size AS varchar) END AS kind FROM part""")
def flags_decode(spark, sf):
    size = F.col("p_size")
    code = F.when(size == 11, 212).when(size == 12, 188).when(size == 13, 176).otherwise(size)
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(",", binary.flag_names(size * 41, FLAG_NAMES)).alias("flags"),
        binary.choice(code, ACCOUNT_TYPES).alias("kind"))


@query("FN-15", """
 SELECT concat('c-', c_custkey) AS id, c_name AS at_offset, c_name AS to_nul FROM customer
 UNION ALL SELECT concat('d-', doc_id), md5(text), md5(text) FROM documents""")
def utf16_decode(spark, sf):
    def decoded(df, shown):
        packed = binary.pack_utf16(F.col("t"))
        blob = F.concat(F.lit(b"\x01\x02\x03"), packed, F.lit(b"\x00\x00"), F.lit(b"\x41\x00"))
        rows = df.select("id", blob.alias("b"), F.length(packed).alias("n"), F.concat(
            packed, F.lit(b"\x00\x00"), F.lit(b"\x41\x00")).alias("c"))
        return rows.select("id", shown(binary.utf16(F.col("b"), 3, F.col("n"))).alias("at_offset"),
                           shown(binary.utf16_cstring(F.col("c"))).alias("to_nul"))

    customers = table(spark, sf, "customer").selectExpr("concat('c-', c_custkey) AS id", "c_name AS t")
    docs = table(spark, sf, "documents").selectExpr("concat('d-', doc_id) AS id", "text AS t")
    return decoded(customers, lambda c: c).unionByName(decoded(docs, F.md5))


_ROT_SQL = ("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', "
            "'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')")


@query("FN-16", f"""
 SELECT concat('p-', p_partkey) AS id, {_ROT_SQL.format('p_name')} AS rotated FROM part
 UNION ALL SELECT concat('d-', doc_id), md5({_ROT_SQL.format('text')}) FROM documents""")
def rot13_names(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat(F.lit("p-"), "p_partkey").alias("id"), binary.rot13(F.col("p_name")).alias("rotated"))
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("d-"), "doc_id").alias("id"), F.md5(binary.rot13(F.col("text"))).alias("rotated"))
    return part.unionByName(docs)


_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("FN-17 FN-18 FN-20 FN-25", f"""
 SELECT page_id, url AS decoded, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
   regexp_extract(rtrim({_URL_PATH}, '/'), '[^/]*$') AS last_segment, regexp_extract(url, '[?]([^#]*)', 1) AS query_text,
   split_part(url, '/', -2) AS before_last, split_part(url, '/', 4) AS third,
   regexp_extract(url, '/([a-z][a-z])/', 1) AS lang FROM pages""")
def url_decode_paths(spark, sf):
    url = F.col("url")
    encoded = F.concat(F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")),
                                 F.lit(":"), F.lit("%3A")))
    return table(spark, sf, "pages").select(
        "page_id", paths.url_decode(encoded).alias("decoded"), paths.url_host(url).alias("host"),
        paths.url_last_segment(url).alias("last_segment"), paths.url_query(url).alias("query_text"),
        paths.component(url, -2).alias("before_last"), paths.component(url, 3).alias("third"),
        F.regexp_extract(url, "/([a-z][a-z])/", 1).alias("lang"))


@query("FN-01", f"""
 SELECT package, path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS dir,
   '.zip' AS ext, regexp_replace(package, '[.]zip$', '') AS stem FROM {PKG.sql}""")
def path_parts(spark, sf):
    p = F.col("path")
    return PKG.df(spark, sf).select("package", "path", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"),
                                    paths.extension(p).alias("ext"), paths.stem(p).alias("stem"))


@query("FN-21 FN-22 FN-23 FN-24 FN-19", """
 SELECT c_custkey, lower(hex(encode(c_name))) AS hex_name,
   CASE c_nationkey % 3 WHEN 0 THEN concat('triage/', c_name, '-2026.zip') WHEN 1 THEN concat(c_name, '-2026.zip')
     ELSE concat('x/y/', c_name, '-2026.zip') END AS upload_name,
   concat('F.', c_custkey, '/Host ', c_name, ' F.', c_custkey, ' 2026.zip') AS export_name,
   CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SYSTEM' ELSE c_mktsegment END AS account,
   concat(CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE '' END, c_mktsegment) AS joined,
   CASE WHEN c_nationkey % 5 = 0 THEN '-' WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS shown,
   cast(c_custkey AS varchar) AS rid FROM customer""")
def hex_values(spark, sf):
    name, nation = F.col("c_name"), F.col("c_nationkey")
    prefix = F.when(nation % 3 == 0, "triage/").when(nation % 3 == 2, "x/y")
    flow = F.concat(F.lit("F."), "c_custkey")
    account = F.when(F.col("c_mktsegment") == "MACHINERY", "systemprofile").otherwise(F.col("c_mktsegment"))
    flag = F.when(nation % 5 != 0, F.col("c_acctbal") > 0)
    return table(spark, sf, "customer").select(
        "c_custkey", binary.hex_text(name.cast("binary")).alias("hex_name"),
        text.upload_name(prefix, name, F.lit("2026")).alias("upload_name"),
        text.flow_export_name(name, flow, F.lit("2026"), per_flow_folder=True).alias("export_name"),
        text.account_display_name(account).alias("account"),
        text.null_safe_concat(F.when(nation % 2 == 0, name), F.col("c_mktsegment")).alias("joined"),
        text.display_bool(flag).alias("shown"),
        paths.rid(F.concat(F.lit("S-1-5-21-"), "c_custkey")).alias("rid"))


def _short_sql(n: str) -> str:
    def unit(power: int, name: str) -> str:
        return f"concat(cast(round(cast({n} AS decimal(30,10)) / {1024 ** power}, 1) AS decimal(20,1)), ' {name}')"

    return (f"CASE WHEN {n} = 0 THEN '-' WHEN {n} < 1024 THEN concat({n}, ' B') WHEN {n} < 1048576 THEN {unit(1, 'KB')} "
            f"WHEN {n} < 1073741824 THEN {unit(2, 'MB')} ELSE {unit(3, 'GB')} END")


def _report_sql(n: str) -> str:
    return (f"CASE WHEN {n} < 1024 THEN concat({n}, ' B') WHEN {n} < 1048576 THEN printf('%.2f KB', {n} / 1024.0::double) "
            f"WHEN {n} < 1073741824 THEN printf('%.2f MB', {n} / 1048576.0::double) "
            f"ELSE printf('%.2f GB', {n} / 1073741824.0::double) END")


@query("FN-03 FN-04 FN-05", f"""
 SELECT package, {_short_sql('size')} AS short_size, {_report_sql('size')} AS report_size,
   concat(size // 3600000000, 'h ', size // 60000000 % 60, 'm ', size // 1000000 % 60, 's') AS hms,
   concat(size // 60000000, 'm ', size // 1000000 % 60, 's') AS ms,
   concat(size // 60000000, ':', lpad(cast(size // 1000000 % 60 AS varchar), 2, '0')) AS clock,
   concat(cast(cast(size AS decimal(20,2)) / 100 AS decimal(18,2)), ' seconds') AS seconds
 FROM {PKG.sql}""")
def display_texts(spark, sf):
    size = F.col("size")
    secs = size / 1_000_000
    return PKG.df(spark, sf).select(
        "package", text.size_text_short(size).alias("short_size"), text.size_text(size).alias("report_size"),
        text.duration_hms(secs).alias("hms"), text.duration_ms(secs).alias("ms"),
        text.duration_clock(secs).alias("clock"), text.seconds_text(size / 100).alias("seconds"))


@query("FN-07", f"""
 SELECT event_id, CASE event_id % 3 WHEN 0 THEN {stamp_sql('ts')} WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00.000000')
   ELSE '0001-01-01 00:00:00.000000' END AS parsed FROM events""")
def tolerant_times(spark, sf):
    t = F.col("ts")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(
        F.col("event_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "HH:mm"))
    rows = table(spark, sf, "events").select("event_id", times.parse_time(given).alias("parsed"))
    return rows.select("event_id", stamp("parsed"))


@query("JS-04 JS-07", """
 SELECT event_id, concat('host-', user_id, '.corp') AS fqdn, cast(json_extract(props, '$.k') AS bigint) AS k,
   CASE WHEN event_id % 2 = 0 THEN 'Primary Domain Controller' END AS role FROM events""")
def nested_objects(spark, sf):
    info = F.to_json(F.struct(F.struct(F.concat(F.lit("host-"), "user_id", F.lit(".corp")).alias("fqdn")).alias("os_info"),
                              F.from_json("props", "struct<k:bigint>").alias("props"),
                              F.struct(F.when(F.col("event_id") % 2 == 0, "Primary Domain Controller").alias(
                                  "DomainRole")).alias("Computer Info")))
    doc = F.col("doc")
    return spread_scan(table(spark, sf, "events")).select("event_id", info.alias("doc")).select(
        "event_id", documents.nested(doc, "os_info", "fqdn").alias("fqdn"),
        documents.nested(doc, "props", "k").cast("bigint").alias("k"),
        documents.nested(doc, "Computer Info", "DomainRole").alias("role"))


@query("JS-05 JS-06 JS-08", f"""
 SELECT event_id, concat(user_id, ',', event_id) AS numbers, CASE WHEN user_id <> 3 THEN concat('v', user_id) END AS first_entry
 FROM {REC.sql}""")
def number_lists(spark, sf):
    blob = F.concat(binary.pack_le(F.col("user_id"), 4), F.lit(b"\xff\xff\xff\xff"),
                    binary.pack_le(F.col("event_id"), 4), F.lit(b"\xff\xff\xff\xff"))
    blobs = REC.df(spark, sf, wide=True).select("event_id", blob.alias("b"))
    rows = blobs.select("event_id", binary.uint32_list(F.col("b"), drop=4294967295).alias("n"))
    entries = F.transform("n", lambda v: F.when(v == 3, F.lit("")).otherwise(F.concat(F.lit("v"), v.cast("string"))))
    return rows.select("event_id", F.concat_ws(",", F.transform("n", lambda v: v.cast("string"))).alias("numbers"),
                       documents.null_if_first_empty(entries)[0].alias("first_entry"))
