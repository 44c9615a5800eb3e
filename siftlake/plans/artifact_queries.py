"""Queries over the artifacts. The evidence is packed from the test tables row by row, so
the work of every query grows with them, and decoding has to give the packed values back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake import artifacts
from siftlake.artifacts import execution, system, userhives
from siftlake.functions import binary, documents, paths
from siftlake.operators.rules import any_matches
from siftlake.operators.skew import lookup_join, one_per_key
from siftlake.plans.base import MEM, REC, USR_SQL, query, spread_scan, stamp, stamp_sql, table, usr
from siftlake.session import scratch_path

_USER_ONCE = f"(SELECT sid, min(name) AS name FROM {USR_SQL} GROUP BY sid)"


def _ts():
    return F.col("ts").cast("timestamp")


@query("JN-05 FN-19", f"""
 SELECT event_id, concat('S-1-5-21-', user_id) AS sid, cast(user_id AS varchar) AS rid, u.name FROM {REC.sql} r
 LEFT JOIN {_USER_ONCE} u ON u.sid = concat('S-1-5-21-', user_id)""")
def sid_to_user(spark, sf):
    rec = REC.df(spark, sf).select("event_id", F.concat(F.lit("S-1-5-21-"), "user_id").alias("sid"))
    named = lookup_join(rec, one_per_key(usr(spark, sf), ["sid"], F.col("name")), ["sid"])
    return named.select("event_id", "sid", paths.rid(F.col("sid")).alias("rid"), "name")


_ACCOUNTS_SQL = """(SELECT concat('S-1-5-21-', c_custkey) AS sid, c_name AS username, c_mktsegment AS description,
 cast(c_custkey AS varchar) AS uid, CASE WHEN c_acctbal >= 0 THEN concat('C:/Users/', c_name) END AS directory FROM customer)"""


def _accounts(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat('S-1-5-21-', c_custkey) AS sid", "c_name AS name", "c_mktsegment AS description",
        "cast(c_custkey AS string) AS uid", "'' AS gid",
        "CASE WHEN c_acctbal >= 0 THEN concat('C:/Users/', c_name) END AS directory")


@query("ART-04 JN-06", f"""
 SELECT event_id, r.sid, artifact AS name, value, a.username, a.description, a.uid, '' AS gid, a.directory
 FROM (SELECT *, concat('S-1-5-21-', user_id) AS sid FROM {REC.sql}) r JOIN {_ACCOUNTS_SQL} a ON a.sid = r.sid
 WHERE a.directory IS NOT NULL AND regexp_matches(a.username, '#0000000[0-9]+[02468]$', 'i')""")
def user_hive_values(spark, sf):
    values = REC.df(spark, sf).select(
        "event_id", F.concat(F.lit("S-1-5-21-"), "user_id").alias("sid"), F.col("artifact").alias("name"), "value")
    return userhives.nt_user(values, _accounts(spark, sf), user_regex="#0000000[0-9]+[02468]$")


@query("ART-01 FLT-09 FLT-08", f"""
 SELECT {stamp_sql('ts')} AS timestamp, concat(artifact, '.txt') AS filename,
   concat(CASE WHEN user_id % 2 = 0 THEN 'C:' ELSE 'D:' END, '/', host, '/', artifact, '.txt') AS os_path,
   event_id AS mft_id, user_id AS parent_mft_id, event_id AS usn FROM {REC.sql}
 WHERE ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28' AND regexp_matches(artifact, 'CLI|ERR', 'i')
   AND regexp_matches(cast(event_id AS varchar), '[0-4]$') AND regexp_matches(cast(user_id AS varchar), '^[1-3]')
   AND regexp_matches(concat('/', host, '/'), 'HOST-[0-9]+/', 'i')""")
def usn_changes(spark, sf):
    journal = REC.df(spark, sf).select(
        F.when(F.col("user_id") % 2 == 0, "C:").otherwise("D:").alias("drive"),
        F.col("ts").alias("timestamp"), F.concat("artifact", F.lit(".txt")).alias("filename"),
        F.concat(F.lit("/"), "host", F.lit("/"), "artifact", F.lit(".txt")).alias("os_path"),
        F.array(F.concat(F.lit("/"), "host", F.lit("/")), F.lit("x")).alias("links"), F.lit("create").alias("reason"),
        F.col("event_id").alias("mft_id"), F.lit(1).alias("sequence"), F.col("user_id").alias("parent_mft_id"),
        F.lit(1).alias("parent_sequence"), F.lit("ARCHIVE").alias("file_attributes"),
        F.lit("").alias("source_info"), F.col("event_id").alias("usn"))
    out = execution.usn(journal, file_name_regex="CLI|ERR", path_regex="HOST-[0-9]+/", mft_id_regex="[0-4]$",
                        parent_mft_id_regex="^[1-3]", date_after="2024-01-02", date_before="2024-01-28")
    return out.select(stamp("timestamp"), "filename", "os_path", "mft_id", "parent_mft_id", "usn")


@query("ART-02 JN-05 FN-10", f"""
 SELECT concat('S-1-5-21-', user_id) AS sid, u.name AS username, concat(artifact, event_id, '.exe') AS binary,
   {stamp_sql('ts')} AS bam_time FROM {REC.sql} LEFT JOIN {_USER_ONCE} u ON u.sid = concat('S-1-5-21-', user_id)
 WHERE event_id % 5 <> 0""")
def bam_executions(spark, sf):
    values = REC.df(spark, sf, wide=True).select(
        F.concat(F.lit("S-1-5-21-"), "user_id").alias("sid"),
        F.concat("artifact", "event_id", F.lit(".exe")).alias("binary"),
        binary.pack_le(binary.filetime_ticks(_ts()), 8).alias("value"),
        F.when(F.col("event_id") % 5 == 0, "DWORD").otherwise("REG_BINARY").alias("data_type"))
    out = execution.bam(values, usr(spark, sf))
    return out.withColumn("bam_time", stamp("bam_time"))


@query("ART-03 ST-04 FN-16", f"""
 SELECT concat('App\\', artifact, '.lnk') AS name, concat('host-', user_id) AS "user", {stamp_sql('ts')} AS last_execution,
   cast(floor(epoch(ts)) AS bigint) AS last_execution_ts, event_id AS executions FROM {REC.sql}
 WHERE regexp_matches(host, 'HOST-[1-5]', 'i') AND ts > TIMESTAMP '2024-01-10'""")
def userassist(spark, sf):
    encoded = binary.rot13(F.concat(F.lit("App\\"), "artifact", F.lit(".lnk")))
    key = F.concat(F.lit("HKEY_USERS\\S\\UserAssist\\{0}\\Count\\"), F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit('"'), encoded, F.lit('"'))).otherwise(encoded))
    zeros = F.lit(b"\x00" * 52)
    blob = F.concat(F.lit(b"\x00" * 4), binary.pack_le(F.col("event_id"), 4), zeros,
                    binary.pack_le(binary.filetime_ticks(_ts()), 8))
    values = REC.df(spark, sf, wide=True).select(key.alias("key_path"), blob.alias("value"), F.col("host").alias("username"))
    out = execution.user_assist(values, user_filter="HOST-[1-5]", execution_time_after="2024-01-10")
    return out.select("name", "user", stamp("last_execution"), "last_execution_ts", "executions")


# Each embedding is a list of the record numbers 0..63 ordered by value.
@query("ART-05 JN-07 JS-05 JS-06 JS-08 AG-11", """
 WITH i AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS n FROM embeddings),
 k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, n) AS pos FROM i WHERE n % 7 <> 3),
 m AS (SELECT vec_id, string_agg(concat(n, ' := doc', n, '-', vec_id, '.txt'), '|' ORDER BY pos) AS entries,
   count(*) AS items FROM k GROUP BY vec_id)
 SELECT concat('hive-', vec_id) AS hive, concat('.t', label) AS type,
   CASE WHEN vec_id % 9 = 0 THEN NULL ELSE entries END AS entries, concat('user', label) AS username
 FROM embeddings JOIN m USING (vec_id) WHERE vec_id % 9 = 0 OR regexp_matches(entries, 'DOC', 'i')""")
def recent_docs(spark, sf):
    emb = spread_scan(table(spark, sf, "embeddings")).select(
        F.concat(F.lit("hive-"), "vec_id").alias("hive"), F.concat(F.lit(".t"), "label").alias("type"), "vec_id",
        F.concat(F.lit("user"), "label").alias("username"), F.lit("S-1-5-21-7").alias("sid"), F.lit("k").alias("key"),
        F.lit("2024-01-05").cast("timestamp").alias("mtime"), F.lit("BINARY").alias("data_type"),
        F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("n"))).alias("e"))
    keep = F.filter("e", lambda s: s["n"] % 7 != 3)
    order = F.transform(F.array_sort(keep), lambda s: s["n"])
    hexes = F.transform(order, lambda n: F.hex(binary.pack_le(n, 4)))
    head = F.when(F.col("vec_id") % 9 == 0, "FE000000").otherwise("")  # a list that starts with a missing item
    lists = emb.withColumn("value", F.unhex(F.concat(head, F.concat_ws("", hexes), F.lit("FFFFFFFF")))).withColumn(
        "name", F.lit("MRUListEx"))
    items = emb.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("n")).withColumn(
        "name", F.col("n").cast("string")).withColumn("value", F.concat(binary.pack_utf16(F.concat(
            F.lit("doc"), "n", F.lit("-"), "vec_id", F.lit(".txt"))), F.lit(b"\x00\x00\x99\x00")))
    values = lists.drop("e").unionByName(items.drop("e", "n"))
    out = userhives.recent_docs(values, date_after="2024-01-01", date_before="2024-02-01",
                                user_regex="USER", sid_regex="-7$", entry_regex="DOC|NULL")
    joined = F.when(F.col("mru_entries").isNotNull(), F.concat_ws("|", "mru_entries"))
    return out.select("hive", "type", joined.alias("entries"), "username")


def _sam_values(spark, sf):
    c = spread_scan(table(spark, sf, "customer"))
    ticks = lambda days: binary.pack_le(F.lit(133480000000000000) + F.col("c_custkey") * days * 864000000000, 8)
    gap = lambda n: F.lit(b"\x00" * n)
    f = F.concat(gap(8), ticks(1), gap(8), ticks(2), gap(8), ticks(3), binary.pack_le(F.col("c_custkey"), 4), gap(4),
                 binary.pack_le(F.col("c_nationkey") * 37 % 2048, 2), gap(6),
                 binary.pack_le(F.col("c_nationkey"), 2), binary.pack_le(F.col("c_custkey") % 100, 2))
    texts = [F.col("c_name"), F.concat(F.lit("Full "), "c_name"), F.col("c_mktsegment"), F.lit("H:"), F.lit("logon.cmd"),
             F.concat(F.lit("C:\\Users\\"), "c_name"), F.lit("")]
    blobs = [binary.pack_utf16(t) for t in texts] + [F.unhex(F.md5("c_name")), F.unhex(F.md5("c_mktsegment"))]
    positions = [12, 24, 36, 84, 96, 108, 120, 156, 168]
    rows = c.select("c_custkey", f.alias("f"), F.array(*blobs).alias("b"), F.when(
        F.col("c_nationkey") % 2 == 0, 188).otherwise(212).alias("t"))
    lengths = [F.length(F.col("b")[i]) for i in range(len(blobs))]
    parts, at, offset = [gap(4), binary.pack_le(F.col("t"), 4)], 8, F.lit(0)
    for position, length in zip(positions, lengths):
        parts += [gap(position - at), binary.pack_le(offset, 4), binary.pack_le(length, 4)]
        at, offset = position + 8, offset + length
    v = F.concat(*parts, gap(0xCC - at), *[F.col("b")[i] for i in range(len(blobs))])
    values = rows.select(
        F.concat(F.lit("Users\\"), "c_custkey").alias("key"), F.lit("SAM").alias("hive"), "f",
        F.when(F.col("c_custkey") % 10 != 0, v).alias("v"))
    # Written, so that a filter on the values does not pack them a second time in the tasks of the scan.
    path = scratch_path(spark, "sam")
    values.write.parquet(path)
    return spark.read.schema(values.schema).parquet(path)


_SAM_FLAGS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN (c_nationkey * 37 % 2048) & {1 << i} <> 0 THEN '{n}' END"
    for i, n in enumerate(system.FLAG_NAMES)) + ")"


def _sam_time(days: int) -> str:
    ticks = f"(133480000000000000 + c_custkey * {days} * 864000000000 - 116444736000000000) // 10"
    return stamp_sql(f"make_timestamp({ticks})")


@query("ART-06 FN-10 FN-12 FN-13 FN-14 FN-15", f"""
 SELECT concat('Users\\', c_custkey) AS key, {_sam_time(1)} AS last_login, {_sam_time(2)} AS password_reset,
   {_sam_time(3)} AS password_fail, c_custkey AS rid, {_SAM_FLAGS} AS flags,
   cast(c_nationkey AS bigint) AS failed_logins, c_custkey % 100 AS logins,
   CASE WHEN c_nationkey % 2 = 0 THEN 'Default Admin User' ELSE 'Custom Limited Acct' END AS account_type,
   c_name AS username, concat('Full ', c_name) AS fullname, c_mktsegment AS comment, 'H:' AS driveletter,
   'logon.cmd' AS logon_script, concat('C:\\Users\\', c_name) AS profile_path, '' AS workstation,
   md5(c_name) AS lm_hash, md5(c_mktsegment) AS nt_hash
 FROM customer WHERE c_custkey % 10 <> 0""")
def sam_accounts(spark, sf):
    out = system.sam_accounts(_sam_values(spark, sf))
    f, v = F.col("f"), F.col("v")
    return out.select(
        "key", *[stamp(f[n], n) for n in system.F_TIMES], f["rid"].alias("rid"),
        F.concat_ws(",", f["flags"]).alias("flags"), f["failed_logins"].alias("failed_logins"),
        f["logins"].alias("logins"), v["account_type"].alias("account_type"),
        *[v[n].alias(n) for n in [*system.V_TEXTS, *system.V_HASHES]])


@query("ART-06", """
 SELECT c_name AS username, '2024-01-05 00:00:00.000000' AS created_time FROM customer WHERE c_nationkey % 2 = 0""")
def sam_create_times(spark, sf):
    names = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.lit("2024-01-05").cast("timestamp").alias("mtime"),
        F.when(F.col("c_nationkey") % 2 == 0, "Key").otherwise("DWORD").alias("data_type"))
    return system.sam_created(names).withColumn("created_time", stamp("created_time"))


def _rdp_values(spark, sf, key, name):
    return REC.df(spark, sf).select(
        F.concat(F.lit("S-1-5-21-"), "user_id").alias("sid"),
        F.when(F.col("user_id") % 3 != 0, F.col("host")).alias("username"),
        F.concat(F.lit("C:\\Users\\u"), "user_id", F.lit("\\NTUSER.DAT")).alias("hive"),
        key.alias("key"), name.alias("key_name"), F.concat("artifact", "event_id").cast("binary").alias("value"),
        F.date_trunc("day", _ts()).alias("mtime"),
        F.when(F.col("event_id") % 50 == 0, "Key").otherwise("SZ").alias("data_type"))


_RDP_SQL = f"""(SELECT *, concat('S-1-5-21-', user_id) AS sid, concat('C:\\Users\\u', user_id, '\\NTUSER.DAT') AS hive,
   CASE WHEN user_id % 3 <> 0 THEN host END AS username, concat(artifact, event_id) AS v,
   date_trunc('day', ts) AS mtime, concat('Software\\Terminal Server Client\\Servers\\srv', user_id % 4, artifact) AS key,
   CASE event_id % 3 WHEN 0 THEN 'UsernameHint' WHEN 1 THEN 'CertHash' ELSE 'Other' END AS key_name
   FROM {REC.sql} WHERE event_id % 50 <> 0)"""
_RDP_USER = "coalesce(username, concat('u', user_id))"


@query("ART-07 JN-08 AG-11", f"""
 WITH r AS {_RDP_SQL},
 h AS (SELECT sid, key, min(v) FILTER (key_name = 'UsernameHint') AS hint,
   min(lower(hex(encode(v)))) FILTER (key_name = 'CertHash') AS hash FROM r GROUP BY sid, key)
 SELECT DISTINCT {_RDP_USER} AS username, r.sid, hive, r.key, {stamp_sql('mtime')} AS last_write_time,
   concat('srv', user_id % 4, artifact) AS server, hint AS username_hint, hash AS cert_hash
 FROM r LEFT JOIN h ON h.sid = r.sid AND h.key = r.key WHERE regexp_matches(r.sid, '-[1-9][0-9]?$')
   AND username IS NOT NULL""")
def rdp_servers(spark, sf):
    e = F.col("event_id") % 3
    key = F.concat(F.lit("Software\\Terminal Server Client\\Servers\\srv"), (F.col("user_id") % 4).cast("string"), "artifact")
    name = F.when(e == 0, "UsernameHint").when(e == 1, "CertHash").otherwise("Other")
    out = userhives.rdp_servers(_rdp_values(spark, sf, key, name), user_regex="host", sid_regex="-[1-9][0-9]?$")
    return out.withColumn("last_write_time", stamp("last_write_time"))


@query("ART-08 AG-12", f"""
 WITH r AS (SELECT *, concat('MRU', event_id % 10) AS mru_name FROM {_RDP_SQL}),
 n AS (SELECT *, row_number() OVER (PARTITION BY sid, mru_name ORDER BY mtime DESC, v DESC) AS rn FROM r),
 l AS (SELECT sid, string_agg(v, '|' ORDER BY mru_name) AS mru FROM n WHERE rn = 1 GROUP BY sid)
 SELECT {_RDP_USER} AS username, sid, hive, {stamp_sql('max(mtime)')} AS last_write_time, mru
 FROM r JOIN l USING (sid) GROUP BY username, user_id, sid, hive, mru""")
def rdp_mru(spark, sf):
    key = F.lit("Software\\Terminal Server Client\\Default")
    name = F.concat(F.lit("MRU"), (F.col("event_id") % 10).cast("string"))
    out = userhives.rdp_mru(_rdp_values(spark, sf, key, name), user_regex="", sid_regex=".")
    return out.select("username", "sid", "hive", stamp("last_write_time"), F.concat_ws("|", "mru").alias("mru"))


_NAMES = ["EnableDHCP", "DhcpIPAddress", "Domain", "NameServer", "MTU", "SubnetMask"]
_NAME_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


def _interface_values(spark, sf):
    return table(spark, sf, "events").selectExpr(
        f"{_NAME_SQL} AS name", "cast(value AS decimal(18,2)) || '' AS value",
        f"concat('HKEY_LOCAL_MACHINE/SYSTEM/Interfaces/', '{{', user_id, '}}/', {_NAME_SQL}) AS os_path")


@query("ART-09 FLT-10 FN-18", f"""
 SELECT {_NAME_SQL} AS name, concat(cast(value AS decimal(18,2)), '') AS value, concat('{{', user_id, '}}') AS interface
 FROM events WHERE event_id % 6 <> 4""")
def net_interfaces(spark, sf):
    return system.interfaces(_interface_values(spark, sf))


@query("ART-09", f"""
 SELECT concat('{{', user_id, '}}') AS interface, """ + ", ".join(
    f"max(concat(cast(value AS decimal(18,2)), '')) FILTER ({_NAME_SQL} = '{n}') AS \"{n}\""
    for n in system.INTERFACE_VALUES) + " FROM events GROUP BY 1 HAVING bool_or(event_id % 6 <> 4)")
def net_interfaces_wide(spark, sf):
    return system.interfaces(_interface_values(spark, sf), wide=True)


_LOAD = "(133480000000000000 + c_custkey * 864000000000)"


@query("ART-10 JN-09 FN-11 FN-19", f"""
 SELECT cast(c_custkey AS varchar) AS uid, '' AS gid, c_name AS name, concat('C:\\Users\\', c_name) AS directory,
   concat('S-1-5-21-', c_custkey) AS sid, CASE WHEN c_nationkey < 20 THEN n_name END AS homedir_mtime,
   CASE WHEN c_nationkey % 4 <> 0 THEN {stamp_sql(f"make_timestamp(({_LOAD} - 116444736000000000) // 10)")} END AS load_time,
   cast(NULL AS varchar) AS unload_time FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def user_accounts(spark, sf):
    ticks = F.lit(133480000000000000) + F.col("c_custkey") * 864000000000
    low = ticks % binary.WORD
    high = ((ticks - low) / F.lit(binary.WORD)).cast("bigint")
    directory = F.concat(F.lit("C:\\Users\\"), "c_name")
    profiles = table(spark, sf, "customer").select(
        F.concat(F.lit("S-1-5-21-"), "c_custkey").alias("sid"), directory.alias("profile_image_path"),
        F.when(F.col("c_nationkey") % 4 != 0, high).alias("load_high"), low.alias("load_low"),
        F.lit(0).cast("bigint").alias("unload_high"), low.alias("unload_low"),
        F.lit("2024-01-05").cast("timestamp").alias("mtime"))
    nations = table(spark, sf, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS homedir_mtime")
    homes = lookup_join(table(spark, sf, "customer").where("c_nationkey < 20"), nations, ["c_nationkey"]).select(
        directory.alias("directory"), "homedir_mtime")
    out = userhives.users(profiles, homes)
    return out.select("uid", "gid", "name", "directory", "sid", "homedir_mtime",
                      stamp("data.profile_load_time", "load_time"), stamp("data.profile_unload_time", "unload_time"))


@query("ART-11 SO-02 JS-04 FN-17 FN-20", f"""
 SELECT doc_id, kind, CASE kind WHEN 'user_hive' THEN concat('HKEY_USERS\\', split_part(member, '/', 5))
     WHEN 'system_hive' THEN CASE WHEN ends_with(member, 'SAM') THEN 'SAM' ELSE 'HKEY_LOCAL_MACHINE/SOFTWARE' END
     WHEN 'mft' THEN '\\\\.\\C:' WHEN 'file_tree' THEN 'D:' WHEN 'amcache' THEN '/amcachemount/'
     WHEN 'usrclass' THEN concat('HKEY_USERS\\', split_part(member, '/', 5), '\\AppData\\Local\\Microsoft\\Windows') END AS prefix
 FROM (SELECT doc_id, member, CASE doc_id % 12 WHEN 0 THEN 'user_hive' WHEN 6 THEN 'mft' WHEN 7 THEN 'system_hive'
   WHEN 8 THEN 'system_hive' WHEN 9 THEN 'file_tree' WHEN 10 THEN 'amcache' WHEN 11 THEN 'usrclass' END AS kind
   FROM {MEM.sql}) WHERE kind IS NOT NULL""")
def evidence_kinds(spark, sf):
    mem = MEM.df(spark, sf)
    kind = system.evidence_kind(F.col("member"))
    found = mem.select("doc_id", "member", kind.alias("kind")).where("kind is not null")
    return found.select("doc_id", "kind", system.mount_prefix(F.col("member"), F.col("kind")).alias("prefix"))


@query("ART-12", """
 SELECT c_custkey AS client_id, CASE WHEN c_nationkey % 5 = 0 THEN 'Linux' WHEN c_mktsegment = 'BUILDING' THEN 'Workstation'
   WHEN c_mktsegment = 'MACHINERY' THEN 'Server' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Domain Controller' END AS label
 FROM customer WHERE c_nationkey % 5 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def role_labels(spark, sf):
    segment = F.col("c_mktsegment")
    role = F.when(segment == "BUILDING", "Member Workstation").when(segment == "MACHINERY", "Member Server").when(
        segment == "HOUSEHOLD", "Primary Domain Controller").otherwise("unknown")
    clients = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("client_id"), role.alias("domain_role"),
        F.when(F.col("c_nationkey") % 5 == 0, "Ubuntu Linux").otherwise("windows").alias("os"))
    return system.role_labels(clients)


@query("STM-06 JN-10 FN-22", f"""
 SELECT event_id, concat('Host ', u.name, ' F.', event_id, ' ', strftime(ts, '%Y%m%d'), '.zip') AS export_name
 FROM {REC.sql} JOIN {_USER_ONCE} u ON u.sid = concat('S-1-5-21-', user_id) WHERE regexp_matches(artifact, 'CLICK', 'i')""")
def flow_exports(spark, sf):
    from siftlake.functions import text

    flows = REC.df(spark, sf).withColumn("artifacts_with_results", F.array("artifact", F.lit("Generic.Info")))
    done = flows.where(any_matches(F.col("artifacts_with_results"), "CLICK")).withColumn(
        "sid", F.concat(F.lit("S-1-5-21-"), "user_id"))
    named = lookup_join(done, one_per_key(usr(spark, sf), ["sid"], F.col("name")), ["sid"], "inner")
    return named.select("event_id", text.flow_export_name(
        F.col("name"), F.concat(F.lit("F."), "event_id"), F.date_format("ts", "yyyyMMdd")).alias("export_name"))


@query("UD-01 UD-03 UD-04 UD-05", """
 SELECT * FROM (SELECT 'Interfaces' AS artifact, count(*) AS rows, TRUE AS success FROM events WHERE event_id % 6 <> 4
 UNION ALL SELECT 'SAM', count(*), TRUE FROM customer WHERE c_custkey % 10 <> 0
 UNION ALL SELECT 'Bam', cast(NULL AS bigint), FALSE)""")
def artifact_registry(spark, sf):
    tables = {"interface_values": _interface_values(spark, sf), "sam_values": _sam_values(spark, sf)}
    calls = [("Interfaces", {}), ("SAM", {}), ("Bam", {"no_such_parameter": 1})]
    outcomes = artifacts.collect(spark, calls, tables, scratch_path(spark, "artifacts"))
    return outcomes.select("artifact", "rows", "success")


@query("JS-03 UD-02 FN-02", """
 SELECT r_name, category, position, name FROM region CROSS JOIN (VALUES ('default', 0, 'Usn'), ('default', 1, 'Bam'),
   ('default', 2, 'NTUser'), ('skip', 0, 'Users')) AS t(category, position, name)""")
def artifact_lists(spark, sf):
    doc = F.lit('{"default": ["Usn()", "Bam(userRegex=\'.\')", "NTUser()"], "skip": ["Users()"]}')
    lists = table(spark, sf, "region").select("r_name", doc.alias("doc"))
    rows = lists.select("r_name", F.explode(F.from_json("doc", "map<string,array<string>>")).alias("category", "calls"))
    rows = rows.select("r_name", "category", F.posexplode("calls").alias("position", "call"))
    return rows.select("r_name", "category", "position", paths.artifact_call_name(F.col("call")).alias("name"))
