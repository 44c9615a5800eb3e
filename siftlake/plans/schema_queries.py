"""Queries over schema inference, evolution and typed projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import paths, text, times
from siftlake.operators import reports, schema
from siftlake.plans.base import REC, query, spread_scan, stamp, stamp_sql, table
from siftlake.sources import records

# A field whose type changes from record to record, to make the vote a real one.
_LINE = """concat('{"event_id":', event_id, ',"ts":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
 '","user_id":', user_id, ',"event_type":"', event_type, '","value":', value, ',"props":', props, ',"mixed":',
 CASE event_id % 4 WHEN 0 THEN cast(value AS string) WHEN 1 THEN concat('"', event_type, '"')
   WHEN 2 THEN concat('"', date_format(ts, 'yyyy-MM-dd'), '"') ELSE 'null' END, '}')"""

_KINDS_SQL = """
 SELECT event_type AS artifact, event_id AS pos, 'event_id' AS key, 'long' AS kind FROM events
 UNION ALL SELECT event_type, event_id, 'ts', 'datetime' FROM events
 UNION ALL SELECT event_type, event_id, 'user_id', 'long' FROM events
 UNION ALL SELECT event_type, event_id, 'event_type', 'string' FROM events
 UNION ALL SELECT event_type, event_id, 'value',
   CASE WHEN value BETWEEN 1e9 AND 2e13 THEN 'datetime' ELSE 'real' END FROM events
 UNION ALL SELECT event_type, event_id, 'props', 'dynamic' FROM events
 UNION ALL SELECT event_type, event_id, 'mixed', CASE event_id % 4 WHEN 0 THEN
   CASE WHEN value BETWEEN 1e9 AND 2e13 THEN 'datetime' ELSE 'real' END
   WHEN 1 THEN 'string' WHEN 2 THEN 'datetime' END FROM events"""

_VOTE_SQL = """
 c AS (SELECT artifact, key, kind, count(*) AS n, min(pos) AS f FROM v WHERE kind IS NOT NULL
       GROUP BY artifact, key, kind),
 r AS (SELECT *, row_number() OVER (PARTITION BY artifact, key ORDER BY n DESC, f) AS rn,
       sum(n) OVER (PARTITION BY artifact, key) AS total FROM c)
 SELECT artifact, key, kind, n AS votes, cast(total AS bigint) AS samples FROM r WHERE rn = 1"""


def _event_records(spark, sf):
    lines = spread_scan(table(spark, sf, "events")).selectExpr("event_type AS artifact", "event_id AS pos", f"{_LINE} AS line")
    return records.parsed(lines)


@query("AG-07 ST-02 PRJ-01 SCH-05", """
 SELECT concat('host-', user_id) AS host, count(*) AS records FROM events GROUP BY 1""")
def records_per_host(spark, sf):
    rec = REC.df(spark, sf).select("host", "event_id")
    tagged = records.with_lineage(rec, F.col("host"), F.lit("pkg-0.zip"), F.lit("id0"))
    return reports.records_per_host(tagged)


@query("SCH-01 SCH-02 JS-07", f"WITH v AS ({_KINDS_SQL}), {_VOTE_SQL}")
def schema_vote_events(spark, sf):
    return schema.vote(_event_records(spark, sf), ["artifact"], "pos", sample=None)


@query("SCH-02 WN-04", f"""WITH a AS ({_KINDS_SQL}), v AS (SELECT * FROM (SELECT *, row_number() OVER (
   PARTITION BY artifact, key, kind IS NULL ORDER BY pos) AS rk FROM a) WHERE rk <= 100), {_VOTE_SQL}""")
def schema_vote_sampled(spark, sf):
    return schema.vote(_event_records(spark, sf), ["artifact"], "pos", sample=100)


_FORMS = {
    0: ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"),
    1: ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"),
    2: ("date_format(ts, 'yyyyMMdd')", "strftime(ts, '%Y%m%d')"),
    3: ("date_format(ts, 'yyyy')", "strftime(ts, '%Y')"),
    4: ("date_format(ts, 'HH:mm')", "strftime(ts, '%H:%M')"),
    5: ("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'Z')", "concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Z')"),
    6: ("event_type", "event_type"),
    7: ("concat(date_format(ts, 'yyyy-MM-'), user_id)", "concat(strftime(ts, '%Y-%m-'), user_id)"),
}


def _forms(side: int) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {v[side]}" for k, v in _FORMS.items()) + " END"


@query("SCH-01", f"""
 WITH t AS (SELECT event_id % 8 AS form, {_forms(1)} AS s FROM events UNION ALL SELECT 8, text FROM documents)
 SELECT cast(form AS bigint) AS form, CASE WHEN regexp_matches(s, '{times.ISO_PATTERN}') AND
   try_cast(concat(regexp_extract(s, '{times.ISO_PATTERN}', 1), '-',
     regexp_extract(s, '{times.ISO_PATTERN}', 2), regexp_extract(s, '{times.ISO_PATTERN}', 4), '-',
     regexp_extract(s, '{times.ISO_PATTERN}', 3), regexp_extract(s, '{times.ISO_PATTERN}', 5)) AS date) IS NOT NULL
   THEN 'datetime' ELSE 'string' END AS kind, count(*) AS n FROM t GROUP BY 1, 2""")
def classify_values(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id % 8 AS form", f"{_forms(0)} AS s")
    texts = table(spark, sf, "documents").selectExpr("cast(8 AS bigint) AS form", "text AS s")
    kinds = events.unionByName(texts).select("form", schema.classify_text(F.col("s")).alias("kind"))
    return kinds.groupBy("form", "kind").agg(F.count("*").alias("n"))


_CLEAN_SQL = r"regexp_replace(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', '_', 'g'), '[^A-Za-z0-9_]', '_', 'g')"


@query("SCH-03 SCH-04 FN-01", f"""
 SELECT concat('part-', p_partkey) AS id, {_CLEAN_SQL.format("concat(p_name, ' [', p_brand, ']  ', p_type)")} AS clean,
   concat('ev_', {_CLEAN_SQL.format("concat(p_name, '.', p_brand)")}) AS table_name FROM part
 UNION ALL SELECT concat('page-', page_id), {_CLEAN_SQL.format("url")}, concat('ev_', {_CLEAN_SQL.format(
    "regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)[.][^.]+$', '" + chr(92) + "1')")}) FROM pages
 UNION ALL SELECT concat('doc-', doc_id), md5({_CLEAN_SQL.format("text")}), concat('ev_', source) FROM documents""")
def sanitize_names(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("id"),
        paths.sanitize_name(F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]  "), "p_type")).alias("clean"),
        paths.table_name(F.concat(F.lit("out/"), "p_name", F.lit("."), "p_brand", F.lit(".json")), "ev_").alias(
            "table_name"),
    )
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("id"), paths.sanitize_name(F.col("url")).alias("clean"),
        paths.table_name(F.col("url"), "ev_").alias("table_name"))
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text", "source")).select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.md5(paths.sanitize_name(F.col("text"))).alias("clean"),
        paths.table_name(F.concat("source", F.lit(".jsonl")), "ev_").alias("table_name"))
    return part.unionByName(pages).unionByName(docs)


@query("SCH-07 SCH-09 JS-07", f"""
 SELECT event_id, {stamp_sql('ts')} AS ts, user_id, event_type, value,
   cast(json_extract(props, '$.k') AS bigint) AS k,
   CASE event_id % 4 WHEN 1 THEN event_type WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 0 THEN 'number' END AS mixed
 FROM events""")
def typed_projection(spark, sf):
    fields = [schema.FieldType(*f) for f in [
        ("event_id", "long"), ("ts", "datetime"), ("user_id", "long"), ("event_type", "string"),
        ("value", "real"), ("mixed", "string")]]
    rec = _event_records(spark, sf)
    nested = F.try_variant_get("record", "$.props.k", "bigint").alias("k")
    typed = rec.select(*schema.typed_columns(F.col("record"), fields), nested)
    number = F.col("mixed").try_cast("double").isNotNull()
    return typed.withColumns({"ts": stamp("ts"), "mixed": F.when(number, "number").otherwise(F.col("mixed"))})


@query("SCH-05 SCH-06 SO-03", """
 SELECT event_id AS id, event_type AS name, value AS amount, cast(NULL AS varchar) AS priority,
   concat('host-', user_id) AS src_host, 'a.zip' AS src_package, 'id1' AS src_upload FROM events
 UNION ALL SELECT try_cast(concat(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END, o_orderkey) AS bigint),
   o_orderstatus, o_totalprice, o_orderpriority, concat('host-', o_custkey), 'b.zip', 'id2' FROM orders""")
def schema_merge_union(spark, sf):
    first = table(spark, sf, "events").selectExpr("event_id AS id", "event_type AS name", "value AS amount", "user_id")
    first = records.with_lineage(first, F.concat(F.lit("host-"), "user_id"), F.lit("a.zip"), F.lit("id1"))
    second = table(spark, sf, "orders").selectExpr(
        "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END, o_orderkey) AS id", "o_orderstatus AS name",
        "o_totalprice AS amount", "o_orderpriority AS priority", "o_custkey")
    second = records.with_lineage(second, F.concat(F.lit("host-"), "o_custkey"), F.lit("b.zip"), F.lit("id2"))
    return schema.union_tables([first.drop("user_id"), second.drop("o_custkey")])


@query("PRJ-01 SCH-05 FN-08", """
 SELECT event_id, event_type, concat('host-', user_id) AS src_host,
   concat('pkg-', event_id % 97, '.zip') AS src_package,
   concat('id', substr(md5(concat('pkg-', event_id % 97, '.zip', '|', 's-1')), 1, 16)) AS src_upload FROM events""")
def lineage_tagging(spark, sf):
    rec = table(spark, sf, "events").select(F.lit("spoofed").alias("src_host"), "event_id", "event_type", "user_id")
    package = F.concat(F.lit("pkg-"), F.col("event_id") % 97, F.lit(".zip"))
    tagged = records.with_lineage(rec, F.concat(F.lit("host-"), "user_id"), package,
                                  text.run_id(package, F.lit("s-1")))
    return tagged.drop("user_id")
