"""Query registry and the views that give the test tables the shape of evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    fn: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}
#: Tasks for each core that a scan with much work per row is dealt out to.
SCAN_TASKS = 4


def query(ids: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(ids.split()), fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_scan(rows: DataFrame) -> DataFrame:
    """A raw scan over so many tasks as `siftlake.scan.tasks` asks for. Unset, a scan of fewer splits
    than all cores need is dealt out anew, since small files may hold much work; a longer one stays
    as it is."""
    tasks = rows.sparkSession.conf.get("siftlake.scan.tasks", None)
    if tasks:
        return rows.repartition(int(tasks))
    wanted = SCAN_TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


@dataclass(frozen=True)
class View:
    """Columns over one table as expressions that Spark and ANSI SQL read alike."""

    source: str
    columns: dict[str, str]

    def df(self, spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
        """`wide` is for queries with much work per row."""
        rows = table(spark, sf, self.source)
        return (spread_scan(rows) if wide else rows).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in self.columns.items()) + f" FROM {self.source})"


# Evidence records: one per event.
REC = View("events", {
    "event_id": "event_id", "host": "concat('host-', user_id)", "artifact": "event_type", "ts": "ts",
    "value": "value", "props": "props", "user_id": "user_id",
})

# Packages with a status.
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'new' ELSE 'processing' END"
PKG = View("orders", {
    "orderkey": "o_orderkey", "custkey": "o_custkey",
    "package": "concat('pkg-', o_orderkey, '.zip')",
    "path": "concat('store/', o_orderpriority, '/pkg-', o_orderkey, '.zip')",
    "size": "cast(floor(o_totalprice * 1000) AS bigint)",
    "source": "o_orderpriority", "status": _STATUS, "started_at": "o_orderdate",
    "upload_id": "concat('id', substr(md5(concat('pkg-', o_orderkey, '.zip')), 1, 8))",
    "host": "concat('host-', o_custkey % 100)",
    "session": "concat('s-', o_orderkey % 5)",
})

# Upload rows.
UPL = View("lineitem", {
    "package": "concat('pkg-', l_orderkey, '.zip')",
    "orderkey": "l_orderkey",
    "member": "concat('results/', l_partkey, '/', l_suppkey, '-', l_linenumber, '.json')",
    "basename": "concat(l_suppkey, '-', l_linenumber, '.json')",
    "size": "cast(floor(l_quantity * 1000) AS bigint)",
    "ignored_upload": "l_returnflag = 'A'",
    "upload_error": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'ingest failed' END",
    "upload_initiated": "l_returnflag = 'N'",
    "duration_in_sec": "l_extendedprice",
})

# Artifact runs; the artifact comes from the part.
POST = {
    "package": "concat('pkg-', l_orderkey, '.zip')",
    "host": "concat('host-', l_orderkey % 100)",
    "artifact": "p_type",
    "success": "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus = 'F' END",
    "error": "CASE WHEN l_returnflag = 'R' THEN 'time limit' END",
    "basename": "concat(p_type, '.json')",
    "duration_in_sec": "l_extendedprice",
    "size": "cast(floor(l_quantity * 1000) AS bigint)",
    "returncode": "CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END",
}
POST_SQL = ("(SELECT " + ", ".join(f"{e} AS {n}" for n, e in POST.items())
            + " FROM lineitem JOIN part ON l_partkey = p_partkey)")


def post(spark: SparkSession, sf: str) -> DataFrame:
    from siftlake.operators.skew import lookup_join

    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return lookup_join(lines, parts, ["p_partkey"], "inner").selectExpr(*[f"{e} AS {n}" for n, e in POST.items()])


# Package members, one per document; the path shapes cover every ignore rule and kind.
_MEMBER = """CASE doc_id % 12
 WHEN 0 THEN concat('uploads/auto/C%3A/Users/', lang, '/NTUSER.DAT')
 WHEN 1 THEN concat('results/', source, '/', doc_id, '.json')
 WHEN 2 THEN concat('results/', doc_id, '.jsonl')
 WHEN 3 THEN concat('uploads/', source, '/', doc_id, '.json')
 WHEN 4 THEN concat('results/', source, '/')
 WHEN 5 THEN 'Windows.Collected%2FUploads.json'
 WHEN 6 THEN 'uploads/ntfs/%5C%5C.%5CC%3A/$MFT'
 WHEN 7 THEN 'uploads/auto/C%3A/Windows/System32/config/SAM'
 WHEN 8 THEN 'uploads/auto/C%3A/Windows/System32/config/SOFTWARE'
 WHEN 9 THEN 'uploads/auto/D%3A/'
 WHEN 10 THEN 'uploads/auto/C%3A/Windows/appcompat/Programs/Amcache.hve'
 ELSE concat('uploads/auto/C%3A/Users/', source, '/AppData/Local/Microsoft/Windows/UsrClass.dat') END"""
MEM = View("documents", {
    "doc_id": "doc_id",
    "package": "concat('pkg-', doc_id % 50, '.zip')",
    "member": _MEMBER,
    "size": "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END",
    "encrypted": "doc_id % 130 = 7",
})

# Accounts: customers and suppliers share some keys, so a SID can have two names.
USR_SQL = ("(SELECT concat('S-1-5-21-', c_custkey) AS sid, c_name AS name FROM customer UNION ALL "
           "SELECT concat('S-1-5-21-', s_suppkey) AS sid, s_name AS name FROM supplier)")


def usr(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").selectExpr("concat('S-1-5-21-', c_custkey) AS sid", "c_name AS name")
    suppliers = table(spark, sf, "supplier").selectExpr("concat('S-1-5-21-', s_suppkey) AS sid", "s_name AS name")
    return customers.unionByName(suppliers)


def stamp(column: str, alias: str | None = None):
    """Timestamps leave a query as text, so that no client time zone is involved."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(alias or column)


def stamp_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def lit_ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")
