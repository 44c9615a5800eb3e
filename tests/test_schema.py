from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.operators import schema
from siftlake.sources import records, sinks


def voted(spark, rows, sample=100):
    df = records.parsed(records.from_memory(spark, rows))
    return {r["key"]: r["kind"] for r in schema.vote(df, ["file"], "pos", sample).collect()}


@pytest.mark.parametrize("value, kind", [
    (1, "long"), (True, "bool"), (1.5, "real"), (1_000_000_000.5, "datetime"), (999_999_999.5, "real"),
    (20_000_000_000_000.0, "datetime"), (1_700_000_000, "long"), (2**70, "long"), ("2024-01-05", "datetime"),
    ("2024", "string"), ({"a": 1}, "dynamic"), ([1], "dynamic"), ([], "dynamic"), ("", "string"), (None, "string"),
    (1e300, "real"),
])
def test_kinds(spark, value, kind):
    assert voted(spark, [{"x": value}]) == {"x": kind}


def test_tie_goes_to_first_seen(spark):
    assert voted(spark, [{"x": None}, {"x": "a"}, {"x": 1}]) == {"x": "string"}
    assert voted(spark, [{"x": 1}, {"x": "a"}, {"x": "b"}, {"x": 2}]) == {"x": "long"}


def test_sample_counts_values_not_nulls(spark):
    rows = [{"x": None}] * 5 + [{"x": 1}] * 2 + [{"x": "a"}] * 10
    assert voted(spark, rows, sample=3) == {"x": "long"}
    assert voted(spark, rows, sample=None) == {"x": "string"}


def test_sample_limit_runs_before_the_shuffle(spark):
    df = records.parsed(spark.range(10).select(F.lit("f").alias("file"), F.col("id").alias("pos"), F.lit('{"a":1}').alias("line")))
    plan = schema.vote(df, ["file"], "pos", 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_bad_and_empty_lines(spark):
    df = spark.createDataFrame([("f", 0, "{}"), ("f", 1, '{"a": '), ("f", 2, ""), ("f", 3, '{"a": 1}')],
                               "file string, pos bigint, line string")
    parsed = records.parsed(records.record_lines(df))
    assert parsed.count() == 3
    assert [tuple(r) for r in schema.vote(parsed, ["file"], "pos").collect()] == [("f", "a", "long", 1, 1)]


def test_collision_is_coalesced(spark):
    fields = [schema.FieldType("a b", "long"), schema.FieldType("a.b", "string"), schema.FieldType("it's", "string")]
    df = records.parsed(records.from_memory(spark, [{"a b": None, "a.b": "7", "it's": "x"}, {"a b": 1, "a.b": "9"}]))
    out = df.orderBy("pos").select(*schema.typed_columns(F.col("record"), fields)).collect()
    assert [tuple(r) for r in out] == [(7, "x"), (1, None)]
    assert schema.collisions(fields) == {"a_b": 2}
    assert schema.mapping(fields)[2] == ("it_s", "string", '$["it\'s"]')


def test_typed_datetime_forms(spark):
    df = records.parsed(records.from_memory(spark, [{"t": "2024-01-05T00:00:01Z"}, {"t": 1_700_000_000.5},
                                                    {"t": 1_700_000_000_500.0}, {"t": "2024"}, {"t": None}]))
    out = df.orderBy("pos").select(F.date_format(schema.typed_value(
        F.col("record"), schema.FieldType("t", "datetime")), "yyyy-MM-dd HH:mm:ss.S").alias("t")).collect()
    assert [r["t"] for r in out] == ["2024-01-05 00:00:01.0", "2023-11-14 22:13:20.5", "2023-11-14 22:13:20.5", None, None]


def test_lineage_replaces_fields(spark):
    df = spark.createDataFrame([("spoof", 1)], "src_host string, a int")
    out = records.with_lineage(df, F.lit("h"), F.lit('p"q.zip'), F.lit("u"))
    assert out.columns == ["a", "src_host", "src_package", "src_upload"]
    assert tuple(out.first()) == (1, "h", 'p"q.zip', "u")


def test_merge_keeps_types_and_adds_columns(spark):
    old = T.StructType.fromDDL("a bigint, src_host string")
    new = T.StructType.fromDDL("a string, A string, b double, src_host string")
    merged = schema.merge_schema(old, new)
    assert [(f.name, f.dataType.simpleString()) for f in merged] == [
        ("a", "bigint"), ("A", "string"), ("b", "double"), ("src_host", "string")]
    assert schema.new_columns(old, new) == ["A", "b"]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([("7", "x"), ("no", "y")], "a string, A string")
        assert [tuple(r) for r in schema.conform(df, merged).collect()] == [(7, "x", None, None), (None, "y", None, None)]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_first_file_gives_the_type(spark):
    df = spark.createDataFrame([("t", "f2", "a", "string"), ("t", "f1", "a", "long"), ("t", "f2", "b", "bool")],
                               "table_name string, file string, key string, kind string")
    out = schema.first_file_types(df, ["table_name"], "file").collect()
    assert {r["key"]: r["kind"] for r in out} == {"a": "long", "b": "bool"}


def test_dynamic_values_stay_json(spark):
    df = records.parsed(records.from_memory(spark, [{"x": {"b": [1, "t"]}}, {"x": [1, 2]}, {"x": "s"}, {"x": 1.5}]))
    out = df.orderBy("pos").select(schema.typed_value(F.col("record"), schema.FieldType("x", "dynamic")).alias("x"))
    assert [r["x"] for r in out.collect()] == ['{"b":[1,"t"]}', "[1,2]", "s", "1.5"]


def test_integers_beyond_64_bits_keep_their_digits(spark, tmp_path):
    store = sinks.ArtifactTables(spark, str(tmp_path / "tables"))
    values = ["1", "9223372036854775807", "9223372036854775808", "-9223372036854775809", "18446744073709551615", "99999999999999999999999999999999999999"]
    rows = [("t", "f", i, '{"big": %s, "small": %d, "mixed": %s}' % (v, i, '"x"' if i else v), "h", "p", "u") for i, v in enumerate(values)]
    lines = spark.createDataFrame(rows, "table_name string, file string, pos long, line string, host string, package string, upload string")
    sinks.ingest(lines, store, str(tmp_path / "raw"))
    got = store.read("t")
    assert dict(got.dtypes)["big"] == "string" and dict(got.dtypes)["small"] == "bigint"
    assert sorted(r["big"] for r in got.collect()) == sorted(values)
    assert sorted(r["mixed"] for r in got.collect()) == ["1"] + ["x"] * 5


def test_loads_at_once_give_a_new_column_one_type(spark, tmp_path):
    root = str(tmp_path / "tables")
    kinds = [T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()]

    def add(i):
        columns = T.StructType([T.StructField("shared", kinds[i]), T.StructField(f"own{i}", kinds[i])])
        return sinks.ArtifactTables(spark, root).evolve({"t": columns})["t"]

    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(add, range(4)))
    assert len({r["shared"].dataType for r in results}) == 1
    current = sinks.ArtifactTables(spark, root).columns("t")
    assert current["shared"].dataType == results[0]["shared"].dataType
    assert {f"own{i}": kinds[i] for i in range(4)} == {f.name: f.dataType for f in current.fields if f.name != "shared"}
    assert sinks.ArtifactTables(spark, root)._last_version() == 3
    assert add(0).names == current.names and sinks.ArtifactTables(spark, root)._last_version() == 3  # nothing new


def test_a_version_whose_writer_died_is_taken_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "CLOSING_WAIT", 0.01)
    store = sinks.ArtifactTables(spark, str(tmp_path / "tables"))
    store.evolve({"t": T.StructType([T.StructField("a", T.LongType())])})
    (tmp_path / "tables/_catalog" / f"{1:020d}.json").write_text('{"table_name": "t", "column_name": "half", "column_type": "bigint", "posi')
    assert store.columns("t").names == ["a"]
    assert store.evolve({"t": T.StructType([T.StructField("b", T.StringType())])})["t"].names == ["a", "b"]
    assert store.columns("t").names == ["a", "b"]


def test_a_clustered_load_is_filtered_by_its_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 2000)
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 50)).alias("src_host"),
        F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 40_000).alias("at"), F.col("id").alias("n"), F.rand(1).alias("pad")).repartition(9)
    plain, clustered = (sinks.ArtifactTables(spark, str(tmp_path / name), cluster=keys) for name, keys in
                        (("plain", ()), ("clustered", ("src_host", "at", "none"))))
    for store in (plain, clustered):
        assert store.append(rows, "t")[1:3] == (40_000, True)

    def scanned(store):
        """Rows that the scan has handed on, after its row groups were skipped."""
        found = store.read("t").where("src_host = 'hot' AND at >= timestamp_seconds(1700010000) AND at < timestamp_seconds(1700011000)")
        got = sorted(r["n"] for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return got, leaf.metrics().apply("numOutputRows").value()

    slow, fast = scanned(plain), scanned(clustered)
    assert slow[0] == fast[0] and len(fast[0]) > 300
    assert slow[1] == 40_000 and fast[1] <= 3 * 2000
    files = list((tmp_path / "clustered/t").glob("run=*/*.parquet"))
    hosts = [spark.read.parquet(str(f)).select("src_host").distinct().count() for f in files]
    assert len(files) >= 20 and sum(h == 1 for h in hosts) >= 5  # the hot host has files of its own
