import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import ledger, numbering, reports, rules, skew, splitting


def greedy(sizes, target):
    part, used, out = 1, 0, []
    for s in sizes:
        if used > 0 and used + s > target:
            part, used = part + 1, 0
        used += s
        out.append(part)
    return out


@pytest.mark.parametrize("block, fan_in", [(4, 2), (16, 3), (1000, 64)])
def test_greedy_split_is_exact(spark, block, fan_in):
    rnd = random.Random(block)
    files = {f"f{i}": [rnd.choice([1, 5, 9, 30, 99, 100, 101, 250]) for _ in range(n)] for i, n in enumerate([1, 7, 90, 200])}
    rows = [(f, i, s) for f, sizes in files.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, size bigint")
    out = splitting.greedy_parts(df, 100, max_file_blocks=200 // block + 1, block=block, fan_in=fan_in).collect()
    got = {f: [r["part"] for r in sorted((r for r in out if r["file"] == f), key=lambda r: r["line_no"])] for f in files}
    assert got == {f: greedy(sizes, 100) for f, sizes in files.items()}


def test_even_split_and_running_sum(spark):
    sizes = [3, 4, 10, 1, 1, 9]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(sizes)], "file string, line_no bigint, size bigint")
    summed = numbering.running_sum(df, ["file"], "line_no", F.col("size"), block=2).orderBy("line_no").collect()
    assert [r["running"] for r in summed] == [3, 7, 17, 18, 19, 28]
    parts = splitting.even_parts(df, 10).orderBy("line_no").collect()
    assert [r["part"] for r in parts] == [1, 1, 1, 2, 2, 2]


def test_parts_hold_the_whole_input(spark, tmp_path):
    lines = [("f", i, "x" * (i % 7)) for i in range(100)]
    df = spark.createDataFrame(lines, "file string, line_no bigint, line string")
    sizes = df.select("file", "line_no", splitting.line_bytes(F.col("line")).alias("size"))
    parts = splitting.greedy_parts(sizes, 20, max_file_blocks=1)
    splitting.write_parts(df.join(parts.drop("size"), ["file", "line_no"]), str(tmp_path / "parts"))
    back = spark.read.text(str(tmp_path / "parts"))
    whole = "\n".join(r["value"] for r in sorted(back.collect(), key=lambda r: int(r["part"])))
    assert whole == "\n".join(line for _, _, line in lines)


def test_ordered_index(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    out = numbering.ordered_index(df, ["k"]).collect()
    assert [r["k"] for r in sorted(out, key=lambda r: r["index"])] == sorted(r["k"] for r in out)
    assert sorted(r["index"] for r in out) == list(range(1000))


def test_batches(spark):
    df = spark.createDataFrame([("s", f"p{i:03}", 5 if i % 10 else 100) for i in range(45)],
                               "source string, package string, size bigint")
    out = numbering.pack_batches(df, ["source", "package"], threshold=100).collect()
    sizes = Counter((r["batch_kind"], r["batch_no"]) for r in out)
    assert sizes == {**{("large", i): 1 for i in range(5)}, ("small", 0): 20, ("small", 1): 20}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_join(spark, how):
    left = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
            F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), "id")
    right = spark.range(300).select(F.when(F.col("id") == 0, "hot").otherwise(
        F.concat(F.lit("k"), "id")).alias("k"), (F.col("id") * 10).alias("v"))
    plain = left.join(right, ["k"], how)
    salted = skew.salted_join(left, right, ["k"], how)
    key = lambda df: Counter(tuple(r) for r in df.select("k", "id", "v").collect())
    assert key(salted) == key(plain)


def test_a_hot_key_is_spread_over_tasks(spark):
    left = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(30000).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in skew.salted_join(left, right, ["k"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 30000 and max(sizes) < 30000 / 8 * 1.5


def test_hot_keys_are_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 1000).alias("k"))
    assert skew.hot_keys(df, ["k"]).count() == 0
    assert skew.hot_keys(df.select((F.col("k") % 2).alias("k")), ["k"]).count() == 2


def test_large_lookup_is_salted_small_is_left_to_catalyst(spark, tmp_path):
    left, right = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).select(F.col("id").alias("k"))
    right.write.parquet(str(tmp_path / "r"))
    small = spark.read.parquet(str(tmp_path / "r"))
    assert "_salt" not in skew.lookup_join(left, small, ["k"])._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "_salt" in skew.lookup_join(left, small, ["k"])._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [None, 7, 1000])
def test_nearest_before_brute_force(spark, block):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), rnd.randrange(0, 5000), rnd.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, host string, s int, probe boolean").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["near_count"], r["near_id"]) for r in skew.nearest_before(
        df.where("probe").select("id", "host", "ts"), df.where("not probe").select("id", "host", "ts"),
        "host", "ts", 300, ["id"], block).collect()}
    for i, host, s, probe in rows:
        if probe:
            near = [(t, j) for j, h, t, p in rows if not p and h == host and s - 300 <= t <= s]
            assert got[i] == (len(near), max(near)[1] if near else None)


def test_gate(spark):
    listing = spark.createDataFrame([(p,) for p in "abcde"], "package string")
    current = spark.createDataFrame([("a", "new", 0), ("b", "unqueued", 0), ("c", "failed", 1), ("d", "finished", 0)],
                                    "package string, status string, failures int")
    gate = lambda **k: {r["package"]: r["process"] for r in ledger.processing_gate(listing, current, **k).collect()}
    assert gate() == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert gate(max_retry=3)["c"] is True and gate(max_retry=1)["c"] is False
    assert all(r["process"] for r in ledger.processing_gate(listing, None).collect())


def test_confirm_edges(spark):
    rows = [("a", "id1", "2026-01-01 10:00:00"), ("b", "id2", "2026-01-01 09:00:00"), ("c", "id3", "2026-01-01 09:45:00"),
            ("d", "bad id", "2026-01-01 09:00:00"), ("e", None, None), ("f", "id6", None)]
    finished = spark.createDataFrame(rows, "package string, upload_id string, t string").select(
        "package", "upload_id", F.col("t").cast("timestamp_ntz").alias("updated_at"))
    seen = spark.createDataFrame([("id1",), ("id1",)], "upload_id string")
    out = ledger.confirm(finished, seen, F.lit("2026-01-01 10:00:00").cast("timestamp_ntz")).collect()
    assert {r["package"]: r["confirmation"] for r in out} == {"a": "confirmed", "b": "timeout", "c": "pending", "f": "timeout"}


def test_confirmed_entries_are_not_checked_again(spark):
    rows = [("a", "id1", "timeout"), ("b", "id2", "pending"), ("c", "id3", None)]
    finished = spark.createDataFrame(rows, "package string, upload_id string, confirmation string").withColumn(
        "updated_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    out = ledger.confirm(finished, spark.createDataFrame([("id1",), ("id2",)], "upload_id string"),
                         F.lit("2026-01-02").cast("timestamp_ntz"))
    assert {r["package"]: r["confirmation"] for r in out.collect()} == {"b": "confirmed", "c": "timeout"}


def test_artifact_table_blanks(spark):
    df = spark.createDataFrame([("p", "x", None, None, None, None), ("p", "y", 0.0, 5, True, 0), ("p", "z", 1.0, 2, False, 1)],
                               "package string, artifact string, duration_in_sec double, size bigint, success boolean, returncode int")
    got = {r["artifact"]: tuple(r)[2:] for r in reports.artifact_table(df).collect()}
    assert got == {"x": (None, "", "", None), "y": (5, "0.00 sec", "OK", 0), "z": (2, "1.00 sec", "FAILED", 1),
                   "TOTALS": (7, "1.00 sec", "1 out of 3", None)}
    assert "returncode" not in reports.artifact_table(df, limited=True).columns


def test_upload_classes_are_disjoint_and_complete(spark):
    import itertools

    rows = list(itertools.product([True, False, None], ["e", "", None], [True, False, None]))
    df = spark.createDataFrame([("p", *r) for r in rows],
                               "package string, ignored_upload boolean, upload_error string, upload_initiated boolean")
    counts = {r["upload_class"]: r["files"] for r in reports.upload_classes(df, ["package"]).collect()}
    expected = Counter("ignored" if i else "failed" if e or not u else "uploaded" for i, e, u in rows)
    assert counts == expected


def test_totals_ignore_missing_values(spark):
    df = spark.createDataFrame([("p", "h", None, None, None), ("p", "h", 1.005, 3, True), ("p", "h", 2.0, None, False)],
                               "package string, host string, duration_in_sec double, size bigint, success boolean")
    assert tuple(reports.package_totals(df, ["package", "host"]).first()) == ("p", "h", 3.005, 3, 1, 1)


def test_total_is_rounded(spark):
    df = spark.createDataFrame([(1.004,), (None,), (2.004,)], "d double")
    assert df.agg(reports.total(F.col("d"))).first()[0] == 3.01


def test_run_documents_flatten(spark):
    run = {"summary": {"uploadid": "id1", "zipfile_basename": "p.zip"},
           "uploads": [{"basename": "a.json", "ignored_upload": False}, {"basename": "b.txt", "ignored_upload": True}],
           "postprocessing": [], "logs": [{"timestamp": "t", "level": "INFO", "message": "m"}]}
    runs = spark.createDataFrame([run], ledger.RUN)
    assert [(r["uploadid"], r["zipfile"], r["basename"]) for r in ledger.flatten(runs, "uploads").collect()] == [
        ("id1", "p.zip", "a.json"), ("id1", "p.zip", "b.txt")]
    assert len(ledger.flatten(runs, "uploads").columns) == 16
    assert ledger.flatten(runs, "postprocessing").count() == 0


def test_status_filter(spark):
    df = spark.createDataFrame([("New", "p", None), ("failed", "q", "Host")], "status string, package string, host string")
    assert df.where(rules.has_status(F.col("status"), "new")).count() == 1
    assert df.where(rules.contains_text("hOS", F.col("package"), F.col("host"))).count() == 1
    assert df.where(rules.has_status(F.col("status"), "") & rules.contains_text("")).count() == 2


@pytest.mark.parametrize("seed", range(20))
def test_part_openings_equal_the_rule_line_by_line(seed):
    rng = np.random.default_rng(seed)
    target = int(rng.integers(1, 60))
    sizes = rng.integers(1, rng.choice([3, 20, 90]), rng.integers(1, 200)).astype(np.int64)
    for room in (splitting._FULL, -5, 0, target // 2, target):
        want, left = [], room
        for i, size in enumerate(sizes):
            if size > left:
                want.append(i)
                left = target
            left -= int(size)
        assert splitting._openings(sizes, target, room).tolist() == want
        out, cuts = splitting._Step.of_lines(sizes, target).apply(np.array([room]))
        assert (int(out[0]), int(cuts[0])) == (left, len(want))


def test_blocks_of_few_bytes_are_dealt_out_to_many_tasks(spark):
    lines = spark.range(4000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), (F.col("id") % 50 + 1).alias("size"))
    parts = splitting.greedy_parts(lines, 500, max_file_blocks=40, block=100)
    assert parts.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    want, used, part = {}, 0, 0
    for i in range(4000):
        size = i % 50 + 1
        if part == 0 or used + size > 500:
            used, part = 0, part + 1
        used, want[i] = used + size, part
    assert {r["line_no"]: r["part"] for r in parts.collect()} == want
