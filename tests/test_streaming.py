import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F

from siftlake.operators import ledger
from siftlake.streaming import discovery, generations, reactions, status

T0 = datetime.datetime(2026, 1, 1)


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def write(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_discovery_of_real_files_is_idempotent(spark, tmp_path):
    for name in ["a.zip", "sub/b.zip", "c.txt"]:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x" * 5)
    run = lambda check: discovery.discover(
        discovery.listing_stream(spark, str(tmp_path / "in"), "blob"), str(tmp_path / "ledger"), str(tmp_path / check)
    ).awaitTermination()
    run("one")
    run("one")
    run("two")  # another watcher without the first one's progress
    (tmp_path / "in" / "d.zip").write_bytes(b"y")
    run("one")
    rows = discovery.read_batches(spark, str(tmp_path / "ledger"), discovery.ENTRY).collect()
    assert sorted((r["package"].rsplit("/", 1)[1], r["size"], r["status"], r["source"]) for r in rows) == [
        ("a.zip", 5, "new", "blob"), ("b.zip", 5, "new", "blob"), ("d.zip", 1, "new", "blob")]


EVENTS = "package string, status string, updated_at timestamp"


def test_a_merged_ledger_still_knows_its_packages(spark, tmp_path):
    ledger_path, schema = str(tmp_path / "ledger"), "package string, source string, size long"
    for i in range(3):
        write(spark, str(tmp_path / "in"), [(f"p{i}", "s", i), ("p0", "s", 0)], schema, f"f{i}")
        discovery.discover(stream(spark, str(tmp_path / "in"), schema), ledger_path, str(tmp_path / "check")).awaitTermination()
    assert discovery.compact_ledger(spark, ledger_path) == 1
    write(spark, str(tmp_path / "in"), [("p0", "s", 0), ("p1", "s", 1), ("p9", "s", 9)], schema, "f9")
    discovery.discover(stream(spark, str(tmp_path / "in"), schema), ledger_path, str(tmp_path / "check")).awaitTermination()
    rows = generations.read(spark, ledger_path, discovery.ENTRY).collect()
    assert sorted((r["package"], r["size"], r["batch"]) for r in rows) == [("p0", 0, 1), ("p1", 1, 1), ("p2", 2, 2), ("p9", 9, 3)]


MOVES = [("a", "new", minutes(0)), ("a", "queued", minutes(1)), ("a", "finished", minutes(9)), ("b", "new", minutes(0)),
         ("b", "failed", minutes(2)), ("b", "unqueued", minutes(3)), ("c", "finished", minutes(1)),
         ("c", "processing", minutes(2)), ("d", "uploading", minutes(1)), ("a", "queued", minutes(1)), (None, "new", minutes(1)), ("e", "new", None)]
STATES = {"a": ("finished", minutes(9), 3, False), "b": ("unqueued", minutes(3), 3, False),
          "c": ("processing", minutes(2), 2, True), "d": ("uploading", minutes(1), 1, False)}


def states(df):
    return {r["package"]: (r["status"], r["entered_at"], r["events"], r["illegal"]) for r in df.collect()}


@pytest.mark.parametrize("cuts, turn, compacted", [([0, 3, 6, 9, 12], 1, True), ([0, 12], 1, False), ([0, 1, 2, 4, 9, 12], -1, False)])
def test_status_does_not_depend_on_the_batches(spark, tmp_path, cuts, turn, compacted):
    rows = MOVES[::turn]
    out = str(tmp_path / "out")
    for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
        write(spark, str(tmp_path / "in"), rows[x:y], EVENTS, f"f{i}")
        # each start reads the new files only and goes on with the state
        status.follow_status(stream(spark, str(tmp_path / "in"), EVENTS), out, str(tmp_path / "check")).awaitTermination()
        if compacted:
            status.compact_status(spark, out)
    clean = spark.createDataFrame([m for m in MOVES if None not in m], EVENTS)
    assert states(status.state_of(clean)) == STATES
    assert states(status.current(spark, out)) == STATES
    now = F.lit(minutes(60))
    want = sorted(map(tuple, status.counters(status.state_of(clean), now).collect()))
    assert sorted(map(tuple, status.current_counters(spark, out, now).collect())) == want
    if compacted:
        assert generations.newest_generation(spark, f"{out}/changes") == len(cuts) - 3
        # what has been merged is not read again
        shutil.rmtree(f"{out}/changes/batch=0")
        assert states(status.current(spark, out)) == STATES


def test_a_moved_package_leaves_its_counter(spark, tmp_path):
    out = str(tmp_path / "out")
    steps = [[("p", "new", minutes(0)), ("q", "new", minutes(0)), ("r", "new", minutes(2))],
             [("p", "processing", minutes(5)), ("q", "processing", minutes(6)), ("r", "new", minutes(2))], [("r", "processing", minutes(7))]]
    seen = []
    for i, rows in enumerate(steps):
        write(spark, str(tmp_path / "in"), rows, EVENTS, f"f{i}")
        status.follow_status(stream(spark, str(tmp_path / "in"), EVENTS), out, str(tmp_path / "check")).awaitTermination()
        seen.append(sorted(map(tuple, status.current_counters(spark, out, F.lit(minutes(10))).collect())))
    assert seen == [[("new", 3, 600)], [("new", 1, 480), ("processing", 2, 300)], [("processing", 3, 300)]]
    assert status.current(spark, str(tmp_path / "none")).count() == 0
    assert status.current_counters(spark, str(tmp_path / "none"), F.lit(minutes(1))).count() == 0


def test_a_failed_compaction_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        spark.createDataFrame([("k", i), (f"k{i}", i)], "key string, n int").write.parquet(f"{path}/batch={i}")
    schema, merge = "key string, n int", generations.newest_by("key")
    assert generations.compact(spark, path, schema, merge) == 2 and generations.compact(spark, path, schema, merge) is None
    spark.createDataFrame([("wrong", 9)], schema).write.parquet(f"{path}/_generations/batch=3")
    os.remove(f"{path}/_generations/batch=3/_SUCCESS")
    rows = sorted((r["key"], r["n"], r["batch"]) for r in generations.read(spark, path, schema).collect())
    assert rows == [("k", 2, 2), ("k", 3, 3), ("k0", 0, 2), ("k1", 1, 2), ("k2", 2, 2), ("k3", 3, 3)]
    assert generations.read(spark, f"{path}-none", schema).count() == 0


def test_confirmation_of_ids_visible_at_any_time(spark, tmp_path):
    fin, vis = "upload_id string, finished_at timestamp", "upload_id string"
    out, visible = str(tmp_path / "out"), []
    steps = [([("early", minutes(5000)), ("soon", minutes(5000)), ("never", minutes(5000)), ("bad id!", minutes(5000)), ("gone", None)], ["early", "x"]),
             ([("other", minutes(5020))], ["early", "soon"]), ([("last", minutes(5031)), (None, minutes(9999))], ["early", "soon", "other", "other"])]
    for i, (rows, ids) in enumerate(steps):
        write(spark, str(tmp_path / "f"), rows, fin, f"f{i}")
        visible[:] = ids
        status.follow_confirmations(stream(spark, str(tmp_path / "f"), fin), lambda s: s.createDataFrame([(v,) for v in visible], vis),
                                    out, str(tmp_path / "check")).awaitTermination()
    got = {r["upload_id"]: r["confirmation"] for r in status.decided(spark, out).collect()}
    assert got == {"early": "confirmed", "soon": "confirmed", "never": "timeout", "gone": "timeout", "other": "confirmed", "last": "pending"}
    every = spark.createDataFrame([r for rows, _ in steps for r in rows], "upload_id string, updated_at timestamp_ntz")
    batch = ledger.confirm(every, spark.createDataFrame([(v,) for v in visible], vis), F.lit(minutes(5031)).cast("timestamp_ntz"))
    assert {r["upload_id"]: r["confirmation"] for r in batch.collect()} == got


def test_confirmation_times_out(spark, tmp_path):
    fin, vis = "upload_id string, finished_at timestamp", "upload_id string, visible_at timestamp"
    write(spark, str(tmp_path / "f"), [("a", minutes(0)), ("b", minutes(0)), ("c", minutes(50)), ("x", minutes(100)), ("e", minutes(5))], fin, "f1")
    write(spark, str(tmp_path / "v"), [("a", minutes(30)), ("b", minutes(31)), ("y", minutes(70)), ("e", minutes(4))], vis, "v1")
    joined = status.confirmations(stream(spark, str(tmp_path / "f"), fin), stream(spark, str(tmp_path / "v"), vis), "0 seconds", "1 day")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(discovery.batch_folder(str(tmp_path / "out"), batch_id))

    discovery.start(joined, keep, str(tmp_path / "check")).awaitTermination()
    rows = discovery.read_batches(spark, str(tmp_path / "out"), f"{fin}, visible_at timestamp, confirmation string")
    # c and x are still within their time
    assert {r["upload_id"]: r["confirmation"] for r in rows.collect()} == {
        "a": "confirmed", "b": "timeout", "e": "confirmed"}  # an id may be there before the run ends


def test_processing_isolates_failures_and_repeats_cleanly(spark, tmp_path):
    work = "package string, session string"
    write(spark, str(tmp_path / "w"), [("good", "s"), ("bad", "s")], work, "w1")

    def run(batch):
        return batch.select("package", F.when(F.col("package") == "bad", "cannot open").alias("error"))

    for check in ["one", "two"]:  # the second start repeats the batch, as after a lost checkpoint
        discovery.process(stream(spark, str(tmp_path / "w"), work), run, str(tmp_path / "out"),
                          str(tmp_path / check)).awaitTermination()
    rows = discovery.read_batches(spark, str(tmp_path / "out"), "package string, error string, status string").collect()
    assert sorted((r["package"], r["status"]) for r in rows) == [("bad", "failed"), ("good", "finished")]


def test_labels_once_per_client(spark, tmp_path):
    schema = "client_id string, ts timestamp, artifacts_with_results array<string>, os string, domain_role string"
    info = ["Generic.Client.Info/WindowsInfo"]
    for i in range(2):
        write(spark, str(tmp_path / "in"), [("c1", minutes(i), info, "windows", "Member Server"),
                                            ("c2", minutes(i), ["Other"], "linux", ""),
                                            ("c3", minutes(i), info, "linux", "Member Server")], schema, f"f{i}")
    out = reactions.labels(stream(spark, str(tmp_path / "in"), schema), "ts")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(discovery.batch_folder(str(tmp_path / "out"), batch_id))

    discovery.start(out, keep, str(tmp_path / "c"), mode="update").awaitTermination()
    rows = discovery.read_batches(spark, str(tmp_path / "out"), "client_id string, label string, first_seen timestamp")
    assert {(r["client_id"], r["label"]) for r in rows.collect()} == {("c1", "Server"), ("c3", "Linux")}
    assert rows.agg(F.min("first_seen")).first()[0] == minutes(0)


def test_a_status_entered_again(spark):
    rows = [("a", "new", minutes(0)), ("a", "processing", minutes(1)), ("a", "failed", minutes(2)), ("a", "unqueued", minutes(3)),
            ("a", "processing", minutes(50)), ("a", "processing", minutes(51)),
            ("b", "finished", minutes(1)), ("b", "processing", minutes(2)), ("b", "finished", minutes(3))]
    got = {r["package"]: (r["status"], r["entered_at"], r["illegal"]) for r in status.state_of(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"a": ("processing", minutes(50), False), "b": ("finished", minutes(3), True)}
