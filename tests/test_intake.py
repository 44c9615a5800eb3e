import datetime

import pytest
from pyspark.sql import functions as F

from siftlake import intake
from siftlake.operators import rules
from siftlake.operators.ledger import requeue
from siftlake.sources import packages, sinks
from tests.test_packages import jsonl, make_zip, store  # noqa: F401

NOW = datetime.datetime(2026, 1, 1)


@pytest.fixture
def listing(spark, store):  # noqa: F811
    return packages.list_files(spark, str(store)).where(F.lower("path").endswith(".zip")).select(
        F.col("path").alias("package"), "size", F.lit("blob").alias("source"))


def run(spark, listing, root, session, **kw):
    return intake.intake_packages(spark, listing, root, session, rules.IgnoreRules(names=["client_info.json"]), "t_",
                                  now=kw.pop("now", NOW), tasks=2, **kw)


def test_packages_to_tables_and_ledgers(spark, listing, tmp_path):
    root = str(tmp_path / "lake")
    uploads = {(r["zipfile"], r["location_in_zip"]): r for r in run(spark, listing, root, "s1").collect()}
    assert uploads["a.zip", "results/Artifact.One.json"]["upload_initiated"] is True
    assert uploads["a.zip", "client_info.json"]["ignored_reason"] == "name_rule"
    assert uploads["a.zip", "results/empty.json"]["ignored_reason"] == "empty"
    assert uploads["b.ZIP", "results/Artifact.Two.jsonl"]["upload_initiated"] is True
    tables = sinks.ArtifactTables(spark, f"{root}/tables", "t_")
    one = tables.read("t_Artifact_One").orderBy("a").collect()
    assert [(r["a"], r["src_host"], r["src_package"]) for r in one] == [(1, "alpha", "a.zip"), (2, "alpha", "a.zip")]
    assert tables.read("t_Artifact_Two").first()["src_host"] == "beta.corp"
    status = {r["package"]: r["status"] for r in intake.current_status(spark, root).collect()}
    assert status == {"a.zip": "finished", "b.ZIP": "finished", "c.zip": "failed"}
    summary = spark.read.parquet(f"{root}/ledgers/summary").collect()
    assert {r["zipfile_basename"]: (r["hostname"], r["is_encrypted"]) for r in summary} == {
        "a.zip": ("alpha", False), "b.ZIP": ("beta.corp", False), "c.zip": ("", None)}

    logs = spark.read.parquet(f"{root}/ledgers/logs").collect()
    assert [(r["zipfile"], r["level"]) for r in logs] == [("c.zip", "ERROR")]
    snapshots = sinks.read_snapshots(spark, f"{root}/snapshots")
    assert snapshots.where("section = 'summary'").count() == 3
    assert snapshots.where("section = 'uploads'").count() == len(uploads)

    # the same session again replaces its rows; another session finds nothing to do
    run(spark, listing, root, "s1")
    assert tables.read("t_Artifact_One").count() == 2 and spark.read.parquet(f"{root}/ledgers/uploads").count() == len(uploads)
    assert sinks.read_snapshots(spark, f"{root}/snapshots").count() == snapshots.count()


def test_gate_between_sessions(spark, listing, tmp_path):
    names = listing.withColumn("package", F.element_at(F.split("package", "/"), -1))
    root = str(tmp_path / "lake")
    assert intake.eligible(listing, root, "s1").count() == 3
    run(spark, listing, root, "s1")
    assert intake.eligible(listing, root, "s2").count() == 0
    assert intake.eligible(listing, root, "s2", use_ledger=False).count() == 3
    again = requeue(intake.current_status(spark, root), names.where("package = 'c.zip'"),
                    F.lit("2026-02-01").cast("timestamp")).withColumn("seq", F.lit(3))
    again.write.parquet(f"{root}/_status/run=retry/start")
    assert [r["package"].rsplit("/", 1)[1] for r in intake.eligible(listing, root, "s2").collect()] == ["c.zip"]


def test_queue_to_tables(spark, listing, tmp_path):
    from siftlake.streaming.status import state_of

    root, at = str(tmp_path / "lake"), lambda m: NOW + datetime.timedelta(minutes=m)
    large = listing.agg(F.max("size")).first()[0]
    messages = intake.queue_packages(spark, listing, root, "w1", threshold=large, now=at(0))
    assert sorted(r["batch_kind"] for r in messages.collect()) == ["large", "small"]
    assert intake.eligible(listing, root, "x").count() == 0  # queued
    assert intake.queue_packages(spark, listing, root, "w2", threshold=large, now=at(1)).count() == 0
    taken = intake.take_messages(messages, root, "c1", now=at(2))
    assert taken.count() == 3 and intake.eligible(taken, root, "x").count() == 3
    run(spark, taken, root, "p1", now=at(3))
    events = spark.read.schema(intake.STATUS).option("recursiveFileLookup", True).parquet(f"{root}/_status")
    assert set(events.groupBy("status").count().collect()) == {
        ("new", 3), ("queued", 3), ("unqueued", 3), ("processing", 3), ("finished", 2), ("failed", 1)}
    # `new` and `queued` share a time, `processing` and the end as well: order by rank
    assert {r["package"]: (r["status"], r["illegal"]) for r in state_of(events).collect()} == {
        "a.zip": ("finished", False), "b.ZIP": ("finished", False), "c.zip": ("failed", False)}
    with pytest.raises(ValueError):
        intake.take_messages(messages, root, "no/slash")


def test_host_filter_reaches_the_scan(spark, listing, tmp_path):
    root = str(tmp_path / "lake")
    run(spark, listing, root, "s1")
    rows = sinks.ArtifactTables(spark, f"{root}/tables", "t_").read("t_Artifact_One").where("src_host = 'alpha'").select("a")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src_host,alpha)" in plan and "ReadSchema: struct<a:bigint,src_host:string>" in plan


def test_folder(spark, tmp_path):
    folder = tmp_path / "host one"
    (folder / "sub").mkdir(parents=True)
    (folder / "A.jsonl").write_text(jsonl({"x": 1}))
    (folder / "empty.jsonl").write_text("")
    (folder / "skip.jsonl").write_text(jsonl({"x": 1}))
    (folder / "sub" / "B.jsonl").write_text(jsonl({"y": "2024-01-05"}))
    (folder / "client_info.json").write_text('{"hostname": "no", "os_info": {"fqdn": "f.corp"}}')
    root = str(tmp_path / "lake")
    ignore = rules.IgnoreRules(names=["skip*"])
    assert [r["table_name"] for r in intake.intake_folder(spark, str(folder), root, "s1", False, ignore).collect()] == ["A"]
    both = intake.intake_folder(spark, str(folder), root, "s2", True, ignore).collect()
    assert {r["table_name"]: r["rows"] for r in both} == {"A": 1, "B": 1}
    row = sinks.ArtifactTables(spark, f"{root}/tables").read("B").first()
    assert (row["y"].date(), row["src_host"], row["src_package"]) == (datetime.date(2024, 1, 5), "f.corp", "host one")


def test_calls_of_one_session_keep_their_rows(spark, listing, tmp_path):
    root = str(tmp_path / "lake")
    name = F.element_at(F.split("package", "/"), -1)
    for package in ("a.zip", "b.ZIP", "a.zip"):  # the third repeats the first
        run(spark, listing.where(name == package), root, "s1", use_ledger=False)
    tables = sinks.ArtifactTables(spark, f"{root}/tables", "t_")
    assert tables.read("t_Artifact_One").count() == 2 and tables.read("t_Artifact_Two").count() >= 1
    assert {r["package"]: r["status"] for r in intake.current_status(spark, root).collect()} == {"a.zip": "finished", "b.ZIP": "finished"}
    assert spark.read.parquet(f"{root}/ledgers/summary").count() == 2


def test_nothing_of_a_package_is_lost(spark, tmp_path):
    lines = [{"n": i} for i in range(1100)]
    lines[1050]["late"] = "20240101"
    body = jsonl(*lines[:600]) + "{broken\n" + "[1, 2]\n" + jsonl(*lines[600:])
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.zip").write_bytes(make_zip({"results/Long.jsonl": body, "results/Bad.json": "no json at all"}))
    (folder / "inner.zip").write_bytes(make_zip({"data.zip": b"this is no archive", "results/X.json": jsonl({"a": 1})}))
    listing = packages.list_packages(spark, str(folder)).select(F.col("path").alias("package"), "size", F.lit("blob").alias("source"))
    root = str(tmp_path / "lake")
    uploads = {r["location_in_zip"]: r for r in intake.intake_packages(spark, listing, root, "s1", prefix="t_", tasks=2).collect()}
    table = sinks.ArtifactTables(spark, f"{root}/tables", "t_").read("t_Long")
    assert table.count() == 1100
    assert [r["late"] for r in table.where("late is not null").collect()] == [datetime.datetime(2024, 1, 1)]
    rejects = spark.read.parquet(f"{root}/rejects/lines").collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["pos"], r["line"]) for r in rejects) == [
        ("Bad.json", 1, "no json at all"), ("Long.jsonl", 601, "{broken"), ("Long.jsonl", 602, "[1, 2]")]
    assert uploads["results/Bad.json"]["upload_initiated"] is False and uploads["results/Bad.json"]["upload_error"]
    assert {r["package"]: r["status"] for r in intake.current_status(spark, root).collect()} == {"good.zip": "finished", "inner.zip": "failed"}
    logs = spark.read.parquet(f"{root}/ledgers/logs").collect()
    assert any("data.zip does not open" in r["message"] for r in logs)


def test_failed_packages_are_tried_again_up_to_a_limit(spark, listing, tmp_path):
    root = str(tmp_path / "lake")
    run(spark, listing, root, "s1")
    names = lambda n: [r["package"].rsplit("/", 1)[1] for r in intake.eligible(listing, root, "s9", max_retry=n).collect()]
    assert names(0) == [] and names(1) == ["c.zip"]


def test_bad_messages_are_kept(spark, tmp_path):
    messages = spark.createDataFrame([("not a message",)], "message string")
    root = str(tmp_path / "lake")
    assert intake.take_messages(messages, root, "c1").count() == 0
    assert [r["message"] for r in spark.read.parquet(f"{root}/rejects/messages").collect()] == ["not a message"]


def test_collected_files_of_one_type_are_bounded(spark, tmp_path, monkeypatch):
    from siftlake.plans import folder_queries

    monkeypatch.setattr(folder_queries, "_FILE_ROWS", 10)
    rows = [(i, datetime.datetime(2024, 1, 5), ["click", "error", "click", None][i % 4], float(i)) for i in range(200)] + [(0, datetime.datetime(2024, 1, 5), "click", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(folder_queries, "scratch_path", lambda spark, purpose: str(tmp_path / purpose))
    got = folder_queries.folder_intake(spark, str(tmp_path)).collect()
    files = list((tmp_path / "folder-intake" / "collected").rglob("click.jsonl"))
    sizes = [len(f.read_text().splitlines()) for f in files]
    assert sum(sizes) == 101 and max(sizes) < 50 and len(files) > 4
    assert sorted(r["event_id"] for r in got) == sorted(r[0] for r in rows if r[2] == "click")
    assert {(r["table_name"], r["src_host"], r["src_package"]) for r in got} == {("ev_click", "host-f", "collected")}
