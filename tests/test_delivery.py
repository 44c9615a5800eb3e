"""Deliveries with leases around the intake, over archives on disk."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftlake import intake
from siftlake.sources import sinks
from siftlake.streaming import delivery, generations

T0 = datetime.datetime(2026, 1, 1)


def after(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


@pytest.fixture
def archives(tmp_path):
    def make(name, good=True):
        path = tmp_path / "in" / name
        path.parent.mkdir(exist_ok=True)
        if good:
            with zipfile.ZipFile(path, "w") as z:
                z.writestr("results/t.jsonl", "".join(json.dumps({"name": name, "n": i}) + "\n" for i in range(3)))
        else:
            path.write_bytes(b"PK broken")
        return str(path)

    return make


def messages(spark, *packages):
    return spark.createDataFrame([(p, 1, "disk") for p in packages], "package string, size long, source string")


def outcome(rows):
    return sorted((r["package"].rsplit("/", 1)[-1], r["attempts"], r["outcome"]) for r in rows.collect())


def test_broken_packages_are_tried_three_times_and_good_ones_once(spark, tmp_path, archives):
    root = str(tmp_path / "root")
    good, bad = archives("good.zip"), archives("bad.zip", good=False)
    delivery.offer(messages(spark, good, bad, bad, None), root, T0)
    assert outcome(delivery.poll(spark, root, "s", T0)) == [("bad.zip", 1, "retry"), ("good.zip", 1, "finished")]
    assert delivery.poll(spark, root, "s", after(29)).count() == 0  # hidden
    delivery.offer(messages(spark, good, bad), root, after(29))  # found again: bad is open, good is done
    assert outcome(delivery.poll(spark, root, "s", after(31))) == [("bad.zip", 2, "retry"), ("good.zip", 1, "finished")]
    assert outcome(delivery.poll(spark, root, "s", after(62))) == [("bad.zip", 3, "failed")]
    assert delivery.poll(spark, root, "s", after(1000)).count() == 0
    assert delivery.open_deliveries(spark, root).count() == 0
    current = {r["package"]: r["status"] for r in intake.current_status(spark, root).collect()}
    assert current == {"good.zip": "finished", "bad.zip": "failed"}
    rows = sinks.ArtifactTables(spark, f"{root}/tables").read("t").collect()
    assert sorted(r["n"] for r in rows) == [0, 1, 2]  # loaded once


def test_a_package_mended_before_its_last_attempt_finishes(spark, tmp_path, archives):
    root = str(tmp_path / "root")
    delivery.offer(messages(spark, archives("p.zip", good=False)), root, T0)
    delivery.poll(spark, root, "s", T0)
    path = archives("p.zip")
    assert outcome(delivery.poll(spark, root, "s", after(40))) == [("p.zip", 2, "finished")]
    assert [r["package"] for r in delivery.outcomes(spark, root).where("outcome = 'retry'").collect()] == [path]


def test_a_run_that_dies_keeps_its_claims(spark, tmp_path, archives, monkeypatch):
    root = str(tmp_path / "root")
    path = archives("p.zip")
    delivery.offer(messages(spark, path), root, T0)
    real = intake.intake_packages
    monkeypatch.setattr(intake, "intake_packages", lambda *a, **k: 1 / 0)
    for step in range(3):
        with pytest.raises(ZeroDivisionError):
            delivery.poll(spark, root, "s", after(31 * step))
        assert delivery.poll(spark, root, "s", after(31 * step + 1)).count() == 0
        assert [(r["attempts"], r["visible_at"]) for r in delivery.open_deliveries(spark, root).collect()] == [(step + 1, after(31 * step + 30))]
    monkeypatch.setattr(intake, "intake_packages", real)
    assert outcome(delivery.poll(spark, root, "s", after(200))) == [("p.zip", 3, "failed")]  # the attempts are used up
    assert intake.current_status(spark, root).select("status").first()[0] == "failed"


def test_an_incomplete_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "root")
    delivery.offer(messages(spark, "a.zip"), root, T0)
    spark.createDataFrame([], delivery.OPEN).write.parquet(f"{root}/_deliveries/batch=7")
    (tmp_path / "root/_deliveries/batch=7/_SUCCESS").unlink()
    assert generations.newest_complete(spark, f"{root}/_deliveries") == 0
    assert [r["package"] for r in delivery.open_deliveries(spark, root).collect()] == ["a.zip"]
    delivery.offer(messages(spark), root, T0)
    assert delivery.open_deliveries(spark, root).count() == 1


def test_stream_offers_and_runs(spark, tmp_path, archives):
    root = str(tmp_path / "root")
    paths = [archives("one.zip"), archives("two.zip", good=False)]
    messages(spark, *paths).coalesce(1).write.parquet(str(tmp_path / "work"))
    stream = spark.readStream.schema("package string, size long, source string").parquet(str(tmp_path / "work"))
    delivery.follow(stream, root, "s", str(tmp_path / "check"), T0).awaitTermination()
    assert outcome(delivery.outcomes(spark, root)) == [("one.zip", 1, "finished"), ("two.zip", 1, "retry")]
    assert delivery.open_deliveries(spark, root).where(F.col("attempts") == 1).count() == 1
