import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftlake.operators import rules
from siftlake.plans import io_queries
from siftlake.session import case_sensitive
from siftlake.sources import packages, records, sinks


def make_zip(members, nested=False):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    if not nested:
        return data.getvalue()
    return make_zip({"metadata.json": "{}", "inner/data.zip": data.getvalue()})


def encrypted(data, password):
    """The members of a stored zip, with the traditional encryption."""
    crc = [0] * 256
    for n in range(256):
        c = n
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        crc[n] = c
    keys = [0x12345678, 0x23456789, 0x34567890]

    def update(byte):
        keys[0] = (keys[0] >> 8) ^ crc[(keys[0] ^ byte) & 255]
        keys[1] = ((keys[1] + (keys[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        keys[2] = (keys[2] >> 8) ^ crc[(keys[2] ^ (keys[1] >> 24)) & 255]

    for b in password:
        update(b)
    out = bytearray()
    for b in data:
        k = keys[2] | 2
        out.append(b ^ (((k * (k ^ 1)) >> 8) & 255))
        update(b)
    return bytes(out)


def make_encrypted_zip(name, content, password):
    """One stored member; local header, directory and end record by hand."""
    import binascii
    import struct

    check = binascii.crc32(content)
    body = encrypted(b"\0" * 11 + bytes([check >> 24]) + content, password)
    common = struct.pack("<HHHHHIIIHH", 20, 1, 0, 0, 33, check, len(body), len(content), len(name), 0)
    local = b"PK\3\4" + common + name
    central = b"PK\1\2" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    start = len(local) + len(body)
    return local + body + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), start, 0)


def jsonl(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


@pytest.fixture
def store(tmp_path):
    files = {
        "a.zip": make_zip({"client_info.json": json.dumps({"hostname": "alpha", "os_info": {"fqdn": "x"}}, indent=1),
                           "results/Artifact.One.json": jsonl({"a": 1}, {"a": 2}), "uploads/raw.bin": "x", "results/": "",
                           "results/empty.json": ""}),
        "sub/b.ZIP": make_zip({"client_info.json": '{"os_info": {"fqdn": "beta.corp"}}',
                               "results/Artifact.Two.jsonl": jsonl({"b": "é"}) + "\n{broken"}, nested=True),
        "sub/c.zip": b"this is not a zip",
        "sub/notes.txt": b"x",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_listing(spark, store):
    assert {r["path"].rsplit("/", 1)[1] for r in packages.list_packages(spark, str(store)).collect()} == {"a.zip", "c.zip"}
    found = packages.find_packages(spark, [str(store), str(store / "sub")]).collect()
    names = [r["path"].rsplit("/", 1)[1] for r in found]
    assert names == ["a.zip", "b.ZIP", "c.zip"]
    tagged = packages.list_sources(spark, {"blob": str(store / "sub"), "sftp": str(store)})
    assert {r["source"]: r["packages"] for r in packages.packages_per_source(tagged).collect()} == {"blob": 1, "sftp": 2}
    plan = packages.list_packages(spark, str(store))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<content" not in plan


@pytest.fixture
def found(spark, store):
    return packages.find_packages(spark, [str(store)]).select(F.col("path").alias("package"))


def test_inventory(spark, found):
    rows = packages.member_inventory(found, tasks=3).collect()
    short = lambda p: p.rsplit("/", 1)[1]
    members = {(short(r["package"]), r["member"]): r for r in rows}
    assert members["a.zip", "results/"]["is_dir"] and members["a.zip", "results/empty.json"]["size"] == 0
    assert members["b.ZIP", "results/Artifact.Two.jsonl"]["container"] == "inner/data.zip"
    assert ("b.ZIP", "metadata.json") not in members
    assert members["c.zip", None]["error"]
    gates = {short(r["package"]): (r["raw_evidence"], r["is_encrypted"])
             for r in packages.has_raw_evidence(packages.member_inventory(found)).collect()}
    assert gates == {"a.zip": (True, False), "b.ZIP": (False, False), "c.zip": (False, None)}


def test_hosts(spark, found):
    registry = found.select("package", F.lit("from-registry").alias("registry_host"))
    hosts = packages.package_hosts(packages.client_infos(found), registry).collect()
    assert sorted(r["host"] for r in hosts) == ["alpha", "beta.corp", "from-registry"]
    assert sorted(r["host"] for r in packages.package_hosts(packages.client_infos(found)).collect()) == [
        "", "alpha", "beta.corp"]


def test_member_lines_to_tables(spark, found, tmp_path):
    members = packages.member_inventory(found)
    kept = rules.with_ignore_decision(members, rules.IgnoreRules(names=["client_info.json"])).where("not ignored_upload")
    from siftlake.functions import paths

    kept = kept.withColumn("table_name", paths.table_name(F.col("member"), "t_"))
    lines = packages.member_lines(kept, tasks=2)
    assert {(r["line_no"], r["line"]) for r in lines.collect()} == {
        (1, '{"a": 1}'), (2, '{"a": 2}'), (1, '{"b": "\\u00e9"}'), (2, ""), (3, "{broken")}
    store = sinks.ArtifactTables(spark, str(tmp_path / "tables"), "t_")
    named = lines.select(paths.table_name(F.col("member"), "t_").alias("table_name"),
                         F.concat_ws("/", "package", "member").alias("file"), F.col("line_no").alias("pos"), "line",
                         F.lit("h").alias("host"), "package", F.lit("id1").alias("upload"))
    outcome = {r["table_name"]: (r["rows"], r["error"]) for r in sinks.ingest(named, store, str(tmp_path / "raw")).collect()}
    assert outcome == {"t_Artifact_One": (2, None), "t_Artifact_Two": (1, None)}
    assert store.read("t_Artifact_Two").select("b", "src_host", "src_upload").first() == ("é", "h", "id1")


def test_password(spark, tmp_path):
    (tmp_path / "my 100%2F.zip").write_bytes(make_encrypted_zip(b"results/a.json", b'{"a": 1}\n', b"secret"))
    found = packages.list_packages(spark, str(tmp_path)).select(F.col("path").alias("package"))
    members = packages.member_inventory(found)
    assert members.first()["encrypted"] is True
    assert packages.has_raw_evidence(members).first()["is_encrypted"] is True
    assert packages.member_lines(members, password="secret").first()["line"] == '{"a": 1}'
    for given in [None, "wrong"]:
        row = packages.member_lines(members, password=given).first()
        assert row["line"] is None and row["error"]


def test_batches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packages, "BYTES_PER_BATCH", 50)
    archive = zipfile.ZipFile(io.BytesIO(make_zip({"a.json": jsonl(*[{"x": "y" * 30}] * 7)})))
    assert [len(b) for b in packages._member_lines("p", archive, ["a.json"])] == [2, 2, 2, 1]


def test_package_lines_equal_member_lines(spark, found):
    members = packages.member_inventory(found).where("size > 0 and (member like '%.json' or member like '%.jsonl')")
    one = {tuple(r) for r in packages.member_lines(members).collect()}
    two = {tuple(r) for r in packages.package_lines(found).where("line is not null").collect()}
    assert one == two and one


def test_jsonl_positions_follow_the_file(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(5000)))
    (tmp_path / "y.txt").write_text("{}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = records.read_jsonl(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        ordered = [r["line"] for r in lines.orderBy("file", "pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [f'{{"n": {i}}}' for i in range(5000)]


def test_table_evolution_and_failures(spark, tmp_path):
    store = sinks.ArtifactTables(spark, str(tmp_path / "t"), "ev_")
    assert store.columns("ev_x") is None
    one = spark.createDataFrame([(1, "a")], "id bigint, src_host string")
    two = spark.createDataFrame([("x", 2.5, "b")], "id string, extra double, src_host string")
    assert store.append(one, "ev_x")[1:3] == (1, True)
    assert store.append(two, "ev_x")[1:3] == (1, True)
    assert store.read("ev_x").columns == ["id", "extra", "src_host"]
    assert {tuple(r) for r in store.read("ev_x").collect()} == {(1, None, "a"), (None, 2.5, "b")}
    broken = spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("id"))
    result = store.append(broken, "ev_y")
    assert result[2] is False and result[4]
    assert store.results([result]).count() == 1
    assert store.table_name("out/Windows.Usn.json.part3") == store.table_name("Windows.Usn.json") == "ev_Windows_Usn"
    with pytest.raises(ValueError):
        store.read("ev_none")


def test_csv_and_formats(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', 1, [1, 2])], "a string, b int, c array<int>")
    sinks.export_csv(df.drop("c").coalesce(1), str(tmp_path / "e"))
    text = "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    assert text.splitlines() == ['"a","b"', '"say ""hi"", you","1"']
    sinks.write_format(df, str(tmp_path / "f"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "f")).first()
    assert tuple(back) == ('say "hi", you', "1", "[1,2]")
    with pytest.raises(ValueError):
        sinks.write_format(df, str(tmp_path / "g"), "xml")


def test_snapshots_keep_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "s")
    make = lambda rows: sinks.snapshot_documents(spark.createDataFrame(rows, "uploadid string, state string"), "summary")
    sinks.write_snapshots(make([("a", "uploading"), ("b", "uploading")]), path, 1)
    sinks.write_snapshots(make([("a", "finished")]), path, 2)
    got = {r["upload_id"]: json.loads(r["document"])["state"] for r in sinks.read_snapshots(spark, path).collect()}
    assert got == {"a": "finished", "b": "uploading"}


def test_names_differing_in_case_are_two_columns(spark, tmp_path):
    store = sinks.ArtifactTables(spark, str(tmp_path / "t"))
    rows = [("T", "f1", 1, '{"Name": 1, "name": "x"}'), ("T", "f2", 1, '{"NAME": true}')]
    lines = spark.createDataFrame(rows, "table_name string, file string, pos bigint, line string").selectExpr(
        "*", "'h' AS host", "'p' AS package", "'u' AS upload")
    assert sinks.ingest(lines, store, str(tmp_path / "raw"), run="r").first()["error"] is None
    with pytest.raises(ValueError, match="caseSensitive"):
        store.read("T")
    with case_sensitive(spark):
        got = {tuple(r)[:3] for r in store.read("T").collect()}
        assert store.read("T").columns[:3] == ["NAME", "Name", "name"]
    assert got == {(None, 1, "x"), (True, None, None)}
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_stores_that_packages_open_from():
    assert packages.store_of("/a/b c.zip") == ("direct", "file", "///a/b c.zip")
    assert packages.store_of("s3a://bucket/x.zip") == ("direct", "s3", "//bucket/x.zip")
    assert packages.store_of("wasbs://c@account.example/x.zip")[0] == "hadoop"
    with pytest.raises(ValueError):
        packages.store_of("gopher://x/y.zip")


def nested_zip(members, method):
    """A package whose evidence is an inner archive, stored or compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("metadata.json", "{}")
        z.writestr("deep/data.zip", make_zip(members))
    return out.getvalue()


MEMBERS = {"client_info.json": '{"hostname": "gamma"}', **{f"results/t{i}.jsonl": jsonl(*[{"i": i, "pad": f"{i}-{n}" * 50} for n in range(200)]) for i in range(20)}}


@pytest.mark.parametrize("method, unpacked", [(zipfile.ZIP_STORED, False), (zipfile.ZIP_DEFLATED, True)])
def test_inner_archives_are_unpacked_once_or_read_in_place(spark, tmp_path, method, unpacked):
    path = tmp_path / "in" / "p a%20.zip"
    path.parent.mkdir()
    path.write_bytes(nested_zip(MEMBERS, method))
    plain = tmp_path / "in" / "plain.zip"
    plain.write_bytes(make_zip({"results/x.jsonl": jsonl({"x": 1})}))
    broken = tmp_path / "in" / "broken.zip"
    broken.write_bytes(nested_zip(MEMBERS, method).replace(b"PK\x01\x02", b"PK\x09\x09"))
    rows = spark.createDataFrame([(f"file://{p}",) for p in (path, plain, broken)], "package string")
    where = packages.unpack_inner(rows, str(tmp_path / "inner dir"), tasks=2)
    found = {r["package"].rsplit("/", 1)[1]: (r["unpacked"] is not None, r["unpacked_name"]) for r in where.collect()}
    assert found["p a%20.zip"] == (unpacked, "deep/data.zip" if unpacked else None)
    assert found["plain.zip"] == found["broken.zip"] == (False, None)
    opened = rows.join(where, "package", "left")
    stored = str(tmp_path / "opened")
    opened.write.parquet(stored)
    opened = spark.read.parquet(stored)
    assert len(list((tmp_path / "inner dir").glob("*"))) == int(unpacked)
    members = packages.member_inventory(opened, tasks=2)
    assert {(r["member"], r["container"]) for r in members.where("container is not null").collect()} == {(m, "deep/data.zip") for m in MEMBERS}
    hosts = {r["host"] for r in packages.package_hosts(packages.client_infos(opened)).collect()}
    assert hosts == {"gamma", ""}
    kept = members.where("member like 'results/%'").join(opened, "package")
    lines = {(r["member"], r["line_no"], r["line"]) for r in packages.member_lines(kept, tasks=9).collect()}
    assert len(lines) == 20 * 200 + 1
    if unpacked:  # the package itself is not opened for its lines
        path.unlink()
        stored = str(tmp_path / "kept")
        spark.createDataFrame([(f"file://{path}", "results/t3.jsonl", *opened.where("unpacked is not null").select("unpacked", "unpacked_name").first())],
                              "package string, member string, unpacked string, unpacked_name string").write.parquet(stored)
        again = packages.member_lines(spark.read.parquet(stored), tasks=4)
        assert again.where("error is null").count() == 200


def test_a_stored_inner_archive_is_read_by_ranges():
    class Counting(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.seen += len(data)
            return data

    rng = random.Random(1)
    big = {f"m{i}.jsonl": "".join(chr(rng.randrange(32, 120)) for _ in range(300_000)) for i in range(30)}
    data = nested_zip(big, zipfile.ZIP_STORED)
    with zipfile.ZipFile(Counting(data)) as outer:
        inner, name = packages._resolve_nested(outer, None)
        assert name == "deep/data.zip" and inner.read("m29.jsonl").decode() == big["m29.jsonl"]
    assert Counting.seen < len(data) / 2


def test_a_package_with_a_compressed_inner_archive_is_taken_in(spark, tmp_path):
    from siftlake import intake

    path = tmp_path / "p.zip"
    path.write_bytes(nested_zip({"client_info.json": '{"hostname": "g"}', "results/t.jsonl": jsonl({"n": 1}, {"n": 2})}, zipfile.ZIP_DEFLATED))
    listing = spark.createDataFrame([(f"file://{path}", 1, "disk")], "package string, size long, source string")
    uploads = intake.intake_packages(spark, listing, str(tmp_path / "root"), "s", ignore=rules.IgnoreRules(paths=["client_info.json"]))
    assert {(r["location_in_zip"], r["upload_initiated"]) for r in uploads.collect()} == {("client_info.json", False), ("results/t.jsonl", True)}
    rows = sinks.ArtifactTables(spark, str(tmp_path / "root/tables")).read("t").collect()
    assert sorted((r["n"], r["src_host"]) for r in rows) == [(1, "g"), (2, "g")]
    assert len(list((tmp_path / "root/_work").glob("*/inner/*.zip"))) == 1


def test_members_of_one_table_are_many_tasks_by_their_bytes(spark):
    rows = [("/no/such.zip", f"results/{i}.jsonl", 10 << 20, "A", "h", "u") for i in range(64)]
    members = spark.createDataFrame(rows, "package string, member string, size long, table_name string, host string, upload_id string")
    lines = packages.member_lines(members, 8, carry=("table_name", "host", "upload_id"))
    tasks = lines.select("member", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 64 and len({r["task"] for r in tasks}) > 3


def test_packages_come_in_pieces_that_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Who opens packages gets no more of them at once from a larger table."""
    monkeypatch.setattr(io_queries, "_TASK_BYTES", 100_000, raising=False)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    kept, rng, largest = spark.conf.get(coalesce), random.Random(1), []
    spark.conf.set(coalesce, "false")
    for documents in (2_000, 8_000):
        rows = [(i, "s", f"{rng.getrandbits(4000):x}") for i in range(documents)]
        spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/{documents}/documents.parquet")
        made = io_queries._packages(spark, f"{tmp_path}/{documents}")
        pieces = made.mapInPandas(lambda batches: (b[["package"]].iloc[:1].assign(n=len(b), size=b["content"].map(len).sum()) for b in batches),
                                  "package string, n long, size long").collect()
        assert sum(r["n"] for r in pieces) == documents // 20
        largest.append(max(r["size"] for r in pieces))
    spark.conf.set(coalesce, kept)
    assert largest[1] < 1.6 * largest[0]


def test_no_documents_make_no_packages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert io_queries._packages(spark, str(tmp_path)).count() == 0
