import struct

import pytest
from pyspark.sql import functions as F

from siftlake import artifacts
from siftlake.artifacts import execution, registry, system, userhives

VALUES = ("type string, hive string, name string, value binary, mtime timestamp, key string, username string, "
          "sid string, data_type string, src_host string")


def mru(spark, rows):
    import datetime

    t = datetime.datetime(2024, 1, 5)
    return spark.createDataFrame([(ty, hv, n, bytearray(v), t, "k", "bob", "S-1", "BINARY", h) for h, ty, hv, n, v in rows], VALUES)


def item(name):
    return name.encode("utf-16-le") + b"\0\0\x01\x02"


def order(*numbers):
    return struct.pack(f"<{len(numbers) + 1}I", *numbers, 0xFFFFFFFF)


def test_recent_docs(spark):
    values = mru(spark, [
        ("h1", ".txt", "u1", "MRUListEx", order(2, 0, 2, 1)), ("h1", ".txt", "u1", "0", item("zero")),
        ("h1", ".txt", "u1", "1", item("one")), ("h1", ".txt", "u1", "2", item("two")),
        # another host and hive must not lend its items
        ("h2", ".txt", "u1", "MRUListEx", order(0, 1)), ("h2", ".txt", "u1", "0", item("other")),
        ("h1", ".doc", "u1", "MRUListEx", order(7, 0)), ("h1", ".doc", "u1", "0", item("x")),
        ("h1", ".pdf", "u1", "MRUListEx", order()),
    ])
    got = {(r["src_host"], r["type"]): r["mru_entries"] for r in userhives.recent_docs(values).collect()}
    assert got == {("h1", ".txt"): ["2 := two", "0 := zero", "1 := one"], ("h2", ".txt"): ["0 := other", None],
                   ("h1", ".doc"): None, ("h1", ".pdf"): None}
    assert userhives.recent_docs(values, entry_regex="TWO").count() == 1
    assert userhives.recent_docs(values, date_after="2024-01-05").count() == 0
    assert "username" not in userhives.recent_docs(values, user_regex="nobody", offline=True).columns
    assert userhives.recent_docs(values, user_regex="nobody", offline=True).count() == 4


def test_bam_takes_one_name_per_sid(spark):
    values = spark.createDataFrame([("S-1", "a.exe", bytearray(struct.pack("<q", 133480000000000000)), "REG_BINARY"),
                                    ("S-2", "b.exe", bytearray(b"\x01"), "REG_BINARY")],
                                   "sid string, binary string, value binary, data_type string")
    users = spark.createDataFrame([("S-1", "zoe"), ("S-1", "amy")], "sid string, name string")
    got = {r["sid"]: (r["username"], str(r["bam_time"])) for r in execution.bam(values, users).collect()}
    assert got == {"S-1": ("amy", "2023-12-25 17:46:40"), "S-2": (None, "None")}


def test_evidence_kinds(one):
    got = [one(system.evidence_kind(F.lit(p)))[0] for p in [
        "uploads/auto/C%3A/Users/bob/NTUSER.DAT", "uploads/auto/C%3A/Windows/System32/config/security",
        "uploads/ntfs/%5C%5C.%5CD%3A/$MFT", "uploads/auto/C%3A/", "x/appcompat/Programs/Amcache.hve",
        "uploads/auto/C%3A/Users/bob/AppData/UsrClass.dat", "uploads/auto/C%3A/Users/a/b/NTUSER.DAT", "other"]]
    assert got == ["user_hive", "system_hive", "mft", "file_tree", "amcache", "usrclass", None, None]


def test_rows_without_both_structures_are_dropped(spark):
    values = spark.createDataFrame([("a", "SAM", bytearray(b"\0" * 80), None), ("b", "SAM", bytearray(b""), bytearray(b"\0"))],
                                   "key string, hive string, f binary, v binary")
    assert system.sam_accounts(values).count() == 0


def test_role_order(one):
    label = lambda os, role: one(system.role_label(F.lit(os), F.lit(role)))[0]
    assert [label("Linux", "Server"), label("w", "Member Workstation Server"), label("w", "Backup Domain Controller"),
            label("w", "x")] == ["Linux", "Workstation", "Domain Controller", None]


def test_selection_keeps_order():
    assert artifacts.selected({"default": ["b()", "a()", "b()", "c()"], "skip": ["c()"]}) == ["b()", "a()", "c()"]
    assert artifacts.selected({}) == []


def test_lists_grow_only_by_unknown_names():
    lists = {"default": ["a(x=1)"], "skip": ["b()"]}
    assert artifacts.add_to_list(lists, "a") == lists and artifacts.add_to_list(lists, "b") == lists
    assert artifacts.add_to_list(lists, "c", "skip")["skip"] == ["b()", "c()"]
    with pytest.raises(ValueError):
        artifacts.add_to_list(lists, "d", "other")


def test_registry(spark, tmp_path):
    with pytest.raises(TypeError):
        artifacts.get("Usn")({"journal": spark.range(1)}, nonsense=1)
    assert ("Usn", "date_after", "", "timestamp") in artifacts.describe()
    registry.register("Mine", lambda t, factor=2: t.select((F.col("id") * factor).alias("x")), ["numbers"],
                      [registry.Parameter("factor", 2, "int")])
    registry.register("Fails", lambda t: t.select(F.raise_error(F.lit("boom"))), ["numbers"])
    tables = {"numbers": spark.range(7)}
    rows = {r["artifact"]: r for r in artifacts.collect(
        spark, [("Fails", {}), ("Mine", {"factor": 3})], tables, str(tmp_path / "o")).collect()}
    assert (rows["Mine"]["success"], rows["Mine"]["rows"], rows["Mine"]["returncode"]) == (True, 7, 0)
    assert rows["Mine"]["size"] > 100  # bytes written
    assert rows["Fails"]["success"] is False and rows["Fails"]["error"]
    assert spark.read.parquet(rows["Mine"]["fullpath"]).agg(F.max("x")).first()[0] == 18


def test_time_limit(spark, tmp_path):
    import time

    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    registry.register("Slow", lambda t: t.mapInPandas(slow, "id bigint"), ["numbers"])
    start = time.time()
    row = artifacts.collect(spark, [("Slow", {})], {"numbers": spark.range(1)}, str(tmp_path / "o"), time_limit=2).first()
    assert row["success"] is False and time.time() - start < 15


def test_remote_desktop_users_without_a_name(spark):
    import datetime

    t = datetime.datetime(2024, 1, 5)
    base = r"Software\Microsoft\Terminal Server Client"
    rows = [("S-1", None, r"C:\Users\ann\NTUSER.DAT", base + r"\Servers\srv1", "UsernameHint", b"adm", t, "SZ"),
            ("S-1", None, r"C:\Users\ann\NTUSER.DAT", base + r"\Servers\srv1", "CertHash", b"\x01\xff", t, "BINARY"),
            ("S-1", None, r"C:\Users\ann\NTUSER.DAT", base + r"\Default", "MRU1", b"two", t, "SZ"),
            ("S-1", None, r"C:\Users\ann\NTUSER.DAT", base + r"\Default", "MRU0", b"one", t, "SZ"),
            ("S-1", None, r"C:\Users\ann\NTUSER.DAT", base + r"\Default", "MRU0", b"old", t - datetime.timedelta(1), "SZ")]
    values = spark.createDataFrame([(*r[:5], bytearray(r[5]), *r[6:]) for r in rows],
                                   "sid string, username string, hive string, key string, key_name string, "
                                   "value binary, mtime timestamp, data_type string")
    server = userhives.rdp_servers(values).collect()
    assert [(r["username"], r["server"], r["username_hint"], r["cert_hash"]) for r in server] == [("ann", "srv1", "adm", "01ff")]
    assert [(r["username"], r["mru"]) for r in userhives.rdp_mru(values).collect()] == [("ann", ["one", "two"])]
    assert userhives.rdp_servers(values, user_regex="bob").count() == 0


def test_usn_defaults_keep_every_row(spark):
    journal = spark.createDataFrame([("C:", "2024-01-05", None, "/a", [], 5, None)],
                                    "drive string, t string, filename string, os_path string, links array<string>, "
                                    "mft_id bigint, parent_mft_id bigint").select(
        "*", F.col("t").cast("timestamp").alias("timestamp"), *[F.lit(1).alias(c) for c in [
            "reason", "sequence", "parent_sequence", "file_attributes", "source_info", "usn"]])
    assert execution.usn(journal).first()["os_path"] == "C:/a"
    assert execution.usn(journal, path_regex="a").count() == 0
    assert execution.usn(journal, date_before="2024-01-05").count() == 0


def test_account_values_of_one_split_are_packed_by_many_tasks_and_once(spark, tmp_path):
    from siftlake.plans import artifact_queries

    rows = [(i, f"Customer#{i:09d}", i % 25, "BUILDING") for i in range(1, 200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    values = artifact_queries._sam_values(spark, str(tmp_path))
    assert len(values.inputFiles()) > 8 and "customer.parquet" not in "".join(values.inputFiles())
    found = {r["key"]: r for r in artifact_queries.sam_accounts(spark, str(tmp_path)).collect()}
    assert len(found) == sum(i % 10 != 0 for i in range(1, 200))
    assert found["Users\\7"]["fullname"] == "Full Customer#000000007" and found["Users\\7"]["rid"] == 7
