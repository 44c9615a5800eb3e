import datetime
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import binary, documents, paths, text, times
from siftlake.operators import rules


@pytest.mark.parametrize("value, expected", [
    ("2024-01-05", True), ("2024-01-05T10:00:00Z", True), ("2024-01-05 10", True), ("20240105", True),
    ("20240105T101112", True), ("2024-W01-1", True), ("2024W011", True), ("2024-01-05T10:00:00.1234567+02:00", True),
    (" 2024-01-05\n", True), ("2024", False), ("12:00", False), ("2024-13-01", False), ("2024-02-30", False),
    ("2023-W53-1", False), ("2020-W53-1", True), ("x", False), ("", False), ("2024-01-05T25:00", False),
    ("0000-01-01", False), ("2024-1-5", False),
])
def test_iso(one, value, expected):
    assert one(times.is_iso_datetime(F.lit(value)))[0] is expected


def test_tolerant_time(one):
    far = datetime.datetime(1, 1, 1)
    got = one(times.parse_time(F.lit("2026-11-01T10:00:00Z")).cast("timestamp_ntz"),
              times.parse_time(F.lit("nonsense")).cast("timestamp_ntz"),
              times.parse_time(F.lit(None).cast("string")).cast("timestamp_ntz"))
    assert got == (datetime.datetime(2026, 11, 1, 10), far, far)


@pytest.mark.parametrize("size, report, short", [
    (0, "0 B", "-"), (532, "532 B", "532 B"), (1024, "1.00 KB", "1.0 KB"), (1152, "1.12 KB", "1.1 KB"),
    (1280, "1.25 KB", "1.3 KB"), (1234567, "1.18 MB", "1.2 MB"), (5 * 1024**4, "5.00 TB", "5.0 TB"),
    (3 * 1024**5, "3072.00 TB", "3072.0 TB"),
])
def test_sizes(one, size, report, short):
    value = F.lit(size).cast("bigint")
    assert one(text.size_text(value), text.size_text_short(value)) == (report, short)


def test_size_without_tb(one):
    assert one(text.size_text_short(F.lit(5 * 1024**4), units=4))[0] == "5120.0 GB"


@pytest.mark.parametrize("seconds, hms, ms, clock", [
    (0, "0h 0m 0s", "0m 0s", "0:00"), (65.9, "0h 1m 5s", "1m 5s", "1:05"), (3725, "1h 2m 5s", "62m 5s", "1:02:05"),
])
def test_durations(one, seconds, hms, ms, clock):
    s = F.lit(seconds)
    assert one(text.duration_hms(s), text.duration_ms(s), text.duration_clock(s)) == (hms, ms, clock)


def test_run_duration(one):
    now, start = F.lit("2026-01-01 01:00:05").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")
    none = F.lit(None).cast("string")
    assert one(times.run_duration(F.lit("Finished"), F.lit("5s"), start, now),
               times.run_duration(F.lit("finished"), none, start, now),
               times.run_duration(F.lit("uploading"), F.lit("5s"), start, now),
               times.run_duration(F.lit("uploading"), none, F.lit(None).cast("timestamp"), now)) == (
        "5s", "-", "1h 0m 5s", "-")


@pytest.mark.parametrize("path, base, stem, ext", [
    ("a/b.tar.gz", "b.tar.gz", "b.tar", ".gz"), (".hidden", ".hidden", ".hidden", ""), ("a/", "", "", ""),
    ("name", "name", "name", ""),
])
def test_paths(one, path, base, stem, ext):
    p = F.lit(path)
    assert one(paths.basename(p), paths.stem(p), paths.extension(p)) == (base, stem, ext)


def test_sanitize(one):
    value = "a [b]  c\t\n.d-é"
    expected = "a__b__c__d__"
    assert one(paths.sanitize_name(F.lit(value)))[0] == expected == paths.sanitize_name_py(value)


def test_url_decode(one):
    got = one(paths.url_decode(F.lit("a%2Fb+c%5C")), paths.url_decode(F.lit("100%")))
    assert got == ("a/b+c\\", "100%")


@pytest.mark.parametrize("glob, value, hit", [
    ("uploads/*", "uploads/a/b", True), ("*.json", "A.JSON", False), ("a?c", "abc", True), ("a?c", "ac", False),
    ("[!a]*", "abc", False), ("[a-c]x", "bx", True), ("a.b", "axb", False), ("a[", "a[", True),
    ("x%2Fy.json", "x%2Fy.json", True), ("*", "line\nbreak", True),
])
def test_glob(one, glob, value, hit):
    assert one(paths.glob_match(F.lit(value), glob))[0] is hit


def test_ignore_order(one):
    config = rules.IgnoreRules.from_json('{"ignorelist": ["log.json"], "ignorepattern": ["*log*"]}')
    decide = lambda m, s: one(rules.ignore_decision(F.lit(m), F.lit(s), config))[0]["reason"]
    assert [decide("a/", 0), decide("a.txt", 0), decide("a.JSON", 1), decide("log.json", 0), decide("x/log.json", 1),
            decide("x/log2.json", 1), decide("x/ok.jsonl", 1)] == [
        "directory", "not_json", "not_json", "empty", "name_rule", "path_rule", None]


@pytest.mark.parametrize("text_", [None, "", "[]", "{broken"])
def test_missing_rules(text_):
    assert rules.IgnoreRules.from_json(text_) == rules.IgnoreRules()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**32 - 1), st.integers(0, 2**16 - 1),
                          st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=20)),
                min_size=1, max_size=30))
def test_binary_round_trip(spark, rows):
    data = [(i, bytearray(struct.pack("<qIH", a, b, c) + t.encode("utf-16-le") + b"\0\0z\0"), len(t.encode("utf-16-le")))
            for i, (a, b, c, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, b binary, n int")
    b = F.col("b")
    got = df.orderBy("i").select(binary.int64(b, 0), binary.uint64(b, 0).cast("string"), binary.uint32(b, 8),
                                 binary.uint16(b, 12), binary.utf16(b, 14, F.col("n")),
                                 binary.utf16_cstring(binary.slice_bytes(b, 14, 1 << 20))).collect()
    for (a, u32, u16, t), r in zip(rows, got):
        assert tuple(r) == (a, str(a % 2**64), u32, u16, t, t)


def test_short_blob_is_null(one):
    blob = F.lit(b"\x01\x02\x03")
    assert one(binary.uint32(blob), binary.int64(blob), binary.uint16(blob, 2), binary.uint16(blob, 1)) == (
        None, None, None, 0x0302)


def test_filetime(one):
    epoch = one(binary.filetime(F.lit(116444736000000000)).cast("timestamp_ntz"),
                binary.filetime(F.lit(116444736000000015)).cast("timestamp_ntz"),
                binary.filetime_words(F.lit(0), F.lit(5)), binary.filetime_words(F.lit(None).cast("bigint"), F.lit(5)))
    base = datetime.datetime(1970, 1, 1)
    assert epoch == (base, base + datetime.timedelta(microseconds=1), None, None)


def test_flags_and_lists(one):
    names = [f"f{i}" for i in range(11)]
    assert one(binary.flag_names(F.lit(1 | 1 << 10), names), binary.flag_names(F.lit(0), names))[0] == ["f0", "f10"]
    blob = struct.pack("<4I", 7, 0xFFFFFFFF, 9, 0xFFFFFFFF)
    assert one(binary.uint32_list(F.lit(blob), 0xFFFFFFFF), binary.uint32_list(F.lit(b"")))[:2] == ([7, 9], [])


def test_messages(one):
    items = F.array(F.struct(F.lit("a.zip").alias("triagepackage"), F.lit("blob").alias("source_name")))
    single = F.base64(F.lit('{"triagepackage": "b.zip", "source_name": "sftp"}').cast("binary"))
    first, second = one(documents.decode_message(documents.encode_message(items)), documents.decode_message(single))
    assert [tuple(r) for r in first + second] == [("a.zip", "blob"), ("b.zip", "sftp")]


def test_regex_search_ignores_case(one):
    assert one(rules.matches(F.lit("Terminal"), "MIN")) == (True,)
    nothing = F.lit(None).cast("string")
    assert one(rules.matches(nothing, "."), rules.matches(F.lit(""), "x"), rules.matches(nothing, "x")) == (True, False, None)


def test_safe_ids(one):
    assert one(*[rules.safe_id(F.lit(v).cast("string")) for v in ["id1.a_b-c", "a b", "", None]]) == (
        True, False, False, False)


def test_every_accepted_time_has_a_value(spark):
    from siftlake.functions import times

    utc = lambda *parts: datetime.datetime(*parts)
    cases = {"20240101": utc(2024, 1, 1), "2024-W01-1": utc(2024, 1, 1), "2024W527": utc(2024, 12, 29), "2021-W01": utc(2021, 1, 4),
             "2024-01-01_10:00:00": utc(2024, 1, 1, 10), "20240101T101530.1234567Z": utc(2024, 1, 1, 10, 15, 30, 123456),
             "2024-01-01T10:00:00+02:00": utc(2024, 1, 1, 8), "2024-01-01 00-0130": utc(2024, 1, 1, 1, 30),
             "2024-01-01T10,": None, "2024-02-30": None, "2024-01-01T10:15:30,5+00:00:30": utc(2024, 1, 1, 10, 15, 0, 500000),
             "2024-01-01T23:59:59+23:59": utc(2024, 1, 1, 0, 0, 59), "2021-W54": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", times.iso_timestamp(F.col("t")).cast("timestamp_ntz").alias("v")).collect()}
    assert got == cases


def test_bad_binary_values_are_null(spark):
    rows = [(bytes.fromhex("0000000000000080"), 4294967295), (bytes.fromhex("00803ed5deb19d01"), 27111902), (b"\x00", None)]
    df = spark.createDataFrame(rows, "b binary, high long")
    got = df.select(binary.filetime(binary.int64(F.col("b"))).isNull().alias("x"),
                    binary.filetime_words(F.col("high"), F.lit(4294967295)).isNull().alias("y")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True)]


def test_broken_utf16_is_null(spark):
    encode = lambda s: s.encode("utf-16-le", "surrogatepass")
    texts = ["plain", "\U0001f600 pair", "", "\ud800", "\udc00x", "x\ud83d", "a\ud83d\ude00\ude00", "\ud83d\ud83d\ude00", "\u00d8\ud7ff\ue000"]
    rows = [(i, encode(t)) for i, t in enumerate(texts)] + [(90, b"abc"), (91, encode("name") + b"\x00\x00" + b"\x00\xd8"), (92, encode("y" * 50_000))]
    df = spark.createDataFrame(rows, "i int, b binary")
    got = {r["i"]: (r["t"], r["c"]) for r in df.select("i", binary.utf16(F.col("b"), 0, F.length("b")).alias("t"),
                                                       binary.utf16_cstring(F.col("b")).alias("c")).collect()}
    for i in (0, 1, 2, 8):
        assert got[i] == (texts[i], texts[i])
    assert all(got[i][0] is None for i in (3, 4, 5, 6, 7, 90))
    assert got[91][1] == "name" and got[92][0] == "y" * 50_000


def test_bad_messages_are_items_without_a_package(spark):
    from siftlake.functions import documents

    rows = [("not base64 !",), ("bm8ganNvbg==",), (None,), ("eyJ0cmlhZ2VwYWNrYWdlIjogInAuemlwIiwgInNvdXJjZV9uYW1lIjogInMifQ==",)]
    df = spark.createDataFrame(rows, "m string").select(F.inline_outer(documents.decode_message(F.col("m"))))
    assert sorted(str(r["triagepackage"]) for r in df.collect()) == ["None", "None", "None", "p.zip"]


def test_usual_times_equal_those_put_together(spark, monkeypatch):
    """The cast of the usual form gives what the parts give."""
    rng = random.Random(4)
    texts = []
    for _ in range(4000):
        date = f"{rng.choice([0, 1, 1582, 1970, 2024, 9999]):04d}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}"
        clock = rng.choice(["", f"{rng.choice('T _')}{rng.randint(0, 24):02d}:{rng.randint(0, 60):02d}:{rng.randint(0, 60):02d}"])
        digits = rng.choice(["", f".{'123456789'[:rng.randint(1, 9)]}"]) if clock else ""
        zone = rng.choice(["", "Z", "+01:30", "-17:59", "+18:00", "+18:01", "-23:00", "+0100"]) if clock else ""
        texts.append(rng.choice(["", " "]) + date + clock + digits + zone)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast = df.select("t", times.is_iso_datetime(F.col("t")).alias("iso"), times.iso_timestamp(F.col("t")).cast("string").alias("at"))
    monkeypatch.setattr(times, "_USUAL", r"\A(?!.)x")
    slow = df.select("t", times.is_iso_datetime(F.col("t")).alias("iso"), times.iso_timestamp(F.col("t")).cast("string").alias("at"))
    a, b = sorted(map(tuple, fast.collect()), key=str), sorted(map(tuple, slow.collect()), key=str)
    assert a == b and sum(r[1] for r in a) > 500


def test_utf16_against_python(spark):
    rng = random.Random(5)
    units = [0x41, 0x62, 0x100, 0x00D8, 0xD800, 0xDC00, 0xD83D, 0xDE00, 0x0D00, 0x000D, 0xE000, 0x1000, 0x0010, 0]
    blobs = [struct.pack(f"<{n}H", *rng.choices(units[:rng.choice([4, 14])], k=n)) + rng.choice([b"", b"", b"x"]) for n in (rng.randint(0, 7) for _ in range(5000))]

    def text(blob):
        try:
            return blob.decode("utf-16-le")
        except UnicodeDecodeError:
            return None

    def to_nul(blob):
        for i in range(0, len(blob) - 1, 2):
            if blob[i:i + 2] == b"\0\0":
                return text(blob[:i])
        return text(blob)

    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    rows = df.select("b", binary.utf16(F.col("b"), 0, F.length("b")).alias("whole"), binary.utf16_cstring(F.col("b")).alias("head")).collect()
    assert [r["whole"] for r in rows] == [text(bytes(r["b"])) for r in rows]
    assert [r["head"] for r in rows] == [to_nul(bytes(r["b"])) for r in rows]
