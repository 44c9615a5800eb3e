"""Evidence packages: listing, member inventory, member lines and hosts.

Listing never touches file content. Archives are opened on the executors by URI with
random access, so an inventory reads only each archive's directory, and the members of
one large package are spread over many tasks.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import paths
from siftlake.operators.skew import lookup_join

MEMBER_SCHEMA = (
    "package string, member string, size bigint, compressed_size bigint, is_dir boolean, "
    "encrypted boolean, container string, error string"
)
LINE_SCHEMA = "package string, member string, line_no bigint, line string, error string"
INFO_SCHEMA = "package string, document string, error string"
UNPACKED_SCHEMA = "package string, unpacked string, unpacked_name string"
UNPACKED = ("unpacked", "unpacked_name")

# Names inside a package.
NESTED_MARK = "data.zip"
CLIENT_INFO = "client_info.json"
RAW_EVIDENCE_PREFIX = "uploads/"
# Stores that archives are opened from directly; the names Hadoop has for some of them; and
# those that only Hadoop's own client opens.
DIRECT_STORES = ("file", "s3", "gs", "gcs", "abfs", "abfss", "hdfs", "viewfs")
STORE_ALIASES = {"s3a": "s3", "s3n": "s3"}
HADOOP_STORES = ("wasb", "wasbs", "sftp", "ftp", "adl", "o3fs", "ofs")
# Fixed value: bytes of the header in front of a member, without its name and extra field.
LOCAL_HEADER = 30
READ_BYTES = 1 << 20
LINES_PER_BATCH = 20_000
BYTES_PER_BATCH = 32 << 20


# --- listing -------------------------------------------------------------------


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), "modificationTime")


def list_packages(spark: SparkSession, directory: str) -> DataFrame:
    """All `*.zip` files below a directory."""
    return list_files(spark, directory, "*.zip")


def find_packages(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Distinct packages of several paths or glob patterns, any letter case of `.zip`."""
    return unique_packages(list_files(spark, patterns).select("path"))


def unique_packages(listing: DataFrame) -> DataFrame:
    return listing.where(F.lower("path").endswith(".zip")).select("path").distinct().orderBy("path")


def list_sources(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """One listing over many stores. `sources` maps a source tag to a path. A store that its
    packages could not be opened from later is refused here."""
    for path in sources.values():
        store_of(path)
    return union_sources({tag: list_packages(spark, path) for tag, path in sources.items()})


def union_sources(listings: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("source", F.lit(tag)) for tag, df in listings.items()]
    return reduce(DataFrame.unionByName, tagged)


def packages_per_source(listing: DataFrame) -> DataFrame:
    return listing.groupBy("source").agg(
        F.count("*").alias("packages"), F.sum("size").cast("bigint").alias("total_size")
    )


def filter_names(listing: DataFrame, path: str, prefix: str = "", suffix: str = "") -> DataFrame:
    name = paths.basename(F.col(path))
    return listing.where(name.startswith(prefix) & name.endswith(suffix))


# --- archives, inside tasks ------------------------------------------------------


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def store_of(uri: str) -> tuple[str, str, str]:
    """How a file is opened: "direct" or "hadoop", the scheme to use, and the rest of its
    address. A scheme that neither way knows is an error."""
    scheme, _, path = uri.partition(":") if ":" in uri.split("/", 1)[0] else ("file", "", uri)
    path = path if path.startswith("//") else "//" + path
    scheme = STORE_ALIASES.get(scheme.lower(), scheme.lower())
    if scheme in DIRECT_STORES:
        return "direct", scheme, path
    if scheme in HADOOP_STORES:
        return "hadoop", scheme, path
    raise ValueError(f"packages cannot be opened from {scheme}: ({uri})")


def _open_uri(uri: str):
    """Random access to a file of any store; names in a listing are not percent-encoded."""
    from pyarrow import fs

    way, scheme, path = store_of(uri)
    if way == "direct":
        system, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(path)}")
        return system.open_input_file(inner)
    authority, _, inner = path.removeprefix("//").partition("/")
    return fs.HadoopFileSystem(f"{scheme}://{authority}").open_input_file("/" + inner)


@contextmanager
def _open_archive(package: str, content: bytes | None, password: bytes | None) -> Iterator[zipfile.ZipFile]:
    """The archive; it and its file are closed at the end."""
    with (io.BytesIO(content) if content is not None else _open_uri(package)) as file, zipfile.ZipFile(file) as archive:
        archive.setpassword(password)
        yield archive


class _Part(io.RawIOBase):
    """A range of bytes of a file as a file of its own."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.at = file, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        self.at = max(0, base + offset)
        return self.at

    def readinto(self, buffer) -> int:
        wanted = max(0, min(len(buffer), self.size - self.at))
        self.file.seek(self.start + self.at)
        data = self.file.read(wanted) if wanted else b""
        buffer[:len(data)] = data
        self.at += len(data)
        return len(data)


def _stored_part(outer: zipfile.ZipFile, info: zipfile.ZipInfo) -> io.BufferedReader:
    """The bytes of an uncompressed member where they stand: behind its local header, whose last
    two fields are the lengths of the name and the extra field that follow."""
    outer.fp.seek(info.header_offset)
    header = outer.fp.read(LOCAL_HEADER)
    name, extra = struct.unpack("<HH", header[-4:])
    return io.BufferedReader(_Part(outer.fp, info.header_offset + LOCAL_HEADER + name + extra, info.file_size), READ_BYTES)


def _inner_member(outer: zipfile.ZipFile) -> zipfile.ZipInfo | None:
    return next((info for info in outer.infolist() if NESTED_MARK in info.filename), None)


def _in_place(info: zipfile.ZipInfo) -> bool:
    """Whether a member can be read where it stands: neither compressed nor encrypted."""
    return info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 0x1


def _resolve_nested(outer: zipfile.ZipFile, password: bytes | None) -> tuple[zipfile.ZipFile, str | None]:
    """The inner archive and its name when one is present; a stored one is read in place, so a
    task reads only the ranges of its members. One that does not open is the package's error:
    its evidence is inside."""
    info = _inner_member(outer)
    if info is None:
        return outer, None
    try:
        inner = zipfile.ZipFile(_stored_part(outer, info) if _in_place(info) else outer.open(info))
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, struct.error) as exc:
        raise zipfile.BadZipFile(f"{info.filename} does not open: {exc}") from exc
    inner.setpassword(password)
    return inner, info.filename


@contextmanager
def _evidence(package: str, content: bytes | None, inner: tuple[str, str] | None,
              password: bytes | None) -> Iterator[tuple[zipfile.ZipFile, str | None]]:
    """The archive that holds the evidence and, for an inner one, its name. `inner` is where
    `unpack_inner` has left it, and its name."""
    if inner is not None:
        with _open_uri(inner[0]) as file:
            try:
                archive = zipfile.ZipFile(file)
            except (zipfile.BadZipFile, OSError, ValueError) as exc:  # a file too short for a directory
                raise zipfile.BadZipFile(f"{inner[1]} does not open: {exc}") from exc
            archive.setpassword(password)
            yield archive, inner[1]
    else:
        with _open_archive(package, content, password) as outer:
            yield _resolve_nested(outer, password)


def _rows(batch: pd.DataFrame) -> Iterator[tuple[str, bytes | None, tuple[str, str] | None]]:
    nothing = [None] * len(batch)
    contents = batch["content"] if "content" in batch else nothing
    unpacked = zip(batch["unpacked"], batch["unpacked_name"]) if "unpacked" in batch else zip(nothing, nothing)
    return ((package, content, inner if inner[0] is not None else None)
            for package, content, inner in zip(batch["package"], contents, unpacked))


def _unpacked(folder: str, password: bytes | None):
    """Writes compressed inner archives below a folder, in pieces of bounded size. Each attempt
    has a draft of its own, which is moved into place when it is whole."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        _, scheme, path = store_of(folder)
        system, base = fs.FileSystem.from_uri(f"{scheme}:{quote(path)}")
        system.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for package, content, _ in _rows(batch):
                place = name = None
                try:
                    with _open_archive(package, content, password) as outer:
                        info = _inner_member(outer)
                        if info is not None and not _in_place(info):
                            key = hashlib.sha256(package.encode()).hexdigest()
                            draft = f"{base}/_{TaskContext.get().taskAttemptId()}-{key}"
                            with outer.open(info) as source, system.open_output_stream(draft) as out:
                                while piece := source.read(READ_BYTES):
                                    out.write(piece)
                            system.move(draft, f"{base}/{key}.zip")
                            place, name = f"{folder}/{key}.zip", info.filename
                except Exception:  # readers of the package meet the same fault and report it
                    place = name = None
                rows.append((package, place, name))
            yield pd.DataFrame(rows, columns=_columns(UNPACKED_SCHEMA))

    return write


def _problem(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"


def _inventory(password: bytes | None):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package, content, inner in _rows(batch):
                rows = []
                try:
                    with _evidence(package, content, inner, password) as (archive, container):
                        for m in archive.infolist():
                            rows.append((package, m.filename, m.file_size, m.compress_size, m.is_dir(),
                                         bool(m.flag_bits & 0x1), container, None))
                except Exception as exc:  # one bad package becomes an error row, the job goes on
                    rows = [(package, None, None, None, None, None, None, _problem(exc))]
                yield pd.DataFrame(rows, columns=_columns(MEMBER_SCHEMA))

    return read


def _member_lines(package: str, archive: zipfile.ZipFile, members: list[str]) -> Iterator[pd.DataFrame]:
    """Batches are bounded by lines and bytes, whatever the size of a member."""
    rows, held = [], 0
    for member in members:
        try:
            with archive.open(member) as stream:
                for number, raw in enumerate(stream, start=1):
                    line = raw.rstrip(b"\r\n").decode("utf-8", errors="replace")
                    rows.append((package, member, number, line, None))
                    held += len(raw)
                    if len(rows) >= LINES_PER_BATCH or held >= BYTES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=_columns(LINE_SCHEMA))
                        rows, held = [], 0
        except Exception as exc:
            rows.append((package, member, None, None, _problem(exc)))
    if rows:
        yield pd.DataFrame(rows, columns=_columns(LINE_SCHEMA))


def _lines_of_members(carry: list[str], password: bytes | None):
    """Columns named in `carry` are the same for all lines of a member and travel along."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package, part in batch.groupby("package", sort=False):
                try:
                    _, _, inner = next(_rows(part))
                    with _evidence(package, None, inner, password) as (archive, _):
                        for row in part.itertuples(index=False):
                            for lines in _member_lines(package, archive, [row.member]):
                                yield lines.assign(**{c: getattr(row, c) for c in carry})
                except Exception as exc:
                    failed = part[["package", "member", *carry]].assign(line_no=None, line=None, error=_problem(exc))
                    yield failed[[*_columns(LINE_SCHEMA), *carry]]

    return read


def _lines_of_packages(password: bytes | None):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package, content, inner in _rows(batch):
                try:
                    with _evidence(package, content, inner, password) as (archive, _):
                        wanted = [m.filename for m in archive.infolist()
                                  if m.filename.endswith((".json", ".jsonl")) and m.file_size > 0]
                        yield from _member_lines(package, archive, wanted)
                except Exception as exc:
                    yield pd.DataFrame([(package, None, None, None, _problem(exc))], columns=_columns(LINE_SCHEMA))

    return read


def _info_document(archive: zipfile.ZipFile) -> str | None:
    if CLIENT_INFO not in archive.namelist():
        return None
    text = archive.read(CLIENT_INFO).decode("utf-8-sig")
    json.loads(text)
    return text


def _client_infos(password: bytes | None):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for package, content, inner in _rows(batch):
                document = error = None
                try:
                    with _evidence(package, content, inner, password) as (archive, container):
                        document = _info_document(archive)
                    if document is None and container is not None:
                        with _open_archive(package, content, password) as outer:
                            document = _info_document(outer)
                except Exception as exc:
                    error = _problem(exc)
                rows.append((package, document, error))
            yield pd.DataFrame(rows, columns=_columns(INFO_SCHEMA))

    return read


# --- operators -------------------------------------------------------------------


def _spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """A fixed number of tasks: rows are tiny but each stands for a large file, so the
    adaptive coalescing by bytes must not merge them."""
    n = tasks or 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys)


def _archive_rows(packages: DataFrame) -> DataFrame:
    return packages.select("package", *[c for c in ("content", *UNPACKED) if c in packages.columns])


def _secret(password: str | None) -> bytes | None:
    return password.encode() if password else None


def unpack_inner(packages: DataFrame, folder: str, tasks: int | None = None, password: str | None = None) -> DataFrame:
    """Decompresses each compressed inner archive once, to a file below `folder`, which all
    machines share: (package, unpacked, unpacked_name), null for packages that have none. Joined
    to packages or members, readers open that file, however many tasks they are. Inner archives
    that are only stored stay where they are, since ranges of them can be read in place."""
    rows = _archive_rows(packages.drop(*UNPACKED))
    if "content" not in rows.columns:
        rows = _spread(rows, tasks, "package")
    return rows.mapInPandas(_unpacked(folder.rstrip("/"), _secret(password)), UNPACKED_SCHEMA)


def member_inventory(packages: DataFrame, tasks: int | None = None, password: str | None = None) -> DataFrame:
    """One row per member of each package; an inner archive replaces the outer listing.
    `packages` has `package` (a URI), and `content` only when the bytes are at hand."""
    rows = _archive_rows(packages)
    if "content" not in rows.columns:
        rows = _spread(rows, tasks, "package")
    return rows.mapInPandas(_inventory(_secret(password)), MEMBER_SCHEMA)


def member_lines(members: DataFrame, tasks: int | None = None, carry: tuple[str, ...] = (),
                 target_bytes: int = 64 << 20, password: str | None = None) -> DataFrame:
    """Lines of the listed members, with the text columns of `carry` (host, upload id, ...)
    repeated on each line. They are joined to members, so lines are never shuffled for it.
    Work is spread by member, not by package.

    When the members carry a `table_name`, a task reads members of one table as far as
    possible, each table getting tasks by its bytes, so that landing the lines by table
    writes few files.
    """
    rows = members.where("member is not null").select(
        "package", "member", *[c for c in ("size", *UNPACKED) if c in members.columns], *carry)
    schema = LINE_SCHEMA + "".join(f", {c} string" for c in carry)
    if "table_name" in carry and "size" in rows.columns:
        shares = rows.groupBy("table_name").agg(F.ceil(F.sum("size") / target_bytes).alias("_share"))
        share = F.greatest(F.col("_share"), F.lit(1)).cast("bigint")
        slot = F.pmod(F.xxhash64("package", "member"), share)
        placed = lookup_join(rows, shares, ["table_name"], "inner").withColumn("_slot", slot)
        spread = _spread(placed, tasks, "table_name", "_slot")
    else:
        spread = _spread(rows, tasks, "package", "member")
    return spread.select("package", "member", *[c for c in UNPACKED if c in spread.columns], *carry).mapInPandas(
        _lines_of_members(list(carry), _secret(password)), schema)


def package_lines(packages: DataFrame, tasks: int | None = None, password: str | None = None) -> DataFrame:
    """Lines of every JSON member, one pass per package (small packages, or given bytes)."""
    rows = _archive_rows(packages)
    if "content" not in rows.columns:
        rows = _spread(rows, tasks, "package")
    return rows.mapInPandas(_lines_of_packages(_secret(password)), LINE_SCHEMA)


def client_infos(packages: DataFrame, tasks: int | None = None, password: str | None = None) -> DataFrame:
    rows = _archive_rows(packages)
    if "content" not in rows.columns:
        rows = _spread(rows, tasks, "package")
    return rows.mapInPandas(_client_infos(_secret(password)), INFO_SCHEMA)


def host_name(document: Column, registry_host: Column | None = None) -> Column:
    """Host of a client info document, with the registry name as the fallback."""
    named = F.nullif(F.get_json_object(document, "$.hostname"), F.lit(""))
    fqdn = F.nullif(F.get_json_object(document, "$.os_info.fqdn"), F.lit(""))
    last = [registry_host] if registry_host is not None else []
    return F.coalesce(named, fqdn, *last, F.lit(""))


def package_hosts(infos: DataFrame, registry_hosts: DataFrame | None = None) -> DataFrame:
    """(package, host); `registry_hosts` has (package, registry_host), unique by package."""
    if registry_hosts is None:
        return infos.select("package", host_name(F.col("document")).alias("host"))
    joined = infos.join(registry_hosts, "package", "left")
    return joined.select("package", host_name(F.col("document"), F.col("registry_host")).alias("host"))


def has_raw_evidence(members: DataFrame) -> DataFrame:
    """Per package: is any member below `uploads/`, and is any member encrypted
    (null when the package could not be read)."""
    return members.groupBy("package").agg(
        F.coalesce(F.bool_or(F.col("member").startswith(RAW_EVIDENCE_PREFIX)), F.lit(False)).alias("raw_evidence"),
        F.bool_or("encrypted").alias("is_encrypted"),
    )
