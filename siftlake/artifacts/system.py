"""Machine-wide evidence: accounts database, network interfaces, evidence paths, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.artifacts.common import lineage
from siftlake.artifacts.registry import Parameter, artifact
from siftlake.functions import binary, paths
from siftlake.operators.rules import matches

# Layout of the two account structures (zero-based byte offsets).
F_TIMES = {"last_login": 8, "password_reset": 24, "password_fail": 40}
F_RID, F_FLAGS, F_FAILED_LOGINS, F_LOGINS = 48, 56, 64, 66
FLAG_NAMES = [
    "Account Disabled", "Home directory required", "Password not required", "Temporary duplicate account",
    "Normal user account", "MNS logon user account", "Interdomain trust account", "Workstation trust account",
    "Server trust account", "Password does not expire", "Account auto locked",
]
V_ACCOUNT_TYPE = 4
ACCOUNT_TYPES = {188: "Default Admin User", 212: "Custom Limited Acct", 176: "Default Guest Acct"}
V_DATA_START = 0xCC
V_TEXTS = {"username": 12, "fullname": 24, "comment": 36, "driveletter": 84, "logon_script": 96,
           "profile_path": 108, "workstation": 120}
V_HASHES = {"lm_hash": 156, "nt_hash": 168}

# Names of the interface settings.
INTERFACE_VALUES = ["EnableDHCP", "DhcpIPAddress", "Domain", "NameServer", "DhcpServer", "DefaultGateway",
                    "SubnetMask", "IPAddress"]
SYSTEM_HIVES = ["DEFAULT", "SAM", "SECURITY", "SOFTWARE", "SYSTEM"]


def account_f(f: Column) -> Column:
    return F.struct(
        *[binary.filetime(binary.int64(f, at)).alias(name) for name, at in F_TIMES.items()],
        binary.uint32(f, F_RID).alias("rid"),
        binary.flag_names(binary.uint16(f, F_FLAGS), FLAG_NAMES).alias("flags"),
        binary.uint16(f, F_FAILED_LOGINS).alias("failed_logins"),
        binary.uint16(f, F_LOGINS).alias("logins"),
    )


def account_v(v: Column) -> Column:
    def at(position: int) -> tuple[Column, Column]:
        return binary.uint32(v, position) + V_DATA_START, binary.uint32(v, position + 4)

    return F.struct(
        binary.choice(binary.uint32(v, V_ACCOUNT_TYPE), ACCOUNT_TYPES).alias("account_type"),
        *[binary.utf16(v, *at(p)).alias(name) for name, p in V_TEXTS.items()],
        *[binary.hex_text(binary.slice_bytes(v, *at(p))).alias(name) for name, p in V_HASHES.items()],
    )


@artifact("SAM", ["sam_values"])
def sam_accounts(values: DataFrame) -> DataFrame:
    """Accounts whose F and V values both exist, decoded."""
    rows = values.where((F.length("f") > 0) & (F.length("v") > 0))
    return rows.select("key", "hive", account_f(F.col("f")).alias("f"), account_v(F.col("v")).alias("v"),
                       *lineage(values))


@artifact("SAM/CreateTimes", ["sam_names"])
def sam_created(names: DataFrame) -> DataFrame:
    """Account names with the change time of their key."""
    return names.where(matches(F.col("data_type"), "Key")).select(
        F.col("name").alias("username"), F.col("mtime").alias("created_time"), *lineage(names))


@artifact("Interfaces", ["interface_values"], [Parameter("wide", False, "bool")])
def interfaces(values: DataFrame, wide=False) -> DataFrame:
    """Network settings per interface, one row per value or one row per interface."""
    rows = values.where(F.col("name").isin(INTERFACE_VALUES)).select(
        "name", "value", paths.component(F.col("os_path"), -2).alias("interface"), *lineage(values))
    if not wide:
        return rows
    # the list of names is fixed: conditional maxima instead of a pivot over the data
    return rows.groupBy(*lineage(values), "interface").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in INTERFACE_VALUES])


_USERS = r"(?i)(?:^|/)Users/[^/]+/"


def evidence_kind(member: Column) -> Column:
    """Kind of evidence at a member path, in the order the kinds are tested; null for none."""
    hives = "|".join(SYSTEM_HIVES)
    return (
        F.when(member.rlike(r"(?i)(?:^|/)uploads/auto/[A-Z]%3A/$"), "file_tree")
        .when(member.rlike(r"(?i)(?:^|/)%5C%5C\.%5C[A-Z]%3A/\$MFT$"), "mft")
        .when(member.rlike(rf"(?i)(?:^|/)Windows/System32/config/(?:{hives})$"), "system_hive")
        .when(member.rlike(_USERS + r"NTUser\.DAT$"), "user_hive")
        .when(member.rlike(r"(?i)(?:^|/)appcompat/Programs/Amcache\.hve$"), "amcache")
        .when(member.rlike(_USERS + r"(?:.*/)?UsrClass\.dat$"), "usrclass")
    )


def mount_prefix(member: Column, kind: Column) -> Column:
    """Where the evidence would appear on the live machine."""
    user = F.regexp_extract(member, r"(?i)(?:^|/)Users/([^/]+)/", 1)
    hive = F.upper(paths.basename(member))
    drive = lambda pattern: F.regexp_extract(member, pattern, 1)
    return (
        F.when(kind == "file_tree", F.concat(drive(r"(?i)uploads/auto/([A-Z])%3A"), F.lit(":")))
        .when(kind == "mft", F.concat(F.lit("\\\\.\\"), drive(r"(?i)%5C%5C\.%5C([A-Z])%3A"), F.lit(":")))
        .when(kind == "system_hive", F.when(hive == "SAM", hive).otherwise(F.concat(F.lit("HKEY_LOCAL_MACHINE/"), hive)))
        .when(kind == "user_hive", F.concat(F.lit("HKEY_USERS\\"), user))
        .when(kind == "amcache", F.lit("/amcachemount/"))
        .when(kind == "usrclass", F.concat(F.lit("HKEY_USERS\\"), user, F.lit("\\AppData\\Local\\Microsoft\\Windows")))
    )


@artifact("EvidencePaths", ["members"])
def evidence_paths(members: DataFrame) -> DataFrame:
    """Members that are evidence, with kind and mount prefix. One pass instead of six lists."""
    kind = evidence_kind(F.col("member"))
    rows = members.withColumn("kind", kind).where("kind is not null")
    return rows.select("package", "member", "kind", mount_prefix(F.col("member"), F.col("kind")).alias("prefix"),
                       *lineage(members))


def role_label(os: Column, domain_role: Column) -> Column:
    """Label of a client, the first rule that matches."""
    return (
        F.when(matches(os, "linux"), "Linux")
        .when(matches(domain_role, "Workstation"), "Workstation")
        .when(matches(domain_role, "Server"), "Server")
        .when(matches(domain_role, "Domain Controller"), "Domain Controller")
    )


@artifact("RoleLabels", ["clients"])
def role_labels(clients: DataFrame) -> DataFrame:
    labelled = clients.withColumn("label", role_label(F.col("os"), F.col("domain_role")))
    return labelled.where("label is not null").select("client_id", "label")
