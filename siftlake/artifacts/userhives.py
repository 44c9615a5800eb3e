"""Per-user registry evidence: hive values, recent documents, remote desktop, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.artifacts.common import is_binary, lineage, timestamp, user_filter
from siftlake.artifacts.registry import Parameter, artifact
from siftlake.functions import binary, documents, paths, times
from siftlake.operators.rules import matches
from siftlake.operators.skew import lookup_join, one_per_key

END_OF_LIST = 4294967295
ORDER_VALUE = "MRUListEx"


@artifact("Users", ["profiles", "homes"])
def users(profiles: DataFrame, homes: DataFrame) -> DataFrame:
    """Accounts from the profile list: RID, name from the profile path, load times and the
    change time of the home directory."""
    keys = [*[c for c in lineage(profiles) if c in homes.columns], "directory"]
    directory = F.col("profile_image_path")
    homes_once = one_per_key(homes.select(*keys, "homedir_mtime"), keys, F.col("homedir_mtime"))
    joined = lookup_join(profiles.withColumn("directory", directory), homes_once, keys)
    return joined.select(
        paths.rid(F.col("sid")).alias("uid"),
        F.lit("").alias("gid"),
        F.substring_index(directory, "\\", -1).alias("name"),
        "directory",
        F.col("sid"),
        "mtime",
        "homedir_mtime",
        F.struct(
            binary.filetime_words(F.col("load_high"), F.col("load_low")).alias("profile_load_time"),
            binary.filetime_words(F.col("unload_high"), F.col("unload_low")).alias("profile_unload_time"),
        ).alias("data"),
        *lineage(profiles),
    )


@artifact("NTUser", ["hive_values", "accounts"], [Parameter("user_regex", ".", "regex")])
def nt_user(hive_values: DataFrame, accounts: DataFrame, user_regex=".") -> DataFrame:
    """Values of the user hives with the profile of their owner. An account needs a home
    directory; values without a matching account are left out."""
    shared = [c for c in lineage(hive_values) if c in accounts.columns]
    named = accounts.where(F.col("directory").isNotNull()).select(
        *shared, "sid", F.coalesce("name", F.lit("")).alias("username"), "description", "uid", "gid", "directory"
    ).where(matches(F.col("username"), user_regex))
    keys = [*shared, "sid"]
    return lookup_join(hive_values, one_per_key(named, keys, F.col("username")), keys, "inner")


def _mru_value(name: Column, value: Column) -> Column:
    return F.when(name != ORDER_VALUE, binary.utf16_cstring(value))


@artifact("RecentDocs", ["recent_values"], [
    Parameter("date_after", None, "timestamp"), Parameter("date_before", None, "timestamp"),
    Parameter("entry_regex", ".", "regex"), Parameter("user_regex", ".", "regex"),
    Parameter("sid_regex", ".", "regex"), Parameter("offline", False, "bool"),
])
def recent_docs(values: DataFrame, date_after=None, date_before=None, entry_regex=".", user_regex=".",
                sid_regex=".", offline=False) -> DataFrame:
    """Recent documents per (type, hive) in the order of the list value, as `n := name`. In
    offline form the user columns are empty and not filtered."""
    by = [*lineage(values), "type", "hive"]
    rows = values.where(is_binary(F.col("data_type")) & times.within(
        F.col("mtime"), timestamp(date_after), timestamp(date_before)))
    if not offline:
        rows = rows.where(user_filter(F.col("username"), F.col("sid"), user_regex, sid_regex))
    rows = rows.select(*by, "name", "value", "mtime", "key", "username", "sid")
    items = rows.where(F.col("name") != ORDER_VALUE).select(
        *by, F.col("name").alias("n"), binary.utf16_cstring(F.col("value")).alias("item"))
    items = one_per_key(items, [*by, "n"], F.col("item"))
    # a list is as long as its own value, so everything grouped below is bounded by it
    owner = [*by, "mtime", "key", "username", "sid"]
    listed = rows.where(F.col("name") == ORDER_VALUE).select(
        *owner, F.posexplode_outer(binary.uint32_list(F.col("value"), END_OF_LIST)).alias("pos", "number"))
    listed = listed.groupBy(*owner, F.col("number").cast("string").alias("n")).agg(F.min("pos").alias("pos"))
    entries = listed.join(items, [*by, "n"], "left").withColumn(
        "entry", F.concat("n", F.lit(" := "), "item"))
    grouped = entries.groupBy(*owner).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "entry")))).alias("_e"))
    mru = documents.null_if_first_empty(F.transform("_e", lambda e: e["entry"]))
    out = grouped.select(
        F.col("mtime").alias("last_write_time"), "type", mru.alias("mru_entries"), "key", "hive",
        *([] if offline else ["username", "sid"]), *lineage(values),
    )
    shown = F.when(F.col("mru_entries").isNull(), "NULL").otherwise(F.concat_ws(" ", "mru_entries"))
    return out if entry_regex == "." else out.where(matches(shown, entry_regex))


def _rdp_user(username: Column, hive: Column) -> Column:
    """The account name, or the folder that holds the hive."""
    folder = paths.basename(paths.dirname(F.replace(hive, F.lit("\\"), F.lit("/"))))
    return F.coalesce(F.nullif(username, F.lit("")), folder)


@artifact("RDP/Servers", ["rdp_values"], [
    Parameter("user_regex", ".", "regex"), Parameter("sid_regex", ".", "regex"),
])
def rdp_servers(values: DataFrame, user_regex=".", sid_regex=".") -> DataFrame:
    """Remote desktop servers a user connected to, with user name hint and certificate hash."""
    keys = [*lineage(values), "sid", "key"]
    rows = values.where((F.col("data_type") != "Key") & F.col("key").rlike(r"(?i)Terminal Server Client\\Servers\\"))
    named = lambda n: F.col("key_name") == n
    hints = rows.where(F.col("key_name").isin("UsernameHint", "CertHash")).groupBy(*keys).agg(
        F.min(F.when(named("UsernameHint"), F.col("value").cast("string"))).alias("username_hint"),
        F.min(F.when(named("CertHash"), binary.hex_text(F.col("value")))).alias("cert_hash"),
    )
    shown = rows.where(user_filter(F.col("username"), F.col("sid"), user_regex, sid_regex))
    servers = shown.groupBy(*keys, "hive", "mtime").agg(F.min("username").alias("username"))
    return servers.join(hints, keys, "left").select(
        _rdp_user(F.col("username"), F.col("hive")).alias("username"), "sid", "hive", "key",
        F.col("mtime").alias("last_write_time"),
        F.substring_index("key", "\\", -1).alias("server"),
        "username_hint", "cert_hash", *lineage(values),
    )


@artifact("RDP/Mru", ["rdp_values"], [
    Parameter("user_regex", ".", "regex"), Parameter("sid_regex", ".", "regex"),
])
def rdp_mru(values: DataFrame, user_regex=".", sid_regex=".") -> DataFrame:
    """Recent remote desktop targets per user, in value name order. Each value name counts
    once (its newest value), so a list is bounded by the names of one key."""
    owner = [*lineage(values), "sid"]
    rows = values.where(
        (F.col("data_type") != "Key") & F.col("key").rlike(r"(?i)Terminal Server Client\\Default(\\|$)")
        & F.col("key_name").rlike("^MRU"))
    text = F.col("value").cast("string")
    newest = rows.groupBy(*owner, "key_name").agg(F.max_by(text, F.struct("mtime", text)).alias("target"))
    lists = newest.groupBy(*owner).agg(F.sort_array(F.collect_list(F.struct("key_name", "target"))).alias("_l"))
    shown = rows.where(user_filter(F.col("username"), F.col("sid"), user_regex, sid_regex))
    heads = shown.groupBy(*owner, "hive").agg(
        F.max(F.struct("mtime", "key", "username")).alias("_h"))
    return heads.join(lists, owner, "left").select(
        _rdp_user(F.col("_h.username"), F.col("hive")).alias("username"), "sid", "hive", F.col("_h.key").alias("key"),
        F.col("_h.mtime").alias("last_write_time"),
        F.transform("_l", lambda e: e["target"]).alias("mru"), *lineage(values),
    )
