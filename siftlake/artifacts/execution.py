"""Execution and file change evidence: USN journal, BAM, UserAssist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.artifacts.common import is_binary, lineage, timestamp
from siftlake.artifacts.registry import Parameter, artifact
from siftlake.functions import binary, times
from siftlake.operators.rules import any_matches, matches
from siftlake.operators.skew import lookup_join, one_per_key


@artifact("Usn", ["journal"], [
    Parameter("file_name_regex", ".", "regex"), Parameter("path_regex", ".", "regex"),
    Parameter("mft_id_regex", ".", "regex"), Parameter("parent_mft_id_regex", ".", "regex"),
    Parameter("date_after", None, "timestamp"), Parameter("date_before", None, "timestamp"),
])
def usn(journal: DataFrame, file_name_regex=".", path_regex=".", mft_id_regex=".", parent_mft_id_regex=".",
        date_after=None, date_before=None) -> DataFrame:
    """File changes of every drive, filtered by name, path, record ids and exclusive time bounds."""
    keep = journal.where(
        matches(F.col("filename"), file_name_regex)
        & matches(F.col("mft_id").cast("string"), mft_id_regex)
        & matches(F.col("parent_mft_id").cast("string"), parent_mft_id_regex)
        & times.within(F.col("timestamp"), timestamp(date_after), timestamp(date_before))
        & any_matches(F.col("links"), path_regex)
    )
    return keep.select(
        F.col("timestamp"),
        "filename",
        F.concat("drive", "os_path").alias("os_path"),
        "links",
        "reason",
        "mft_id",
        "sequence",
        "parent_mft_id",
        "parent_sequence",
        "file_attributes",
        "source_info",
        "usn",
        *lineage(journal),
    )


@artifact("Bam", ["bam_values", "users"], [Parameter("user_regex", ".", "regex")])
def bam(values: DataFrame, users: DataFrame, user_regex=".") -> DataFrame:
    """Last execution per program and account; the account name comes from the SID."""
    shared = [c for c in lineage(values) if c in users.columns]
    known = users.where(matches(F.col("name"), user_regex)).select(*shared, F.col("sid"), F.col("name").alias("username"))
    named = lookup_join(values.where(is_binary(F.col("data_type"))),
                        one_per_key(known, [*shared, "sid"], F.col("username")), [*shared, "sid"])
    return named.select(
        "sid", "username", "binary", binary.filetime(binary.int64(F.col("value"), 0)).alias("bam_time"),
        *lineage(values),
    )


@artifact("UserAssist", ["userassist_values"], [
    Parameter("user_filter", "", "regex"), Parameter("execution_time_after", None, "timestamp"),
])
def user_assist(values: DataFrame, user_filter="", execution_time_after=None) -> DataFrame:
    """Programs started from the shell: decoded name, run count and last run, in time order."""
    # The encoded name follows the last `Count` key, in quotes or not.
    tail = F.substring_index("key_path", "Count\\", -1)
    encoded = F.when(F.col("key_path").contains("Count\\"), F.regexp_replace(tail, '^"|"$', "")).otherwise("")
    last = binary.filetime(binary.int64(F.col("value"), 60))
    out = values.select(
        "key_path",
        F.when(encoded != "", binary.rot13(encoded)).otherwise(F.col("key_path")).alias("name"),
        F.col("username").alias("user"),
        last.alias("last_execution"),
        F.unix_timestamp(last).alias("last_execution_ts"),
        binary.uint32(F.col("value"), 4).alias("executions"),
        *lineage(values),
    )
    if user_filter:
        out = out.where(matches(F.col("user"), user_filter))
    after = timestamp(execution_time_after)
    if after is not None:
        out = out.where(F.col("last_execution") > after)
    return out.orderBy("last_execution", "key_path")
