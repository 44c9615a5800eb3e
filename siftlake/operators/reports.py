"""Counts and totals over the ledgers and artifact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text
from siftlake.operators.ledger import IN_PROGRESS

# Durations are summed as decimals, so that a total does not depend on the order of the rows.
SECONDS = "decimal(28,9)"

# Package, number of artifacts run on it, number of files uploaded.
NOTIFICATION = "Package %s is done: %d artifacts run, %d result files uploaded"


def seconds_sum(value: Column) -> Column:
    return F.sum(value.cast(SECONDS))


def total(value: Column) -> Column:
    """Sum of the non-null values, rounded to two decimals."""
    return F.round(F.coalesce(seconds_sum(value), F.lit(0)), 2).cast("double")


def records_per_host(records: DataFrame, host: str = "src_host") -> DataFrame:
    """Record count per host, largest first."""
    counts = records.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("records"))
    return counts.orderBy(F.desc("records"), "host")


def package_totals(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per package: total duration and bytes, succeeded and failed artifacts (a run without
    a result counts in neither)."""
    return runs.groupBy(*by).agg(
        F.coalesce(seconds_sum(F.col("duration_in_sec")), F.lit(0)).cast("double").alias("total_processing"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("fail_count"),
    )


def artifact_table(runs: DataFrame, limited: bool = False) -> DataFrame:
    """Per package one row per artifact and a TOTALS row (`n out of m`); the limited form
    leaves out the return code."""
    sets = runs.groupingSets(
        [[F.col("package"), F.col("artifact")], [F.col("package")]], F.col("package"), F.col("artifact")
    )
    ok, bad, rows = F.count_if("success"), F.count_if(~F.col("success")), F.count("*")
    is_total = F.grouping("artifact") == 1
    seconds = seconds_sum(F.col("duration_in_sec"))
    status = (
        F.when(is_total, F.concat(ok, F.lit(" out of "), rows))
        .when(bad > 0, "FAILED").when(ok > 0, "OK").otherwise("")
    )
    shown = seconds.isNotNull() & (~is_total | (seconds != 0))
    duration = F.when(shown, F.concat(text.fixed(seconds, 2), F.lit(" sec"))).otherwise("")
    size = F.sum("size").cast("bigint")
    cols = [
        F.when(is_total, "TOTALS").otherwise(F.col("artifact")).alias("artifact_label"),
        F.when(is_total, F.coalesce(size, F.lit(0))).otherwise(size).alias("output_size"),
        duration.alias("duration"),
        status.alias("status"),
    ]
    if not limited:
        cols.append(F.when(~is_total, F.max("returncode")).alias("returncode"))
    out = sets.agg(*cols)
    return out.drop("artifact").withColumnRenamed("artifact_label", "artifact")


def master_table(totals: DataFrame) -> DataFrame:
    """Package rows and one grand total row (null package) of duration and size."""
    grand = totals.groupingSets(
        [[F.col("package"), F.col("host")], []], F.col("package"), F.col("host")
    )
    seconds = seconds_sum(F.col("total_processing"))
    size = F.sum("total_size_bytes").cast("bigint")
    detail = F.grouping("package") == 0
    return grand.agg(
        F.concat(text.fixed(seconds, 2), F.lit(" sec")).alias("total_duration"),
        text.size_text(size).alias("total_output"),
        F.when(detail, F.sum("success_count").cast("bigint")).alias("ok"),
        F.when(detail, F.sum("fail_count").cast("bigint")).alias("failed"),
    )


def status_counters(entries: DataFrame) -> DataFrame:
    status = F.col("status")
    return entries.agg(
        F.count("*").alias("total"),
        F.count_if(status == "finished").alias("finished"),
        F.count_if(status.isin(IN_PROGRESS)).alias("processing"),
        F.count_if(status == "failed").alias("failed"),
    )


def succeeded(flag: Column, error: Column, name: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) & error.isNull() & name.isNotNull()


def notifications(uploads: DataFrame, runs: DataFrame) -> DataFrame:
    """Message per package: artifacts run and files uploaded. One aggregation over both
    ledgers, so nothing is paired."""
    up = uploads.select("package", F.lit(0).alias("artifact"), succeeded(
        F.col("upload_initiated"), F.col("upload_error"), F.col("basename")).cast("int").alias("upload"))
    post = runs.select("package", succeeded(
        F.col("success"), F.col("error"), F.col("basename")).cast("int").alias("artifact"), F.lit(0).alias("upload"))
    counts = up.unionByName(post).groupBy("package").agg(
        F.sum("artifact").cast("bigint").alias("artifacts"), F.sum("upload").cast("bigint").alias("uploads"))
    message = F.format_string(NOTIFICATION, "package", "artifacts", "uploads")
    return counts.withColumn("message", message)


def upload_class(ignored: Column, error: Column, initiated: Column) -> Column:
    """Exactly one of ignored, failed, uploaded."""
    no = F.lit(False)
    bad = (F.coalesce(error, F.lit("")) != "") | ~F.coalesce(initiated, no)
    return F.when(F.coalesce(ignored, no), "ignored").when(bad, "failed").otherwise("uploaded")


def upload_classes(uploads: DataFrame, by: list[str]) -> DataFrame:
    kind = upload_class(F.col("ignored_upload"), F.col("upload_error"), F.col("upload_initiated"))
    return uploads.groupBy(*by, kind.alias("upload_class")).agg(F.count("*").alias("files"))


def upload_outcomes(uploads: DataFrame) -> DataFrame:
    """One row: initiated, failed and skipped uploads of a run over a folder."""
    kind = upload_class(F.col("ignored_upload"), F.col("upload_error"), F.col("upload_initiated"))
    return uploads.agg(
        F.count_if(kind == "uploaded").alias("initiated"),
        F.count_if(kind == "failed").alias("failed"),
        F.count_if(kind == "ignored").alias("skipped"),
    )


def duration_summary(runs: DataFrame, label: str, labels: list[str], by: str = "package") -> DataFrame:
    """Per package the duration of each label and the total, as text. The labels are the
    artifact list, so the pivot needs no job to find them."""
    value = F.col("duration_in_sec")
    per_label = [seconds_sum(F.when(F.col(label) == name, value)).alias(name) for name in labels]
    sums = runs.groupBy(by).agg(*per_label, total(value).alias("total"))
    return sums.select(by, *[text.seconds_text(F.col(c)).alias(c) for c in sums.columns if c != by])


def coverage(records: DataFrame, catalogue: list[str], host: str = "host", artifact: str = "artifact") -> DataFrame:
    """(host, artifact, records) for every artifact of the catalogue, zero when a host did
    not produce it. One aggregation; the catalogue is unfolded from its literal list."""
    counts = records.groupBy(host).agg(*[
        F.count_if(F.col(artifact) == name).alias(f"_{i}") for i, name in enumerate(catalogue)
    ])
    cells = F.array(*[
        F.struct(F.lit(name).alias("artifact"), F.col(f"_{i}").alias("records")) for i, name in enumerate(catalogue)
    ])
    return counts.select(host, F.inline(cells))


def log_levels(logs: DataFrame, by: list[str], levels: list[str] | None = None) -> DataFrame:
    rows = logs if levels is None else logs.where(F.col("level").isin(levels))
    return rows.groupBy(*by, "level").agg(F.count("*").alias("messages"))


def first_seen(df: DataFrame, item: str, pos: str) -> DataFrame:
    """Order-preserving de-duplication."""
    return df.groupBy(item).agg(F.min(pos).alias("first_pos")).orderBy("first_pos")


def run_detail(runs: DataFrame) -> DataFrame:
    """Per-artifact rows of a run, formatted for display."""
    duration = F.when(F.col("duration_in_sec").isNull(), "-").otherwise(
        F.concat(text.fixed(F.col("duration_in_sec"), 1, half_even=False), F.lit("s")))
    return runs.select(
        "uploadid", "zipfile",
        text.display_text(F.col("artifact")).alias("artifact"),
        text.size_text_short(F.col("size"), units=4).alias("size"),
        F.when(F.col("success"), "Yes").otherwise("No").alias("success"),
        duration.alias("duration"),
        text.display_text(F.col("error")).alias("error"),
    )
