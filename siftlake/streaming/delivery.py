"""Triggered processing of packages with leases and a bounded number of attempts.

Open deliveries are a table with one version per step, written whole (it holds only what is not
done yet). Taking deliveries writes a version in which they have one more attempt and are hidden
until their lease ends; only then do they run. So a driver that dies in between has lost nothing:
after the lease they are due again, and the attempt counts. A delivery that has used up its
attempts becomes `failed`, by its own outcome or, if it never had one, here.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlake import intake
from siftlake.functions import paths
from siftlake.streaming import generations
from siftlake.streaming.discovery import batch_folder, start

OPEN = "package string, size bigint, source string, attempts int, visible_at timestamp"
OUTCOME = "package string, attempts int, outcome string"
# How long a taken delivery is hidden, and how often it is tried.
LEASE = datetime.timedelta(seconds=30)
ATTEMPTS = 3


def _folder(root: str) -> str:
    return f"{root}/_deliveries"


def open_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version."""
    newest = generations.newest_complete(spark, _folder(root))
    if newest is None:
        return spark.createDataFrame([], OPEN)
    return spark.read.schema(OPEN).parquet(batch_folder(_folder(root), newest))


def _next(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Writes the next version and returns it."""
    newest = generations.newest_complete(spark, _folder(root))
    path = batch_folder(_folder(root), 0 if newest is None else newest + 1)
    rows.select(*[c.split()[0] for c in OPEN.split(", ")]).write.mode("overwrite").parquet(path)
    return spark.read.schema(OPEN).parquet(path)


def offer(messages: DataFrame, root: str, now: datetime.datetime) -> None:
    """Adds packages (package, size, source) that are not open yet; they are due at once. Rows
    without a package are left out, repeated ones count once."""
    spark = messages.sparkSession
    known = open_deliveries(spark, root)
    fresh = messages.where("package IS NOT NULL").groupBy("package").agg(F.min("size").alias("size"), F.min("source").alias("source"))
    fresh = fresh.join(known.select("package"), "package", "left_anti").withColumns(
        {"attempts": F.lit(0), "visible_at": F.lit(now).cast("timestamp")})
    _next(spark, root, known.unionByName(fresh.select(*known.columns)))


def poll(spark: SparkSession, root: str, session: str, now: datetime.datetime, lease: datetime.timedelta = LEASE,
         attempts: int = ATTEMPTS, **settings) -> DataFrame:
    """Takes all due deliveries, runs the intake over them and returns (package, attempts,
    outcome): `finished`, `retry` after the lease, or `failed` for good.

    One intake runs for all of them and keeps the outcomes of packages apart. `settings` go to
    `intake_packages`.
    """
    at = F.lit(now).cast("timestamp")
    known = open_deliveries(spark, root)
    due = F.coalesce(F.col("visible_at") <= at, F.lit(True))
    if not known.where(due).take(1):
        return spark.createDataFrame([], OUTCOME)
    hidden = F.lit(now + lease).cast("timestamp")
    claimed = _next(spark, root, known.withColumns({
        "attempts": F.when(due, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "visible_at": F.when(due, hidden).otherwise(F.col("visible_at"))}))
    version = generations.newest_complete(spark, _folder(root))
    taken = claimed.join(known.where(due).select("package"), "package", "left_semi")
    spent = taken.where(F.col("attempts") > attempts)
    listing = taken.where(F.col("attempts") <= attempts).select("package", "size", "source")
    again = taken.where((F.col("attempts") > 1) & (F.col("attempts") <= attempts))
    key = f"{session}-{version}"  # a session of its own for each step: an attempt never replaces the rows of another
    intake.mark(again, root, key, "unqueued", now)
    intake.mark(spent, root, key, "failed", now)
    intake.intake_packages(spark, listing, root, key, now=now, **settings)

    status = intake.current_status(spark, root).select(F.col("package").alias("_name"), "status")
    outcome = F.when(F.col("status") == "finished", "finished").when(F.col("attempts") >= attempts, "failed").otherwise("retry")
    ended = taken.withColumn("_name", paths.basename(F.col("package"))).join(status, "_name", "left").select(
        "package", F.least("attempts", F.lit(attempts)).alias("attempts"), outcome.alias("outcome"))
    path = f"{root}/_outcomes/step={version}"
    ended.write.mode("overwrite").parquet(path)
    ended = spark.read.schema(OUTCOME).parquet(path)
    _next(spark, root, claimed.join(ended.where("outcome <> 'retry'").select("package"), "package", "left_anti"))
    return ended


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes of all attempts."""
    return spark.read.schema(OUTCOME).parquet(f"{root}/_outcomes/*")


def follow(messages: DataFrame, root: str, session: str, checkpoint: str, now: datetime.datetime | None = None,
           every: str | None = None, **settings) -> StreamingQuery:
    """Offers the packages of each batch and runs what is due, its own and older ones whose
    lease has ended. A repeated batch offers what is open or done already: known packages are
    taken once, and the ledger keeps finished ones from running again. Where new packages are
    rare, union a `rate` stream so that older deliveries do not wait for them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        offer(batch, root, at)
        poll(batch.sparkSession, root, session, at, **settings)

    return start(messages, write, checkpoint, every=every)
