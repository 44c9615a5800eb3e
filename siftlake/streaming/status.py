"""Status as a stream: keyed state machine, live counters, confirmation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlake.operators.ledger import STATUSES
from siftlake.operators.rules import safe_id
from siftlake.streaming import generations
from siftlake.streaming.discovery import batch_folder, start

REQUEUED = "unqueued"
ENDED = ["failed", "downloadfailed", "finished"]
#: One row for each package that a batch has changed.
CHANGE = ("package string, status string, entered_at timestamp, events bigint, illegal boolean, "
          "before string, before_entered_at timestamp")
#: Packages more (or less) in a status, by the time they entered it.
DELTA = "status string, entered_at timestamp, change bigint"
PENDING = "upload_id string, finished_at timestamp"
CONFIRMED = "upload_id string, finished_at timestamp, confirmation string"


def _rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def state_of(events: DataFrame) -> DataFrame:
    """Current state, when it was entered, number of events, and whether a status was ever
    entered out of order. Going back is legal only when a package is queued again, and an ended
    run only restarts so. Each transition counts, also into a status that was left before."""
    order = Window.partitionBy("package").orderBy("updated_at", "rank")
    moves = events.select("package", "status", "updated_at").distinct().withColumn("rank", _rank(F.col("status"))).withColumns(
        {"before": F.lag("status").over(order), "rank_before": F.lag("rank").over(order)})
    entered = F.col("before").isNull() | (F.col("before") != F.col("status"))
    wrong = (F.col("before") != F.col("status")) & (F.col("status") != REQUEUED) & (
        (F.col("rank") < F.col("rank_before")) | F.col("before").isin(ENDED))
    return moves.groupBy("package").agg(
        F.max_by("status", F.struct("updated_at", "rank")).alias("status"),
        F.max(F.when(entered, F.col("updated_at"))).alias("entered_at"),
        F.count("*").alias("events"),
        F.coalesce(F.bool_or(wrong), F.lit(False)).alias("illegal"))


def _folded(moves: str) -> Column:
    """The state after a list of moves in order, as `state_of` finds it with windows."""
    ended = ", ".join(f"'{s}'" for s in ENDED)
    return F.expr(f"""aggregate({moves},
      named_struct('status', CAST(NULL AS STRING), 'rank', 0L, 'entered_at', CAST(NULL AS TIMESTAMP), 'events', 0L, 'illegal', FALSE),
      (s, m) -> named_struct('status', m.status, 'rank', m.rank,
        'entered_at', IF(s.status IS NULL OR s.status <> m.status, m.updated_at, s.entered_at), 'events', s.events + 1L,
        'illegal', s.illegal OR COALESCE(s.status <> m.status AND m.status <> '{REQUEUED}' AND (m.rank < s.rank OR s.status IN ({ended})), FALSE)))""")


def status_changes(events: DataFrame) -> DataFrame:
    """Changes of packages as a stream, for update mode: one row for each package that has moved
    in a batch, with the state it is in now and the one it was in before the batch.

    events(package, status, updated_at) may come in any order and more than once. The state kept
    for a package is the set of its moves; a batch touches the packages it has events of. Rows
    without package, status or time are left out.
    """
    known = events.where("package IS NOT NULL AND status IS NOT NULL AND updated_at IS NOT NULL")
    # The time of the batch, the same in all of its rows and when it is repeated.
    move = F.struct(F.col("updated_at").cast("timestamp").alias("updated_at"), _rank(F.col("status")).alias("rank"), "status",
                    F.current_timestamp().alias("seen_at"))
    sets = known.select("package", move.alias("move")).groupBy("package").agg(F.sort_array(F.collect_set("move")).alias("moves"))
    # A move that was delivered again counts from when it was first seen.
    latest = sets.withColumn("now", F.array_max(F.transform("moves", lambda m: m["seen_at"]))).withColumn("moves", F.expr(
        "filter(moves, (m, i) -> i = 0 OR moves[i - 1].updated_at <> m.updated_at OR moves[i - 1].status <> m.status)")).withColumn(
        "earlier", F.expr("filter(moves, m -> m.seen_at < now)"))
    states = latest.select("package", _folded("moves").alias("s"), _folded("earlier").alias("b"))
    return states.select("package", "s.status", "s.entered_at", "s.events", "s.illegal",
                         F.col("b.status").alias("before"), F.col("b.entered_at").alias("before_entered_at"))


def follow_status(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds the changes of each batch to `path/changes` and what they do to the counters to
    `path/counts`: a package that moves is one less where it was and one more where it is. A
    batch reads its events and the state of their packages, nothing of earlier batches; a
    repeated batch replaces its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, batch_folder(f"{path}/changes", batch_id)
        batch.write.mode("overwrite").parquet(folder)
        changes = spark.read.schema(CHANGE).parquet(folder)
        entered = F.struct("status", "entered_at", F.lit(1).alias("change"))
        left = F.struct(F.col("before").alias("status"), F.col("before_entered_at").alias("entered_at"), F.lit(-1).alias("change"))
        moved = changes.select(F.inline(F.filter(F.array(entered, left), lambda d: d["status"].isNotNull())))
        _summed(moved).write.mode("overwrite").parquet(batch_folder(f"{path}/counts", batch_id))

    return start(status_changes(events), write, checkpoint, mode="update", every=every)


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("status", "entered_at").agg(F.sum("change").alias("change")).where("change <> 0")


def compact_status(spark: SparkSession, path: str) -> None:
    """Merges the batches of `follow_status`; see `generations`."""
    generations.compact(spark, f"{path}/changes", CHANGE, generations.newest_by("package"))
    generations.compact(spark, f"{path}/counts", DELTA, _summed)


def current(spark: SparkSession, path: str) -> DataFrame:
    """State of each package, as `state_of` finds it from all events."""
    rows = generations.read(spark, f"{path}/changes", CHANGE)
    return generations.newest_by("package")(rows).select("package", "status", "entered_at", "events", "illegal")


def counters(state: DataFrame, now: Column) -> DataFrame:
    """Packages by current status, and the longest time that one has been in it."""
    waiting = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("entered_at")
    return state.groupBy("status").agg(F.count("*").alias("packages"), F.max(waiting).alias("longest_seconds"))


def current_counters(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """What `counters` finds from the state of all packages, from the changes of the counters."""
    there = _summed(generations.read(spark, f"{path}/counts", DELTA))
    waiting = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.min("entered_at"))
    return there.groupBy("status").agg(F.sum("change").alias("packages"), waiting.alias("longest_seconds"))


def confirmations(finished: DataFrame, visible: DataFrame, delay: str, early: str, timeout: str = "30 minutes") -> DataFrame:
    """finished(upload_id, finished_at) with visible(upload_id, visible_at): confirmed when the
    id shows up, up to the timeout after the finish or, as data may be visible before the run
    ends, up to `early` before it; timeout once the watermark has passed the limit. Rows that
    are later than `delay` are dropped, so it has to cover the delay of the sources. State is
    kept for the length of both limits. An id that was there earlier still times out, unlike in
    `ledger.confirm`: `follow_confirmations` has no such limit."""
    runs = finished.withWatermark("finished_at", delay).alias("f")
    ids = visible.withWatermark("visible_at", delay).alias("v")
    condition = F.expr(f"f.upload_id = v.upload_id AND v.visible_at >= f.finished_at - INTERVAL {early} "
                       f"AND v.visible_at <= f.finished_at + INTERVAL {timeout}")
    joined = runs.join(ids, condition, "leftOuter")
    state = F.when(F.col("v.upload_id").isNotNull(), "confirmed").otherwise("timeout")
    return joined.select("f.upload_id", "f.finished_at", "v.visible_at", state.alias("confirmation"))


def follow_confirmations(finished: DataFrame, visible: Callable[[SparkSession], DataFrame], path: str, checkpoint: str,
                         timeout: str = "30 minutes", now: Column | None = None, every: str | None = None) -> StreamingQuery:
    """Confirms finished(upload_id, finished_at) against the ids that are visible at each batch,
    whenever they became so, by the rule of `ledger.confirm`.

    `path/pending` has one version per batch: the ids still open. A batch looks up only those and
    its own, adds what it decides to `path/decided` and writes the rest as the next version. An
    id times out once the clock is past its limit; the clock is `now`, or else the newest finish
    seen so far, which is part of the version. `visible` gives a table with `upload_id`. An
    unusable id is left out, an id that finishes again is open again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(safe_id(F.col("upload_id"))).select("upload_id", "finished_at")
        before = spark.createDataFrame([], PENDING) if not batch_id else spark.read.schema(PENDING).parquet(
            batch_folder(f"{path}/pending", batch_id - 1))
        # The row without an id carries the clock.
        open_ = before.unionByName(fresh).groupBy("upload_id").agg(F.max("finished_at").alias("finished_at"))
        opened = f"{path}/open/batch={batch_id}"
        open_.write.mode("overwrite").parquet(opened)
        open_ = spark.read.schema(PENDING).parquet(opened)
        clock = open_.agg(F.max("finished_at")).scalar() if now is None else now
        ids = open_.where("upload_id IS NOT NULL")
        seen = visible(spark).select("upload_id").join(ids.select("upload_id"), "upload_id", "left_semi").distinct().withColumn("_seen", F.lit(True))
        past = F.col("finished_at") < clock - F.expr(f"INTERVAL {timeout}")
        state = F.when(F.col("_seen"), "confirmed").when(F.coalesce(past, F.lit(True)), "timeout").otherwise("pending")
        checked = ids.join(seen, "upload_id", "left").select("upload_id", "finished_at", state.alias("confirmation"))
        checked.where("confirmation <> 'pending'").write.mode("overwrite").parquet(batch_folder(f"{path}/decided", batch_id))
        # What this batch has decided is read back, as the ids may be visible by the next look.
        decided = spark.read.schema(CONFIRMED).parquet(batch_folder(f"{path}/decided", batch_id))
        rest = ids.join(decided.select("upload_id"), "upload_id", "left_anti")
        tick = open_.agg(F.lit(None).cast("string").alias("upload_id"), F.max("finished_at").alias("finished_at"))
        rest.unionByName(tick).write.mode("overwrite").parquet(batch_folder(f"{path}/pending", batch_id))

    return start(finished, write, checkpoint, every=every)


def decided(spark: SparkSession, path: str) -> DataFrame:
    """The newest decision on each id, and `pending` for those still open."""
    rows = generations.newest_by("upload_id")(generations.read(spark, f"{path}/decided", CONFIRMED))
    pending = generations.read(spark, f"{path}/pending", PENDING)
    last = pending.agg(F.max("batch").alias("batch"))
    still = pending.join(F.broadcast(last), "batch").where("upload_id IS NOT NULL").select(
        "upload_id", "finished_at", F.lit("pending").alias("confirmation"))
    return rows.join(still, "upload_id", "left_anti").unionByName(still)
