"""Lookup joins that survive a hot key, and bounded per-key windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key counts as hot above this share of the rows, so there are at most 1/share hot keys.
HOT_SHARE = 0.01
MAX_HOT_KEYS = int(1 / HOT_SHARE)
SALTS = 64


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes and statistics, no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if text.startswith("-"):  # broadcasting is switched off
        return -1
    return int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def one_per_key(right: DataFrame, keys: list[str], prefer: Column) -> DataFrame:
    """One row per key, the smallest by `prefer` and then by the whole row."""
    rest = [c for c in right.columns if c not in keys]
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(prefer, *rest)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than HOT_SHARE of the rows: at most MAX_HOT_KEYS rows, whatever the data."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = df.agg(F.count("*")).scalar()
    return counts.where(F.col("_n") > rows * HOT_SHARE).select(*keys)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many rows to a table that is unique by `keys`.

    A right side below the session's broadcast limit is left to Catalyst, which then moves
    no left row. Otherwise both sides are shuffled by key and salt: rows of a hot key get one
    of SALTS salts, its single right row is repeated for each, and every other key has salt 0.
    """
    if estimated_bytes(right) <= broadcast_limit(right):
        return left.join(right, keys, how)
    return salted_join(left, right, keys, how)


def _own_salt(df: DataFrame, keys: list[str]) -> Column:
    """A salt from the row's other columns. It depends on nothing but the row, so a task that
    is run again after a lost executor sends every row where it went before."""
    rest = [f.name for f in df.schema.fields
            if f.name not in keys and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int") if rest else F.lit(0)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    hot = F.broadcast(hot_keys(left, keys).withColumn("_hot", F.lit(True)))
    turn = _own_salt(left, keys)
    # rows with a null key match nothing; they are spread as well
    spread = F.col("_hot") | reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    salted = left.join(hot, keys, "left").withColumn("_salt", F.when(spread, turn).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def nearest_before(left: DataFrame, right: DataFrame, key: str, ts: str, window_seconds: int,
                   payload: list[str], block_seconds: int | None = None) -> DataFrame:
    """For each left row, the count of right rows of the same key within the window ending
    at the left row, and the payload of the latest of them.

    No pairs are formed: a right row counts +1 at its time and -1 after the window, so the
    count at a left row is a running sum. Sums per time block carry from block to block (one
    small row each), and inside a block the rows are summed in order. A hot key is thereby
    spread over its blocks, and every frame grows by one row per step.
    """
    width = (block_seconds or max(1, window_seconds // 128)) * 1_000_000
    span = window_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    build = right.select(key, micros.alias("_us"), *[F.col(p).alias(f"_r_{p}") for p in payload])
    names = [f"_r_{p}" for p in payload]
    begin = build.select(key, "_us", F.lit(0).alias("_turn"), F.lit(1).alias("_step"), *names)
    expire = build.select(key, (F.col("_us") + span).alias("_us"), F.lit(2).alias("_turn"), F.lit(-1).alias("_step"))
    probe = left.select("*", micros.alias("_us"), F.lit(1).alias("_turn"), F.lit(0).alias("_step"))
    rows = probe.unionByName(begin, allowMissingColumns=True).unionByName(expire, allowMissingColumns=True)
    rows = rows.withColumn("_block", F.floor(F.col("_us") / width).cast("bigint"))
    seen = F.when(F.col("_turn") == 0, F.struct("_us", *names))

    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(F.sum("_step").alias("_sum"), F.max(seen).alias("_last"))
    bases = blocks.select(key, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
                          F.max("_last").over(earlier).alias("_base_last"))
    so_far = Window.partitionBy(key, "_block").orderBy("_us", "_turn", *names).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("_count", F.sum("_step").over(so_far)).withColumn(
        "_near", F.last(seen, ignorenulls=True).over(so_far)).where("_turn = 1")
    out = inside.join(bases, [key, "_block"], "left")
    near = F.coalesce("_near", "_base_last")
    near = F.when(near["_us"] >= F.col("_us") - span, near)
    return out.select(*[F.col(c) for c in left.columns],
                      (F.col("_base") + F.col("_count")).cast("bigint").alias("near_count"),
                      *[near[f"_r_{p}"].alias(f"near_{p}") for p in payload])
