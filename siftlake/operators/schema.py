"""Schema inference by majority vote, add-only evolution and typed projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions import paths, times
from siftlake.sources.records import LINEAGE

# The six types, and the range in which a float counts as an epoch.
TYPES = {
    "long": T.LongType(),
    "real": T.DoubleType(),
    "bool": T.BooleanType(),
    "datetime": T.TimestampType(),
    "dynamic": T.StringType(),
    "string": T.StringType(),
}
EPOCH_MIN, EPOCH_MAX = 1_000_000_000, 20_000_000_000_000
MILLIS_FROM = 100_000_000_000
#: What `classify` says of integers that 64 bits do not hold. They vote as integers; a table keeps
#: a column that has one as text, which holds every digit.
WIDE = "wide"


@dataclass(frozen=True)
class FieldType:
    source: str
    kind: str

    @property
    def name(self) -> str:
        return paths.sanitize_name_py(self.source)


# --- classification ----------------------------------------------------------------


def _float_kind(number: Column) -> Column:
    return F.when(number.between(EPOCH_MIN, EPOCH_MAX), "datetime").otherwise("real")


def classify(df: DataFrame, value: str, kind: str = "kind") -> DataFrame:
    """Adds the type of a JSON value, null for JSON null. The token decides: `1` is long,
    `1.5` is real, and only non-integers are tested as an epoch."""
    # a projection of its own: Catalyst keeps it apart because every rule below reads it
    tokens = df.withColumn("_token", F.schema_of_variant(value))
    token, v = F.col("_token"), F.col(value)
    big_int = token.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    rule = (
        F.when(token.isNull() | (token == "VOID"), F.lit(None).cast("string"))
        .when(token == "BIGINT", "long")
        .when(token == "STRING", F.when(times.is_iso_datetime(F.try_variant_get(v, "$", "string")), "datetime")
              .otherwise("string"))
        .when(token == "BOOLEAN", "bool")
        .when(token.startswith("OBJECT<") | token.startswith("ARRAY<"), "dynamic")
        .when(big_int, WIDE)
        .when(token.rlike("^(DECIMAL|DOUBLE|FLOAT)"), _float_kind(F.try_variant_get(v, "$", "double")))
        .when(token.rlike("^(TIMESTAMP|DATE)"), "datetime")
        .otherwise("string")
    )
    return tokens.withColumn(kind, rule).drop("_token")


def classify_text(value: Column) -> Column:
    """Type of a text value."""
    return F.when(value.isNull(), F.lit(None).cast("string")).when(
        times.is_iso_datetime(value), "datetime").otherwise("string")


def fields(records: DataFrame, *keep: str, record: str = "record") -> DataFrame:
    """One row per top-level field: the kept columns, `key`, `value`."""
    spark = records.sparkSession
    exploded = records.lateralJoin(spark.tvf.variant_explode(F.col(record).outer()).select("key", "value"))
    return exploded.where("key is not null").select(*keep, "key", "value")


# --- vote --------------------------------------------------------------------------


def first_values(values: DataFrame, by: list[str], pos: str, n: int, missing: Column) -> DataFrame:
    """The first n non-null values of each column (and the first n nulls, so that a column
    without values stays known). The rank limit runs before the shuffle too, so a table with
    a third of all rows sends at most n rows per task and column."""
    w = Window.partitionBy(*by, missing).orderBy(pos)
    return values.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def majority(classified: DataFrame, by: list[str], pos: str, kind: str = "kind", whole: bool = False) -> DataFrame:
    """Most common type per column; a tie goes to the type seen first, a column without
    values is string. With `whole` a column of integers that do not all fit 64 bits is string
    too. Two partial aggregations, records never travel."""
    wide = F.col(kind) == WIDE
    counts = classified.withColumn("_wide", wide).withColumn(kind, F.when(wide, "long").otherwise(F.col(kind))).groupBy(*by, kind).agg(
        F.count("*").alias("_n"), F.min(pos).alias("_first"), F.bool_or("_wide").alias("_wide"))
    voted = F.col(kind).isNotNull()
    # ties: larger count first, then the smaller first position
    best = counts.groupBy(*by).agg(
        F.max(F.when(voted, F.col("_n"))).alias("votes"),
        F.sum(F.when(voted, F.col("_n")).otherwise(0)).alias("samples"),
        F.collect_list(F.when(voted, F.struct("_n", "_first", kind))).alias("_kinds"),
        F.coalesce(F.bool_or("_wide"), F.lit(False)).alias("_wide"),
    )
    leaders = F.filter("_kinds", lambda k: k["_n"] == F.col("votes"))
    winner = F.array_sort(leaders, lambda a, b: F.when(a["_first"] < b["_first"], -1).otherwise(1))
    first = F.coalesce(F.get(winner, F.lit(0))[kind], F.lit("string"))
    return best.select(
        *by,
        F.when((first == "long") & F.col("_wide") & F.lit(whole), "string").otherwise(first).alias("kind"),
        F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"),
        F.col("samples").cast("bigint").alias("samples"),
    )


def vote(records: DataFrame, by: list[str], pos: str = "pos", sample: int | None = 100, whole: bool = False) -> DataFrame:
    """(by..., key, kind, votes, samples) from VARIANT records; `sample=None` votes over
    every value; `whole` as in `majority`."""
    keys = [*by, "key"]
    values = fields(records, *by, pos)
    if sample is not None:  # before the values are classified
        values = first_values(values, keys, pos, sample, F.is_variant_null("value"))
    return majority(classify(values, "value").drop("value"), keys, pos, whole=whole)


def head_lines(lines: DataFrame, by: list[str], pos: str, n: int | None, numbered: bool = False) -> DataFrame:
    """The first n lines of each file; all lines when n is None. Where `pos` is the line
    number, counted from 1, that is a filter the scan can apply; otherwise a rank, whose
    limit also runs in the scanning tasks."""
    if n is None:
        return lines
    if numbered:
        return lines.where(F.col(pos) <= n)
    w = Window.partitionBy(*by).orderBy(pos)
    return lines.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def first_file_types(voted: DataFrame, by: list[str], file: str) -> DataFrame:
    """Of per-file votes the type of the first file that has the column: files loaded one
    after the other would leave the same table."""
    return voted.groupBy(*by, "key").agg(F.min_by("kind", file).alias("kind"))


def field_types(voted: DataFrame) -> list[FieldType]:
    """The voted columns of one table on the driver; its rows are columns, not records."""
    return [FieldType(r["key"], r["kind"]) for r in voted.orderBy("key").collect()]


# --- typed projection ----------------------------------------------------------------


def variant_path(name: str) -> str:
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def typed_value(record: Column, field: FieldType) -> Column:
    path = variant_path(field.source)
    if field.kind != "datetime":
        return F.try_variant_get(record, path, TYPES[field.kind].simpleString())
    number = F.try_variant_get(record, path, "double")
    micros = F.when(number < MILLIS_FROM, number * 1_000_000).otherwise(number * 1_000)
    text = F.trim(F.try_variant_get(record, path, "string"))
    numeric = F.when(number.between(EPOCH_MIN, EPOCH_MAX), F.timestamp_micros(micros.cast("bigint")))
    return F.coalesce(numeric, times.iso_timestamp(text))


def typed_columns(record: Column, schema: list[FieldType]) -> list[Column]:
    """One column per clean name. Source names that become the same clean name are
    coalesced in source order."""
    by_name: dict[str, list[FieldType]] = {}
    for field in schema:
        by_name.setdefault(field.name, []).append(field)
    out = []
    for name, group in by_name.items():
        kind = TYPES[group[0].kind].simpleString()
        values = [typed_value(record, f) for f in group]
        values = [values[0]] + [v.try_cast(kind) for v in values[1:]]
        out.append((F.coalesce(*values) if len(values) > 1 else values[0]).alias(name))
    return out


def collisions(schema: list[FieldType]) -> dict[str, int]:
    """Clean names that more than one source name maps to."""
    counts: dict[str, int] = {}
    for field in schema:
        counts[field.name] = counts.get(field.name, 0) + 1
    return {name: n for name, n in counts.items() if n > 1}


def struct_of(schema: list[FieldType], lineage: bool = True) -> T.StructType:
    names: dict[str, T.DataType] = {}
    for field in schema:
        names.setdefault(field.name, TYPES[field.kind])
    tail = LINEAGE if lineage else []
    ordered = {n: t for n, t in names.items() if n not in tail}
    ordered.update({n: T.StringType() for n in tail})
    return T.StructType([T.StructField(n, t) for n, t in ordered.items()])


def mapping(schema: list[FieldType]) -> list[tuple[str, str, str]]:
    """(column, type, JSON path) of every source field."""
    return [(f.name, f.kind, variant_path(f.source)) for f in schema]


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


# --- evolution -------------------------------------------------------------------------


def merge_schema(existing: T.StructType | None, incoming: T.StructType) -> T.StructType:
    """Existing columns keep their types, unknown names are added, lineage stays last.
    Names are compared with their case."""
    if existing is None:
        return incoming
    known = {f.name for f in existing.fields}
    merged = existing.fields + [f for f in incoming.fields if f.name not in known]
    return lineage_last(T.StructType(merged))


def lineage_last(columns: T.StructType) -> T.StructType:
    head = [f for f in columns.fields if f.name not in LINEAGE]
    return T.StructType(head + [f for n in LINEAGE for f in columns.fields if f.name == n])


def new_columns(existing: T.StructType | None, incoming: T.StructType) -> list[str]:
    known = set(existing.names) if existing is not None else set()
    return [n for n in incoming.names if n not in known]


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns and types; a value that does not fit becomes null."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in target.fields:
        if field.name not in have:
            value = F.lit(None).cast(field.dataType)
        elif have[field.name] == field.dataType:
            value = F.col(f"`{field.name}`")
        else:
            value = F.col(f"`{field.name}`").try_cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Union of evolved versions: existing types win, missing columns are null."""
    target: T.StructType | None = None
    for table in tables:
        target = merge_schema(target, table.schema)
    parts = [conform(table, target) for table in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
