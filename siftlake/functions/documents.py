"""JSON documents: work messages, artifact lists, nested lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<triagepackage:string,source_name:string>"
MESSAGE = f"struct<triagepackages:array<{ITEM}>,triagepackage:string,source_name:string>"


def decode_message(message: Column) -> Column:
    """Work items of a base64 message, from the list form or the older single form. Text that is
    not such a message gives one item without a package."""
    doc = F.from_json(F.try_to_binary(message, F.lit("base64")).cast("string"), MESSAGE)
    single = F.array(F.struct(doc.triagepackage.alias("triagepackage"), doc.source_name.alias("source_name")))
    return F.coalesce(doc.triagepackages, single)


def encode_message(items: Column) -> Column:
    """Base64 message from an array of (triagepackage, source_name) structs."""
    return F.base64(F.to_json(F.struct(items.cast(f"array<{ITEM}>").alias("triagepackages"))).cast("binary"))


def artifact_list(df: DataFrame, document: str) -> DataFrame:
    """Ordered (category, position, call) rows of an artifact list document."""
    lists = F.from_json(F.col(document), "map<string,array<string>>")
    per_category = df.select(F.explode(lists).alias("category", "calls"))
    return per_category.select("category", F.posexplode("calls").alias("position", "call"))


def nested(document: Column, *path: str) -> Column:
    """Text of a nested member, e.g. nested(doc, 'os_info', 'fqdn')."""
    return F.get_json_object(document, "$" + "".join(f"['{p}']" for p in path))


def null_if_first_empty(values: Column) -> Column:
    first = F.get(values, F.lit(0))
    return F.when(first.isNotNull() & (first.cast("string") != ""), values)

