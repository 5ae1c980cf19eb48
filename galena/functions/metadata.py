"""Typed metadata: a map from keys to tagged values.

A tagged value is a struct of t (0 null, 1 integer, 2 real, 3 text) and i, r, s, of which t names the one that holds. An
explicit null is an entry with t = 0, unlike a key that is not there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MetadataError

NULL, INT, REAL, TEXT = 0, 1, 2, 3
VALUE = T.StructType([T.StructField("t", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("s", T.StringType())])
METADATA = T.MapType(T.StringType(), VALUE)
Value = int | float | str | None


def tag(value: Value) -> tuple[int, int | None, float | None, str | None]:
    """The tagged form of a Python value."""
    if value is None:
        return NULL, None, None, None
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise MetadataError(f"{value!r} is no integer, real, text or None")
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise MetadataError(f"{value} does not fit into 64 bits")
        return INT, value, None, None
    if isinstance(value, float):
        if not math.isfinite(value):
            raise MetadataError(f"{value} is not finite")
        return REAL, None, value, None
    return TEXT, None, None, value


def untag(held) -> Value:
    return None if held is None else {NULL: None, INT: held["i"], REAL: held["r"], TEXT: held["s"]}[held["t"]]


def tagged(metadata: Mapping[str, Value]) -> dict:
    if "" in metadata:
        raise MetadataError("a metadata key is empty")
    return {k: tag(v) for k, v in metadata.items()}


def plain(held: Mapping | None) -> dict[str, Value]:
    """A metadata map as Python values, in the order of its keys."""
    return {k: untag(held[k]) for k in sorted(held)} if held else {}


def _entry(t: int, i=None, r=None, s=None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(t).cast("byte").alias("t"), (none if i is None else i).cast("long").alias("i"), (none if r is None else r).cast("double").alias("r"), (none if s is None else s).cast("string").alias("s"))


def int_value(c: Column) -> Column:
    return _entry(INT, i=c)


def real_value(c: Column) -> Column:
    return _entry(REAL, r=c)


def text_value(c: Column) -> Column:
    return _entry(TEXT, s=c)


def null_value() -> Column:
    return _entry(NULL)


def metadata_map(values: Mapping[str, Column]) -> Column:
    """A map of tagged columns; keys whose value column is null are left out."""
    entries = [F.struct(F.lit(k).alias("k"), v.alias("v"), F.coalesce(v["i"].isNotNull() | v["r"].isNotNull() | v["s"].isNotNull() | (v["t"] == NULL), F.lit(False)).alias("there")) for k, v in values.items()]
    held = F.filter(F.array(*entries), lambda e: e["there"])
    return F.map_from_entries(F.transform(held, lambda e: F.struct(e["k"], e["v"])))


def to_rows(df: DataFrame, id_column: str = "id", metadata: str = "metadata") -> DataFrame:
    """A row per key: vector_id, key, value_type, int_value, real_value, text_value."""
    out = df.select(F.col(id_column).alias("vector_id"), F.explode(metadata).alias("key", "v"))
    return out.select("vector_id", "key", F.col("v.t").alias("value_type"), F.col("v.i").alias("int_value"), F.col("v.r").alias("real_value"), F.col("v.s").alias("text_value"))


def from_rows(rows: DataFrame) -> DataFrame:
    """The maps of such rows: id, metadata. A vector has as many rows as keys, so its group is small."""
    value = F.struct(F.col("value_type").cast("byte").alias("t"), F.col("int_value").alias("i"), F.col("real_value").alias("r"), F.col("text_value").alias("s"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("key").alias("k"), value.alias("v"))))
    return rows.groupBy(F.col("vector_id").alias("id")).agg(F.map_from_entries(entries).alias("metadata"))


def merge(old: Column, new: Column) -> Column:
    """old with the entries of new, which win."""
    empty = F.create_map().cast("map<string,struct<t:tinyint,i:bigint,r:double,s:string>>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def without(metadata: Column, key: str) -> Column:
    return F.map_filter(metadata, lambda k, _: k != F.lit(key))


def display(held: Column) -> Column:
    """A tagged value as text: null, a number, or the text itself."""
    return F.when(held["t"] == NULL, "null").when(held["t"] == INT, held["i"].cast("string")).when(held["t"] == REAL, held["r"].cast("string")).otherwise(held["s"])


def to_json(metadata: Mapping[str, Value]) -> str:
    """An object with keys in order; a real that is not finite is null."""
    return json.dumps({k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in sorted(metadata.items())}, ensure_ascii=False)
