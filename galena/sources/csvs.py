"""Vectors as comma-separated text, and vector literals."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptionError, InvalidVectorError

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_SEPARATORS = re.compile(r"[,\s\[\]]+")


def parse_literal(text: str) -> list[float]:
    """A vector written with commas, white space or brackets between its components."""
    parts = [p for p in _SEPARATORS.split(text) if p]
    out = []
    for i, p in enumerate(parts):
        try:
            x = float(np.float32(p))
        except ValueError:
            raise InvalidVectorError(f"component {i} is {p!r}, which is no number") from None
        if not np.isfinite(x):
            raise InvalidVectorError(f"component {i} is {p}")
        out.append(x)
    if not out:
        raise InvalidVectorError("the vector is empty")
    return out


def parse_column(text: F.Column) -> F.Column:
    """The same for a column of literals; what is no number becomes null, for a check to find."""
    parts = F.filter(F.split(text, r"[,\s\[\]]+"), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("float"))


def read_csv(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """ordinal, id, embedding of a file in which blank lines and those that begin with # are skipped; with ids, the
    first field is the id. Empty fields do not count, nor do lines that hold nothing else. A field that is no number, or a line
    of another length than the first, raises with its line.

    Lines are numbered by their place, part by part: the counts of parts are summed, and each part is numbered alone.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("_part", F.shiftright("_at", 33))
    counts = {r["_part"]: r["n"] for r in lines.groupBy("_part").agg((F.max("_at").bitwiseAND((1 << 33) - 1) + 1).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) if starts else F.lit(0)
    rows = lines.select((start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long").alias("line"), "value")
    rows = rows.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).withColumn("f", F.filter(F.split("value", ","), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")) != ""))
    rows = rows.where(F.size("f") > (1 if ids else 0))
    bad = rows.where(F.exists("f", lambda x: ~x.rlike(_NUMBER))).agg(F.min("line")).first()[0]
    if bad is not None:
        raise CorruptionError(f"{path}, line {bad}: a field is no number")
    sizes = rows.agg(F.min(F.size("f")), F.max(F.size("f")), F.min_by(F.size("f"), "line")).first()
    if sizes[0] != sizes[1]:
        odd = rows.where(F.size("f") != sizes[2]).agg(F.min("line")).first()[0]
        raise CorruptionError(f"{path}, line {odd}: it has another number of fields than {sizes[2]}")
    if ids and sizes[0] == 1:
        raise CorruptionError(f"{path}: lines hold an id and no component")
    numbers = F.slice("f", 2, F.size("f") - 1) if ids else F.col("f")
    one = F.trim(F.get("f", F.lit(0)))
    if ids:
        wrong = rows.where(~one.rlike(r"^\d+$") | one.try_cast("long").isNull()).agg(F.min("line")).first()[0]
        if wrong is not None:
            raise CorruptionError(f"{path}, line {wrong}: the id is no whole number below 2**63")
    return rows.select(F.col("line").alias("ordinal"), (one.cast("long") if ids else F.lit(None).cast("long")).alias("id"), F.transform(numbers, lambda x: F.trim(x).cast("float")).alias("embedding"))


def float_text(x: F.Column) -> F.Column:
    """The shortest text that reads back as the same float."""
    return x.cast("float").cast("string")


def write_csv(df: DataFrame, path: str) -> None:
    """Write a comment that names the columns, and id and components of each row in the order of id, to a folder of text
    files."""
    line = F.concat_ws(",", F.col("id").cast("string"), F.concat_ws(",", F.transform("embedding", float_text)))
    dimension = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    head = df.agg(F.concat(F.lit("# Galena CSV: id,dimension "), dimension).alias("value")).select(F.lit(None).cast("long").alias("id"), "value")
    df.select(F.col("id").cast("long").alias("id"), line.alias("value")).union(head).orderBy(F.col("id").asc_nulls_first()).select("value").write.text(path)
