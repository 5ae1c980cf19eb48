"""Numbers for people: digit groups, sizes, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def grouped(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n.cast("decimal(38,0)"), 0)


def human_bytes(n: Column) -> Column:
    """Bytes below 1024 as they are; larger sizes in the largest unit that is at most as large, with two decimals below 10 of
    it and one from there on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i in range(1, len(UNITS)):
        x = n / float(1024**i)
        digits = lambda d: F.bround(x, d).cast(f"decimal(20,{d})").cast("string")  # noqa: B023, E731
        text = F.concat(F.when(x < 10, digits(2)).otherwise(digits(1)), F.lit(f" {UNITS[i]}"))
        out = F.when(n >= 1024**i, text).otherwise(out)
    return out


def score_text(x: Column) -> Column:
    return F.format_string("%.4f", x)
