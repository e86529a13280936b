"""Ranks and running totals of a whole table, or of keys that hold most of it.

A window over a hot key, or over no key, sorts it in one task.  Here rows are
dealt over ranges of the order first, ranges are totalled, and a row's figure
is its range's base plus its place within the range: two levels, the upper one
a row a range.  With as many ranges as rows in each, a task of either level
handles a number of rows that grows with the root of the table.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: int) -> int:
    """Ranges for so many rows: their root."""
    return 1 + isqrt(max(0, rows))


def bases(sized: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """(keys, bucket, value, base, whole): what the ranges before each hold, and all ranges of the key.

    ``sized`` has a row a key and range.
    """
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumns({"base": F.coalesce(F.sum(value).over(before), F.lit(0)), "whole": F.sum(value).over(over)})


def ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[Column | str], sized: DataFrame) -> DataFrame:
    """The rows with ``place`` (from 0) in their key, and ``whole``, the key's rows.

    ``bucket`` is a column that never falls along ``order`` within a key;
    ``sized`` (keys, bucket, n) counts its rows.  Keys aren't null.
    """
    at = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = rows.withColumn("_local", F.row_number().over(at) - 1)
    known = bases(sized, keys, bucket, "n").drop("n")
    return local.join(known, [*keys, bucket]).withColumn("place", F.col("base") + F.col("_local")).drop("_local", "base", bucket)
