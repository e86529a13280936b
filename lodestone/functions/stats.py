"""Statistics as columns: intervals, exact tests, agreement, order statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
#: Parts that a key's values are split into to find a place.
PARTS = 32


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k in n, within [0, 1]; null where n is 0."""
    share, size = F.try_divide(k.cast("double"), n), n.cast("double")
    scale = 1 + F.try_divide(F.lit(z * z), size)
    middle = share + F.try_divide(F.lit(z * z), 2 * size)
    spread = z * F.sqrt(F.try_divide(share * (1 - share), size) + F.try_divide(F.lit(z * z), 4 * size * size))
    return F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)


def ratio(k: Column, n: Column) -> Column:
    """struct<k, n, rate, lo, hi>; no rate or interval where n is 0."""
    low, high = wilson(k, n)
    return F.struct(k.alias("k"), n.alias("n"), F.try_divide(k.cast("double"), n).alias("rate"), F.when(n > 0, low).alias("lo"), F.when(n > 0, high).alias("hi"))


def at_places(frame: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key, the values at some places from 0 in ascending order; nulls don't count.

    ``places`` are whole numbers below ``_n``, the key's number of values. A
    key's values are split at approximate quantiles, so a key that most rows
    have is sorted by many tasks and only where a place is.
    """
    rows = frame.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    shares = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, F.lit(1000))).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    dealt = rows.join(cuts, keys).select(*keys, part.alias("_part"), "_v")
    held = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))  # a few rows a key
    group = Window.partitionBy(*keys)
    before = F.sum("_c").over(group.orderBy("_part")) - F.col("_c")
    held = held.select("*", before.alias("_before"), F.sum("_c").over(group).alias("_n"))
    inside = [F.when(place.between(F.col("_before"), F.col("_before") + F.col("_c") - 1), place - F.col("_before")).alias(name) for name, place in places.items()]
    wanted = held.select(*keys, "_part", *inside).where(F.coalesce(*map(F.col, places)).isNotNull())
    met = dealt.join(wanted, [*keys, "_part"]).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_v")) - 1)
    return met.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == F.col(name), F.col("_v"))).alias(name) for name in places))


def upper_median(frame: DataFrame, keys: list[str], value: str, name: str, default: float | None = None) -> DataFrame:
    """Per key, the value at place n div 2 (from 0) in ascending order; nulls don't count.

    For values that repeat, such as sizes: equal ones are counted before they
    are ordered, so a key's sort is as long as its distinct values.
    """
    cells = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cells.select(*keys, value, upto.alias("_to"), F.col("_c"), F.sum("_c").over(group).alias("_n"))
    found = ranked.where(F.expr("_n div 2 between _to - _c and _to - 1")).select(*keys, F.col(value).alias(name))
    return found if default is None else frame.select(*keys).distinct().join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def nearest_rank(frame: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key, the values at places min(n - 1, floor(n * p)) from 0."""
    return at_places(frame, keys, value, {name: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))) for name, p in shares.items()})


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, Cohen's kappa (0 without pairs, 1 if one label)."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    left = cells.groupBy(F.col(a).alias("v")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(F.col(b).alias("v")).agg(F.sum("c").alias("y"))
    by_chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("e"))
    totals = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("c"))), F.lit(0)).alias("o"))
    both = totals.crossJoin(F.broadcast(by_chance))  # one row each
    observed, expected = F.col("o") / F.col("n").cast("double"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    value = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("e") == F.col("n").cast("double") * F.col("n"), F.lit(1.0)).otherwise(F.try_divide(observed - expected, 1 - expected))
    return both.select("n", F.when(F.col("n") > 0, observed).otherwise(F.lit(0.0)).alias("agreement"), value.alias("kappa"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over all pairs of labels that either side uses, missing as 0."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    labels = cells.select(F.col("a").alias("v")).union(cells.select("b")).distinct()
    grid = labels.select(F.col("v").alias("a")).crossJoin(labels.select(F.col("v").alias("b")))  # labels of one question form
    return grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p value; 1.0 without a win or loss."""

    def p(w: int, x: int) -> float:
        n, k = w + x, min(w, x)
        if n == 0:
            return 1.0
        top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        # Terms from the greatest down, until they no longer count: some roots of n of them.
        total, term, i = 1.0, 1.0, k
        while i > 0 and term > total * 1e-17:
            at = np.arange(i, max(0, i - 4096), -1, dtype=np.float64)
            parts = term * np.cumprod(at / (n - at + 1))
            total, term, i = total + float(parts.sum()), float(parts[-1]), i - len(at)
        return min(1.0, 2 * math.exp(top) * total)

    @F.pandas_udf("double")
    def tested(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([p(int(w), int(x)) for w, x in zip(a, b, strict=True)], dtype=float)

    return tested(wins, losses)


def histogram(frame: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal widths, the last one closed; empty bins left out."""
    ends = frame.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.floor(F.try_divide(F.col(value) - F.col("_lo"), (F.col("_hi") - F.col("_lo"))) * bins)
    number = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long")
    return frame.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row


def token_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """USD at prices a million tokens."""
    return (input_tokens * price_in + output_tokens * price_out) / 1e6
