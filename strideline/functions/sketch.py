"""A log-linear percentile sketch as sparse rows: exact below 128, then 128 slots for each doubling.

A histogram is a table (keys, slot, c); merging is adding up counts, and a quantile is a running sum over slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_SLOT = 3199
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def slot(v: Column) -> Column:
    v = F.greatest(v.cast("long"), F.lit(0))
    bits = F.length(F.bin(v))
    scaled = (bits - 6) * 128 + F.call_function("shiftright", v, (bits - 7).cast("int")).bitwiseAND(F.lit(127))
    return F.when(v < 128, v).otherwise(F.least(scaled, F.lit(LAST_SLOT))).cast("long")


def width(s: Column) -> Column:
    """Values in a slot."""
    return F.when(s < 128, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(s / 128) - 1).cast("int"))).cast("long")


def midpoint(s: Column) -> Column:
    """The value that stands for a slot."""
    up = (F.floor(s / 128) - 1).cast("int")
    low = F.call_function("shiftleft", (s % 128).cast("long"), up)
    half = F.floor(F.call_function("shiftleft", F.lit(1).cast("long"), up) / 2)
    return F.when(s < 128, s).otherwise(low + half).cast("long")


def histogram(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, slot, c) of the values that aren't null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, slot(F.col(value)).alias("slot")).agg(F.count(F.lit(1)).alias("c"))


def merged(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    return histograms.groupBy(*keys, "slot").agg(F.sum("c").alias("c"))


def quantiles(histograms: DataFrame, keys: Sequence[str], wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """(keys, one column for each quantile): the midpoint of the first slot whose running count reaches max(1, ceil(q n))."""
    every = Window.partitionBy(*keys)
    ranked = histograms.withColumn("_cum", F.sum("c").over(every.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_n", F.sum("c").over(every))
    return ranked.groupBy(*keys).agg(*picks(wanted))


def picks(wanted: dict[str, float], cum: str = "_cum", n: str = "_n") -> list[Column]:
    """Aggregates that pick quantiles from rows with their slot, the running count up to it and the whole count."""
    first = lambda q: F.min(F.when(F.col(cum) >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col(n))), F.col("slot")))
    return [midpoint(first(q)).alias(name) for name, q in wanted.items()]
