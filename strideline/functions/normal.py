"""The normal distribution as a Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formula 26.2.17 of Abramowitz and Stegun, as rounded by the engine whose results must match.
SCALE, DENSITY = 0.2316419, 0.3989422804014327
TERMS = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)


def normal_cdf(x: Column) -> Column:
    t = F.lit(1.0) / (1.0 + SCALE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(TERMS):
        poly = t * (F.lit(c) + poly)
    tail = DENSITY * F.exp(-x * x / 2.0) * poly
    return F.when(x < -8, F.lit(0.0)).when(x > 8, F.lit(1.0)).when(x > 0, 1.0 - tail).otherwise(tail)
