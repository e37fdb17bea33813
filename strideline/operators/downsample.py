"""Charts keep their shape with fewer points: largest-triangle-three-buckets for every label's series.

A bucket's pick spans the largest triangle with the last pick and the next bucket's mean. That area is, up to its sign, linear in
the point, so a pick is always a vertex of its bucket's convex hull. Spark numbers a series' points and cuts it into buckets; each
bucket is thinned to its hull, in pieces of bounded size; what is left of a series, a few points for each bucket, is
picked one after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points, at most, whose order or hull one task looks at, if they lie at least `step_ms` apart.
CHUNK = 1 << 16

_KEY = ["label", "is_total"]


def largest_triangles(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Places of the points kept: both ends, and one from each bucket; the plain form, over a whole series."""
    n = len(x)
    if n <= limit or limit < 3:
        return np.arange(n)
    edges = np.floor(np.linspace(1, n - 1, limit - 1)).astype(int)
    kept = [0]
    for k in range(limit - 2):
        a, b = edges[k], edges[k + 1]
        c = edges[k + 2] if k + 2 < len(edges) else n
        kept.append(a + picked(x[a:b], y[a:b], x[kept[-1]], y[kept[-1]], x[b:c].mean(), y[b:c].mean()))
    return np.array([*kept, n - 1])


def picked(x: np.ndarray, y: np.ndarray, px: float, py: float, mx: float, my: float) -> int:
    return int(np.argmax(np.abs((px - mx) * (y - py) - (px - x) * (my - py))))


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the points that no line can leave behind, by ascending x; those within rounding of the hull's edges stay."""
    if len(x) <= 3:
        return np.arange(len(x))
    x, y = x - x[0], y - y[0]
    slack = 1e-9 * max(float(np.abs(x).max()) * float(np.abs(y).max()), 1e-300)
    out: set[int] = set()
    for side in (1, -1):
        chain: list[int] = []
        for i in range(len(x)):
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if side * ((x[b] - x[a]) * (y[i] - y[a]) - (x[i] - x[a]) * (y[b] - y[a])) > slack:
                    chain.pop()
                else:
                    break
            chain.append(i)
        out.update(chain)
    return np.array(sorted(out))


def numbered(rows: DataFrame, step_ms: int) -> DataFrame:
    """A series' points with their place `i` from 0 and their number `n`, without a series in one task: places inside chunks of time, after those of earlier chunks."""
    rows = rows.withColumn("chunk", F.floor(F.col("t") / (step_ms * CHUNK)))
    chunks = rows.groupBy(*_KEY, "chunk").agg(F.count(F.lit(1)).alias("own"))
    label = Window.partitionBy(*_KEY)
    before = F.sum("own").over(label.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(*_KEY, "chunk", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(label).alias("n"))
    place = F.row_number().over(Window.partitionBy(*_KEY, "chunk").orderBy("t"))
    return rows.withColumn("i", place - 1).join(chunks, [*_KEY, "chunk"]).withColumn("i", F.col("i") + F.col("before")).drop("before")


def thinned(series: DataFrame, metric: str = "mean", limit: int = 2000, step_ms: int = 1000) -> DataFrame:
    """(label, is_total, t, value): at most `limit` points of each label's series. Points without a value don't count.

    `step_ms` is how far apart points lie at least; a series of closer ones is right as well, in larger pieces.
    """
    rows = series.selectExpr(*_KEY, "t", f"cast({metric} as double) as value").where("value is not null")
    if limit < 3:
        return rows
    rows = numbered(rows, step_ms)
    # Bucket k holds places from edge(k) to before edge(k + 1); the first point is bucket -1 and the last one limit - 2.
    step = (F.col("n") - 2.0) / F.lit(limit - 2.0)
    edge = lambda k: F.floor(k * step + 1.0)
    near = F.floor((F.col("i") - 1) / step)
    k = F.when(F.col("i") == 0, -1).when(F.col("i") == F.col("n") - 1, limit - 2).when(edge(near + 1) <= F.col("i"), near + 1).when(edge(near) > F.col("i"), near - 1).otherwise(near)
    rows = rows.withColumn("k", F.when(F.col("n") > limit, k).cast("long"))
    short = rows.where("k is null").select(*_KEY, "t", "value")
    long_ = rows.where("k is not null")

    def outlines(pdf: pd.DataFrame) -> pd.DataFrame:
        """The hull of each bucket, or of what a group has of it."""
        pdf = pdf.sort_values(["k", "t"])
        t, v = pdf["t"].to_numpy(float), pdf["value"].to_numpy(float)
        cut = np.append(np.nonzero(np.diff(pdf["k"].to_numpy(), prepend=-2))[0], len(pdf))
        return pdf.iloc[np.concatenate([a + hull(t[a:z], v[a:z]) for a, z in zip(cut, cut[1:])])][["label", "is_total", "k", "t", "value"]]

    fields = "label string, is_total boolean, k long, t long, value double"
    edges = long_.select(*_KEY, "k", "t", "value", "chunk").groupBy(*_KEY, "chunk").applyInPandas(outlines, fields)
    # Once more for buckets that lie in several chunks.
    edges = edges.groupBy(*_KEY, F.floor(F.col("k") / 64).alias("some")).applyInPandas(outlines, fields)
    means = long_.groupBy(*_KEY, "k").agg(F.avg("t").alias("mt"), F.avg("value").alias("mv"))
    after = means.select(*_KEY, (F.col("k") - 1).alias("k"), "mt", "mv")
    points = edges.join(after, [*_KEY, "k"], "left")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "t"])
        t, v, mt, mv = (pdf[c].to_numpy(float) for c in ("t", "value", "mt", "mv"))
        cut = np.append(np.nonzero(np.diff(pdf["k"].to_numpy(), prepend=-2))[0], len(pdf))
        kept = [0]
        for a, z in zip(cut[1:-2], cut[2:-1]):
            kept.append(a + picked(t[a:z], v[a:z], t[kept[-1]], v[kept[-1]], mt[a], mv[a]))
        return pdf.iloc[[*kept, len(pdf) - 1]][["label", "is_total", "t", "value"]]

    return short.unionByName(points.groupBy(*_KEY).applyInPandas(pick, "label string, is_total boolean, t long, value double"))
