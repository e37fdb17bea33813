"""The tables that a report shows: transactions with their grades, percentile profiles, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_grade(rate: Column) -> Column:
    return F.when(rate > 5, "bad").when(rate > 1, "warn").otherwise("good")


def apdex_grade(apdex: Column) -> Column:
    return F.when(apdex >= 0.94, "good").when(apdex >= 0.7, "warn").otherwise("bad")


def change_grade(change: Column) -> Column:
    return F.when(change > 0.5, "worse").when(change < -0.5, "better").otherwise("same")


def risk_grade(p: Column) -> Column:
    return F.when(p >= 0.8, "high").when(p >= 0.5, "some").otherwise("low")


def transactions(stats: DataFrame, key: str = "p95", descending: bool = True, search: str = "") -> DataFrame:
    """Labels ordered by any column with the rollup last, those alone whose name contains the search."""
    rows = stats.where(F.col("is_total") | F.contains(F.lower("label"), F.lit(search.lower())))
    rows = rows.withColumn("error_grade", error_grade(F.col("error_rate"))).withColumn("apdex_grade", apdex_grade(F.col("apdex")))
    return rows.orderBy("is_total", F.col(key).desc() if descending else F.col(key).asc(), "label")


def percentile_profile(stats: DataFrame, first: int = 7) -> DataFrame:
    """(label, is_total, pct, value) of the first labels by name and of the rollup."""
    names = ["p50", "p75", "p90", "p95", "p99", "p999"]
    shown = stats.where("not is_total").orderBy("label").limit(first).unionByName(stats.where("is_total"))
    return shown.select("label", "is_total", *names).unpivot(["label", "is_total"], names, "pct", "value")
