"""Failures grouped by signature, with the labels that they hit and the load at which they began."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.text import signature
from strideline.operators.cube import Cube, at, cube
from strideline.operators.series import bounds, bucket_key, totals


def signed(events: DataFrame) -> DataFrame:
    failed = events.where(~F.col("success"))
    return failed.withColumn("signature", signature(F.col("response_code"), F.col("failure_message"), F.col("response_message")))


def clusters(events: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent signatures: code, count, first and last time."""
    out = signed(events).groupBy("signature").agg(F.min("response_code").alias("code"), F.count(F.lit(1)).alias("count"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))
    return out.orderBy(F.col("count").desc(), "signature").limit(limit)


def top_labels(events: DataFrame, k: int = 5) -> DataFrame:
    """The labels that each signature hits most, as rows ranked by count."""
    counted = signed(events).groupBy("signature", "label").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("signature").orderBy(F.col("count").desc(), "label")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def onset(events: DataFrame, bucket_ms: int = 0, limit: int = 50, run: Cube | None = None) -> DataFrame:
    """Threads and throughput of the bucket in which each of the most frequent signatures first appeared; `run` is the events' cube, if there is one."""
    run = run or cube(events, bucket_ms)
    found = clusters(events, limit)
    first = found.crossJoin(F.broadcast(bounds(run))).withColumn("at", at(run.bucket_ms, "first_ms")).withColumn("t", bucket_key())
    total = totals(run).select("t", "threads", "n")
    joined = first.join(total, "t", "left")
    rate = F.col("n") / (F.col("bucket_ms") / 1000.0)
    return joined.select("signature", "code", "count", "first_ms", "last_ms", F.coalesce("threads", F.lit(0)).alias("threads_at_onset"), F.coalesce(rate, F.lit(0.0)).alias("throughput_at_onset"))
