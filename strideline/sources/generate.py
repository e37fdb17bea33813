"""A deterministic run for demonstrations: ramp up, hold, ramp down, slower and failing under high load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.model import conform

LABELS = ("home", "search", "item", "cart", "pay", "logout")


def synthetic(spark: SparkSession, minutes: int = 10, peak: int = 200, every_ms: int = 40, seed: int = 42, start_ms: int = 1_700_000_000_000) -> DataFrame:
    """One sample for each tick; threads rise for a minute, stay at the peak, and fall for a minute."""
    length = minutes * 60_000
    at = F.col("id") * every_ms
    threads = F.greatest(F.lit(1), F.least(at / 60_000.0, F.lit(1.0), (length - at) / 60_000.0) * peak).cast("int")
    rows = spark.range(length // every_ms).withColumn("threads", threads).withColumn("u", F.rand(seed)).withColumn("v", F.rand(seed + 1))
    slow = F.when(F.col("threads") > 160, 1.0 + (F.col("threads") - 160) / 40.0).otherwise(1.0)
    elapsed = (40 + 160 * -F.log(1 - F.col("u") * 0.999)) * slow * F.when(F.col("v") > 0.999, 20).otherwise(1)
    failed = F.col("v") < F.when(F.col("threads") > 160, 0.05).otherwise(0.005)
    code = F.when(~failed, "200").when(F.col("id") % 3 == 0, "500").otherwise("502")
    return conform(
        rows.select(
            (F.lit(start_ms) + at).alias("timestamp_ms"), elapsed.cast("long").alias("elapsed_ms"), F.element_at(F.array(*map(F.lit, LABELS)), (F.col("id") % 6 + 1).cast("int")).alias("label"),
            code.alias("response_code"), (~failed).alias("success"), F.when(failed, F.concat(F.lit("upstream "), F.col("id").cast("string"), F.lit(" timed out"))).otherwise("").alias("failure_message"),
            F.when(failed, "Bad Gateway").otherwise("OK").alias("response_message"), (elapsed * 0.8).cast("long").alias("latency_ms"), F.lit(5).alias("connect_ms"),
            (1000 + F.col("id") % 500).alias("bytes"), F.lit(200).alias("sent_bytes"), F.col("threads").alias("grp_threads"), F.col("threads").alias("all_threads"),
            F.lit(False).alias("is_transaction"), F.lit(False).alias("is_sub_sample"), F.lit("synthetic").alias("source_id"), F.col("id").alias("row_no"),
        )
    )
