"""The one event schema that all operators read, and projections of other tables onto it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Absent latencies and connect times are null; so is the parent of a top-level sample.
EVENT = T.StructType(
    [
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("response_code", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("failure_message", T.StringType()),
        T.StructField("response_message", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("connect_ms", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sent_bytes", T.LongType()),
        T.StructField("grp_threads", T.IntegerType()),
        T.StructField("all_threads", T.IntegerType()),
        T.StructField("thread_name", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("is_transaction", T.BooleanType()),
        T.StructField("is_sub_sample", T.BooleanType()),
        T.StructField("parent_label", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("row_no", T.LongType()),
    ]
)

TOTAL = "TOTAL"
OTHER = "__OTHER__"


def conform(df: DataFrame) -> DataFrame:
    """Any table with some of EVENT's columns as an event table: the rest are null, types are cast.

    A sample without a label has the empty one, here and so in all operators.
    """
    have = set(df.columns)
    df = df.withColumn("label", F.coalesce(F.col("label"), F.lit(""))) if "label" in have else df.withColumn("label", F.lit(""))
    have.add("label")
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as samples; a value's tenth is a millisecond, its user's number stands for the load."""
    return as_user_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_user_events(raw: DataFrame) -> DataFrame:
    """The projection of `user_events` over a given table, streaming or not."""
    elapsed = F.round(F.col("value") * 10).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    ok = (F.col("event_type") != "error") & (F.col("event_id") % 17 != 0)
    failure = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Connection reset by peer 10.0."), k.cast("string")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Txn DEADBEEF"), F.col("event_id").cast("string"), F.lit(" at line "), k.cast("string"), F.lit("  Feedback failed")))
        .when(F.col("event_id") % 4 == 2, F.lit(""))
        .otherwise(F.concat(F.lit("Timeout after "), elapsed.cast("string"), F.lit(" ms")))
    )
    return conform(
        raw.select(
            F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
            elapsed.alias("elapsed_ms"),
            F.col("event_type").alias("label"),
            F.when(ok, F.lit("200")).when(F.col("event_id") % 2 == 0, F.lit("500")).otherwise(F.lit("502")).alias("response_code"),
            ok.alias("success"),
            F.when(ok, F.lit("")).otherwise(failure).alias("failure_message"),
            F.when(ok, F.lit("OK")).otherwise(F.lit("Server Error")).alias("response_message"),
            F.when(F.col("event_id") % 3 != 0, F.expr("cast(round(value * 10) as bigint) * 85 div 100")).alias("latency_ms"),
            F.when(F.col("event_id") % 3 != 0, F.expr("cast(round(value * 10) as bigint) * 10 div 100")).alias("connect_ms"),
            (k * 100).alias("bytes"),
            (k * 10).alias("sent_bytes"),
            (F.col("user_id") % 50 + 1).alias("all_threads"),
            F.lit(False).alias("is_transaction"),
            (F.col("event_id") % 10 == 0).alias("is_sub_sample"),
            F.lit("events").alias("source_id"),
            F.col("event_id").alias("row_no"),
        )
    )


def runs(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A baseline and a slower candidate out of one table: even and odd rows, the odd ones a fifth slower."""
    slower = F.expr("elapsed_ms * 12 div 10")
    return events.where("row_no % 2 = 0"), events.where("row_no % 2 = 1").withColumn("elapsed_ms", slower)


def capped_labels(events: DataFrame, cap: int) -> DataFrame:
    """The first `cap` labels by first appearance (time, source, row) keep their names, the others become OTHER.

    Only the kept names, at most `cap` of them, are sent to all executors.
    """
    first = events.groupBy("label").agg(F.min(F.struct("timestamp_ms", "source_id", "row_no")).alias("_first"))
    kept = first.orderBy("_first", "label").limit(cap).select(F.col("label").alias("_kept"))
    joined = events.join(F.broadcast(kept), F.col("label").eqNullSafe(F.col("_kept")), "left")
    return joined.withColumn("label", F.when(F.col("_kept").isNotNull(), F.col("label")).otherwise(F.lit(OTHER))).drop("_kept")


def hidden_labels(events: DataFrame, cap: int) -> int:
    """Labels that `capped_labels` would rename."""
    return max(0, events.agg(F.count_distinct(F.coalesce("label", F.lit("")))).first()[0] - cap)


def without_sub_samples(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("is_sub_sample"), F.lit(False)))
