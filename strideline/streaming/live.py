"""Live runs: the same statistics over a stream, kept for the whole run and finished as a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strideline.functions.sketch import slot
from strideline.model import EVENT, TOTAL, as_user_events
from strideline.operators import labels, series
from strideline.plans import report
from strideline.sources.staging import fresh_dir
from strideline.streaming import state


def collected_events(rows: DataFrame) -> DataFrame:
    """Events as a collector writes them: a failure without a message of its own has the response's."""
    silent = ~F.coalesce("success", F.lit(False)) & (F.coalesce("failure_message", F.lit("")) == "")
    rows = rows.withColumn("label", F.coalesce("label", F.lit(""))) if "label" in rows.columns else rows
    return rows.withColumn("failure_message", F.when(silent, F.col("response_message")).otherwise(F.col("failure_message")))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as they arrive: JSON files in EVENT's schema that a collector drops into a folder."""
    return collected_events(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path))


def finished(spark: SparkSession, path: str, options: report.Options | None = None) -> report.Bundle:
    """The report of a run whose stream has ended, out of all that its collector dropped."""
    return report.analysed(collected_events(spark.read.schema(EVENT).json(path)), options)


def label_counts(events: DataFrame) -> DataFrame:
    """Counts of every label and of all events so far."""
    both = events.groupingSets([["label"], []], "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.sum(F.greatest("elapsed_ms", F.lit(0))).alias("sum_elapsed"), F.grouping("label").alias("_total")
    )
    return both.select(F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col("label")).alias("label"), (F.col("_total") == 1).alias("is_total"), "n", "errors", "sum_elapsed")


def live_slots(events: DataFrame) -> DataFrame:
    """Sketch rows of every label so far."""
    return events.groupBy("label", slot(F.col("elapsed_ms")).alias("slot")).agg(F.count(F.lit(1)).alias("c"))


def windows(events: DataFrame, length: str = "1 second", late: str | None = None) -> DataFrame:
    """Counts in tumbling windows; with `late`, windows close and their state goes once that much time has passed."""
    timed = events.withColumn("at", F.timestamp_millis("timestamp_ms"))
    timed = timed.withWatermark("at", late) if late else timed
    return timed.groupBy("label", F.window("at", length)).agg(F.count(F.lit(1)).alias("n"), F.max("all_threads").alias("threads"))


def once(events: DataFrame, late: str, keys: tuple[str, ...] = ("source_id", "row_no")) -> DataFrame:
    """Events that a collector may send again, each once; a copy is known for as long as `late`, and what comes later than that is dropped."""
    return events.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys))


def closed_windows(events: DataFrame, length: str = "1 second", late: str = "30 seconds", slide: str | None = None) -> DataFrame:
    """(label, start_ms, n, errors, threads) of windows, for append mode: each comes out once, when no event of it is waited for any more."""
    timed = events if "at" in events.columns else events.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late)
    window = F.window("at", length, slide) if slide else F.window("at", length)
    out = timed.groupBy("label", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.max("all_threads").alias("threads"))
    return out.select("label", F.unix_millis("w.start").alias("start_ms"), "n", "errors", "threads")


def sessions(events: DataFrame, gap: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """(thread_name, start_ms, end_ms, n, errors) of every thread's sessions, which end after `gap` without an event; for append mode."""
    timed = events if "at" in events.columns else events.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late)
    out = timed.groupBy("thread_name", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"))
    return out.select("thread_name", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n", "errors")


def collected(events: DataFrame, name: str, checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Runs `label_counts` into an in-memory table of that name: each second of time, or over what is there and then ends."""
    writer = label_counts(events).writeStream.format("memory").queryName(name).outputMode("complete")
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Progress(StreamingQueryListener):
    """Counts over all batches of all queries: rows received by batches that began, and rows and batches that are done.

    Spark itself keeps the last batches alone. Add it with `spark.streams.addListener`.
    """

    def __init__(self) -> None:
        self.received = self.processed = self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.received += sum(s.numInputRows for s in p.sources)
        self.processed += p.numInputRows
        self.batches += p.numInputRows > 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def user_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a stream from its Parquet file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_user_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _ended(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def label_counts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a stream, to the end, and its counts."""
    name = f"live_{uuid.uuid4().hex}"
    _ended(collected(user_event_stream(spark, sf_dir), name))
    return spark.table(name)


def _state_of(spark: SparkSession, sf_dir: str):
    folder = fresh_dir(spark, "live")
    _ended(state.kept(user_event_stream(spark, sf_dir), f"{folder}/state", f"{folder}/checkpoint"))
    return state.cube(spark, f"{folder}/state")


def percentiles_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a stream, to the end, and percentiles and Apdex out of its state."""
    rows = labels.statistics(_state_of(spark, sf_dir))
    return rows.select("label", "is_total", "n", F.round("apdex", 6).alias("apdex"), *labels.QUANTILES)


def series_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a stream, to the end, and the series out of its state."""
    rows = series.cells(_state_of(spark, sf_dir))
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def closed_windows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the `events` table as a stream that have closed at its end, an hour after their last event."""
    folder = fresh_dir(spark, "windows")
    rows = closed_windows(once(user_event_stream(spark, sf_dir), "1 hour"), "1 hour")
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    _ended(writer.trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
