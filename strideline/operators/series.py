"""Time series: events fall on one-second slots, slots on buckets that begin with the run.

A bucket of under a second is cut from the events' own times. A run is given by its events or by their cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.cube import Cube, at, cube, summed
from strideline.operators.labels import Apdex, measures, rollup_measures, summarised, with_total


def bounds(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """One row: the run's begin, its end and its bucket, chosen by its length unless given."""
    first, last = ("first_ms", "last_ms") if isinstance(run, Cube) else ("timestamp_ms", F.col("timestamp_ms") + F.col("elapsed_ms"))
    given = run.bucket_ms if isinstance(run, Cube) else bucket_ms
    frame = run.rows if isinstance(run, Cube) else run
    edges = frame.agg(F.coalesce(F.min(first), F.lit(0)).alias("start_ms"), F.coalesce(F.max(last), F.lit(0)).alias("end_ms"))
    span = F.col("end_ms") - F.col("start_ms")
    auto = F.when(span <= 600_000, 1_000).when(span <= 7_200_000, 10_000).when(span <= 43_200_000, 60_000).otherwise(300_000)
    return edges.withColumn("bucket_ms", (F.lit(given) if given > 0 else auto).cast("long"))


def bucket_key(of: str = "at") -> Column:
    """The bucket of a second, given the columns of `bounds`; the division truncates toward zero."""
    return F.expr(f"(({of} - start_ms) div bucket_ms) * bucket_ms + start_ms")


def seconds(events: DataFrame, apdex: Apdex = Apdex()) -> DataFrame:
    """Sums of every label in every second, and of all labels."""
    return with_total(events.groupBy("label", at().alias("slot_ms")).agg(*measures(apdex)), rollup_measures(), ("slot_ms",))


def timed(run: Cube) -> DataFrame:
    """A cube's rows with their bucket `t` and the columns of `bounds`, which is one row."""
    return run.rows.crossJoin(F.broadcast(bounds(run))).withColumn("t", bucket_key())


def buckets(run: DataFrame | Cube, bucket_ms: int = 0, apdex: Apdex = Apdex()) -> DataFrame:
    """Sums of every label in every bucket `t`, and of all labels."""
    return with_total(timed(cube(run, bucket_ms, apdex)).groupBy("label", "t").agg(*rollup_measures()), rollup_measures(), ("t",))


def totals(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """What `buckets` has of all labels together: (t, threads, n, sum_elapsed)."""
    rows = timed(cube(run, bucket_ms)).groupBy("t")
    return rows.agg(F.max("threads").alias("threads"), F.sum("n").alias("n"), F.sum("sum_elapsed").alias("sum_elapsed"), F.max("bucket_ms").alias("bucket_ms"))


def fine(run: DataFrame | Cube, bucket_ms: int = 0, apdex: Apdex = Apdex()) -> DataFrame:
    """Sums and sketch together: (label, is_total, t, slot), the sums, and the sketch's count c."""
    rows = summed(timed(cube(run, bucket_ms, apdex)), "label", "t", "slot")
    return with_total(rows, [*rollup_measures(), F.sum("c").alias("c")], ("t", "slot"))


def cells(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """What a chart shows of every label in every bucket."""
    rows = summarised(fine(run, bucket_ms), ["label", "is_total", "t"], {"p95": 0.95})
    return rows.select(
        "label", "is_total", "t", "threads", "n", F.col("errors").alias("err"), (F.col("sum_elapsed") / F.col("n")).alias("mean"),
        "max", (F.col("bytes") / 1024.0).alias("kb"), (F.col("sent_bytes") / 1024.0).alias("kb_sent"), "p95",
    )


def by_bucket(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """One row for each bucket: the threads and the cell of all, and a map of every label's cell. A label may have any name, the rollup's too."""
    cell = F.struct("n", "err", "mean", "p95", "max", "kb", "kb_sent")
    own = F.collect_list(F.when(~F.col("is_total"), F.struct("label", cell.alias("cell"))))
    total = F.max(F.when(F.col("is_total"), cell))
    return cells(run, bucket_ms).groupBy("t").agg(F.max("threads").alias("threads"), total.alias("total"), F.map_from_entries(F.sort_array(own)).alias("per_label"))


def rates(series: DataFrame, bucket_ms: Column) -> DataFrame:
    """Per-second rates of cells."""
    s = bucket_ms / 1000.0
    return series.select("label", "is_total", "t", (F.col("n") / s).alias("per_s"), (F.col("err") / s).alias("err_per_s"), (F.col("kb") / s).alias("kb_per_s"))
