"""How throughput and latency follow the load: curve, knee, and Little's law."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.sketch import picks
from strideline.operators import steady
from strideline.operators.cube import Cube, cube
from strideline.operators.series import timed, totals


def curve(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """Throughput and p95 at every level of concurrent threads that some bucket reached."""
    run = cube(run, bucket_ms)
    rows = timed(run).groupBy("t", "slot").agg(F.max("threads").alias("threads"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("bucket_ms").alias("bucket_ms"))
    bucket = Window.partitionBy("t")  # one bucket's slots: the sketch bounds them
    rows = rows.withColumn("threads", F.max("threads").over(bucket)).withColumn("first", F.row_number().over(bucket.orderBy("slot")) == 1)
    levels = rows.where("threads > 0").groupBy("threads", "slot").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count_if("first").alias("b"), F.max("bucket_ms").alias("bucket_ms"))
    level = Window.partitionBy("threads")
    levels = levels.withColumn("_cum", F.sum("c").over(level.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("c").over(level))
    rate = F.sum("n") / (F.sum("b") * (F.max("bucket_ms") / 1000.0))
    return levels.groupBy("threads").agg(rate.alias("throughput"), *picks({"p95": 0.95}))


def knee(levels: DataFrame) -> DataFrame:
    """The interior level farthest above the straight line between the curve's ends, if by more than 0.02; else no row.

    The windows run over the curve, one row for each level of concurrency.
    """
    whole = Window.orderBy("threads").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = (lambda c: F.first(c).over(whole)), (lambda c: F.last(c).over(whole))
    along = lambda c: (F.col(c) - first(c)) / F.greatest(F.lit(1e-9), last(c) - first(c))
    rows = levels.withColumn("above", along("throughput") - along("threads"))
    rows = rows.withColumn("monotone", last("throughput") > first("throughput")).withColumn("inside", (F.col("threads") > first("threads")) & (F.col("threads") < last("threads")))
    best = rows.where("inside").orderBy(F.col("above").desc(), "threads").limit(1)
    return best.where("above > 0.02").select("threads", "throughput", "above", "monotone")


def littles_deviation(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """One row: how far load and throughput times response time differ over the steady window; -1 if it can't be told."""
    run = cube(run, bucket_ms)
    edge = F.broadcast(steady.window(run).withColumnsRenamed({"start_ms": "_from", "end_ms": "_to"}))
    total = totals(run).crossJoin(edge).where("t >= _from and t < _to")
    one = total.agg(F.sum("n").alias("n"), F.sum("sum_elapsed").alias("e"), F.avg("threads").alias("threads"), F.max(F.col("_to") - F.col("_from")).alias("ms"))
    predicted = F.col("e") / 1000.0 / (F.col("ms") / 1000.0)
    found = F.when(F.col("threads") <= 0, F.lit(0.0)).otherwise(F.abs(predicted - F.col("threads")) / F.col("threads"))
    return one.select(F.when(F.col("n") > 0, found).otherwise(F.lit(-1.0)).alias("deviation"))


def littles_residuals(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """Every loaded bucket's threads against throughput times response time: what is left is waiting that no sample shows."""
    total = totals(run, bucket_ms).where("n > 0 and threads > 0")
    predicted = F.col("sum_elapsed") / 1000.0 / (F.col("bucket_ms") / 1000.0)
    return total.select("t", "threads", predicted.alias("predicted"), (F.col("threads") - predicted).alias("residual"))
