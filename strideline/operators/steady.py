"""The steady part of a run, and statistics over it alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.sketch import QUANTILES
from strideline.operators.cube import Cube, cube
from strideline.operators.labels import Apdex, derived, rollup_measures, summarised
from strideline.operators.series import bounds, fine, totals

#: Buckets whose order one task looks at.
CHUNK = 1 << 16

_RUN = "struct<a: bigint, z: bigint>"


def longest_run(marked: DataFrame, bucket_ms: str = "bucket_ms", chunk: int = CHUNK) -> DataFrame:
    """One row (a, z): first and last `t` of the longest run of rows `inside`, in the order of `t`, which is unique; the first of equals.

    Time is cut into chunks of so many buckets. Windows run inside a chunk, where they give its runs; of these a chunk keeps
    the one at its begin, the one at its end and the longest between. One fold over the chunks joins runs over their edges.
    """
    ordered = Window.partitionBy("chunk").orderBy("t")
    rows = marked.select("t", "inside", F.floor(F.col("t") / (F.col(bucket_ms) * chunk)).alias("chunk")).withColumn("i", F.row_number().over(ordered))
    # Rows inside of one run have the same distance between their place and their place among those inside.
    island = F.when(F.col("inside"), F.col("i") - F.sum(F.col("inside").cast("long")).over(ordered))
    runs = rows.withColumn("island", island).groupBy("chunk", "island").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.min("i").alias("from"), F.max("i").alias("to"))
    size = F.max("to").over(Window.partitionBy("chunk"))
    runs = runs.withColumn("size", size).where("island is not null or from = 1 or to = size")
    held = F.col("island").isNotNull()
    run = lambda where: F.when(held & where, F.struct("a", "z"))
    begins, ends = F.col("from") == 1, F.col("to") == F.col("size")
    # By length, and among equals the earliest: max_by needs an order with one winner.
    order = F.struct((F.col("z") - F.col("a")).alias("l"), (-F.col("a")).alias("e"))
    parts = runs.groupBy("chunk").agg(
        F.max(run(begins & ends)).alias("whole"), F.max(run(begins & ~ends)).alias("lead"), F.max(run(ends & ~begins)).alias("trail"),
        F.max_by(F.struct("a", "z"), F.when(held & ~begins & ~ends, order)).alias("within"),
    )
    every = parts.agg(F.array_sort(F.collect_list(F.struct("chunk", "whole", "lead", "trail", "within"))).alias("chunks"))

    def better(x: Column, y: Column) -> Column:
        longer = x.isNull() | (y["z"] - y["a"] > x["z"] - x["a"])
        return F.when(y.isNotNull() & longer, y).otherwise(x)

    def joined(open_: Column, run_: Column) -> Column:
        """An open run that `run_` goes on with."""
        return F.when(open_.isNull(), run_).otherwise(F.struct(open_["a"].alias("a"), run_["z"].alias("z")))

    def step(state: Column, c: Column) -> Column:
        open_, best = state["open"], state["best"]
        closed = F.when(c["lead"].isNotNull(), joined(open_, c["lead"])).otherwise(open_)
        best_ = better(better(best, closed), c["within"])
        return F.when(c["whole"].isNotNull(), F.struct(joined(open_, c["whole"]).alias("open"), best.alias("best"))).otherwise(F.struct(c["trail"].alias("open"), best_.alias("best")))

    start = F.struct(F.lit(None).cast(_RUN).alias("open"), F.lit(None).cast(_RUN).alias("best"))
    return every.select(F.aggregate("chunks", start, step, lambda s: better(s["best"], s["open"])).alias("run")).select("run.a", "run.z")


def window(run: DataFrame | Cube, bucket_ms: int = 0) -> DataFrame:
    """One row (start_ms, end_ms): the longest run of buckets whose load is within 5 % (1 at least) of the highest.

    Buckets without events don't break a run; the first of equals wins; a run of under three buckets is steady as a whole.
    """
    run = cube(run, bucket_ms)
    load = totals(run).select("t", F.coalesce("threads", F.lit(0)).alias("threads"), "bucket_ms")
    most = load.agg(F.max("threads").alias("plateau"), F.count(F.lit(1)).alias("held"))
    inside = F.abs(F.col("threads") - F.col("plateau")) <= F.greatest(F.lit(1.0), F.col("plateau") * 0.05)
    marked = load.crossJoin(F.broadcast(most)).select("t", "bucket_ms", ((F.col("held") >= 3) & (F.col("plateau") > 0) & inside).alias("inside"))
    joined = bounds(run).crossJoin(F.broadcast(longest_run(marked)))
    return joined.select(F.coalesce("a", "start_ms").alias("start_ms"), F.coalesce(F.col("z") + F.col("bucket_ms"), "end_ms").alias("end_ms"))


def statistics(run: DataFrame | Cube, bucket_ms: int = 0, apdex: Apdex = Apdex()) -> DataFrame:
    """Statistics of every label over the steady buckets; rates are over the window's length. A label without events there has no row."""
    run = cube(run, bucket_ms, apdex)
    edge = F.broadcast(window(run).withColumnsRenamed({"start_ms": "_from", "end_ms": "_to"}))
    keys = ["label", "is_total", "_from", "_to"]
    inside = fine(run).crossJoin(edge).where("t >= _from and t < _to")
    rows = summarised(inside.groupBy(*keys, "slot").agg(*rollup_measures(), F.sum("c").alias("c")), keys)
    # The rollup of a window counts each sample by its own label's thresholds.
    rows = rows.withColumn("total_satisfied", F.col("satisfied")).withColumn("total_tolerated", F.col("tolerated"))
    span = F.greatest(F.lit(0.001), (F.col("_to") - F.col("_from")) / 1000.0)
    return derived(rows, span, [*QUANTILES])


def or_full(steady: DataFrame, full: DataFrame) -> DataFrame:
    """Steady statistics of every label of `full`, and the full run's where a label has no event in the steady window."""
    both = full.alias("f").join(steady.alias("s"), ["label", "is_total"], "left")
    pick = lambda c: F.when(F.col("s.n").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    return both.select("label", "is_total", *(pick(c) for c in full.columns if c not in ("label", "is_total")))
