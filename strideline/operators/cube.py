"""One table of a run, from which series, windows, curves and statistics follow without reading the events again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.labels import Apdex, measures, rollup_measures, sketch_slot, with_total


@dataclass(frozen=True)
class Cube:
    """Sums and sketch of every label in every second: (label, at, slot), the sums, and the sketch's count c.

    For buckets of under a second `at` is the event's own time. `rows` add up, so cubes of parts of a run make its cube.
    """

    rows: DataFrame
    bucket_ms: int = 0

    def cells(self) -> DataFrame:
        """The run as a whole: (label, is_total, slot), sums and c."""
        return with_total(summed(self.rows, "label", "slot"), [*rollup_measures(), F.sum("c").alias("c")], ("slot",))

    def release(self) -> None:
        self.rows.unpersist()


def at(bucket_ms: int = 0, ts: str = "timestamp_ms") -> Column:
    return F.col(ts) if 0 < bucket_ms < 1000 else F.expr(f"({ts} div 1000) * 1000")


def rows(events: DataFrame, bucket_ms: int = 0, apdex: Apdex = Apdex()) -> DataFrame:
    """A cube's rows, in one pass over the events."""
    return events.groupBy("label", at(bucket_ms).alias("at"), sketch_slot().alias("slot")).agg(*measures(apdex), F.count("elapsed_ms").alias("c"))


def summed(rows_: DataFrame, *keys: str | Column) -> DataFrame:
    return rows_.groupBy(*keys).agg(*rollup_measures(), F.sum("c").alias("c"))


def cube(run: DataFrame | Cube, bucket_ms: int = 0, apdex: Apdex = Apdex()) -> Cube:
    """The cube of a run's events, kept by Spark's cache once it is made; a cube stays what it is.

    The cache is made by what reads it first, and what a lost executor held of it is made again.
    """
    return run if isinstance(run, Cube) else Cube(rows(run, bucket_ms, apdex).persist(), bucket_ms)
