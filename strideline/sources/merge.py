"""Any number of logs as one event table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from strideline.model import conform
from strideline.sources import csv_log, xml_log
from strideline.sources.detect import is_xml


def read_checked(spark: SparkSession, path: str, held: list[csv_log.Counted] | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Events of a file by its content (XML, Parquet by name, else CSV), and what is to be said about it.

    A CSV log is read once and counted on the way: one with too many malformed rows raises ValueError, fewer of them become
    warnings that show the first ten. Spark holds its rows until what is put into `held` is released.
    """
    if path.rstrip("/").endswith(".parquet"):
        return conform(spark.read.parquet(path)), ()
    if is_xml(spark, path):
        return xml_log.read(spark, path), ()
    log = csv_log.counted(spark, path)
    if held is not None:
        held.append(log)
    return log.log.events, (*([f"{log.malformed} malformed rows of {path} were skipped"] if log.malformed else []), *log.warnings)


def read_one(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path)[0]


def merged(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The bag union of files; order, where it matters, is (timestamp_ms, source_id, row_no)."""
    return reduce(DataFrame.unionByName, [read_one(spark, p) for p in paths])


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("timestamp_ms", "source_id", "row_no")
