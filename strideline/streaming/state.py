"""The state of a live run as a table: a cube for each batch, numbered by it, folded from time to time.

Each batch of a stream is aggregated by itself and written under its number. A batch that is run again, as after a lost
driver, writes the same folder anew, so that nothing is lost and nothing counts twice. Every `FOLD` batches the cubes up to
there are added up into one table; a reader takes the last such table that is complete, and the batches after it. All that is
asked of a run, percentiles, Apdex, series or a whole report, can be asked of this state at any time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strideline.operators.cube import Cube, rows, summed
from strideline.operators.labels import Apdex

#: Batches that are kept apart before they are folded into one table.
FOLD = 32


def _folders(spark: SparkSession, folder: str) -> dict[tuple[str, int], str]:
    """(kind, number) of the complete tables of a state, and where they are; kind is batch or upto."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(path):
        return {}
    found = {}
    for f in store.listStatus(path):
        m = re.fullmatch(r"(batch|upto)-(\d+)", f.getPath().getName())
        if m and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found[m[1], int(m[2])] = f.getPath().toString()
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _current(spark: SparkSession, folder: str, before: int | None = None) -> list[str]:
    """The tables that make up the state, of batches below `before` if that is given."""
    found = {k: v for k, v in _folders(spark, folder).items() if before is None or k[1] < before}
    last = max((n for kind, n in found if kind == "upto"), default=-1)
    return [v for (kind, n), v in sorted(found.items()) if (kind == "upto" and n == last) or (kind == "batch" and n > last)]


def keep(folder: str, bucket_ms: int = 0, apdex: Apdex = Apdex(), fold: int = FOLD) -> Callable[[DataFrame, int], None]:
    """What a stream does with each of its batches: for `foreachBatch`."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and number % fold == 0:
            tables = _current(spark, folder, number)
            if tables and ("upto", number - 1) not in _folders(spark, folder):  # else this batch runs again
                summed(spark.read.parquet(*tables), "label", "at", "slot").write.mode("overwrite").parquet(f"{folder}/upto-{number - 1}")
                # Readers that began before may still read older tables, so those of the fold before this one go.
                for (_, n), old in _folders(spark, folder).items():
                    if n < number - 1 - fold:
                        _delete(spark, old)
        rows(batch, bucket_ms, apdex).write.mode("overwrite").parquet(f"{folder}/batch-{number}")

    return put


def cube(spark: SparkSession, folder: str, bucket_ms: int = 0) -> Cube:
    """The run so far, as every batch that is complete left it."""
    tables = _current(spark, folder)
    if not tables:
        raise FileNotFoundError(f"no batch is complete in {folder}")
    return Cube(summed(spark.read.parquet(*tables), "label", "at", "slot"), bucket_ms)


def kept(events: DataFrame, folder: str, checkpoint: str, every: str | None = None, bucket_ms: int = 0, apdex: Apdex = Apdex(), fold: int = FOLD) -> StreamingQuery:
    """Runs a stream of events into the state in `folder`: each `every` of time, or over what is there and then ends. Both folders must be shared by all executors."""
    writer = events.writeStream.foreachBatch(keep(folder, bucket_ms, apdex, fold)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
