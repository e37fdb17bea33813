"""Index blocks and query blocks: rows gathered into packed arrays, and every block of queries met with every block of an index.

An index is dealt to shards, the queries to groups; each cell of that grid is one task, which reads its queries, then the
blocks of its shard one at a time. Queries are sent once for each shard, blocks of the index once for each group. Groups
are as many as keep all partitions busy and a task's queries few, so no side needs to be small.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import partitions, tidy, written

#: Blocks of queries that a task holds at once.
HELD = 64


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpacked(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as held:
        return {k: held[k] for k in held.files}


def ids_of(column: pa.Array) -> dict[str, np.ndarray]:
    """A column of nullable ids as numbers, and where there is none."""
    return {"ids": column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), "none": column.is_null().to_numpy(zero_copy_only=False)}


def blocks(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]]], name: str) -> DataFrame:
    """The written table (part, place, body): `make()` gives a task's function from its batches to the arrays of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, arrays in enumerate(make()(batches)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "place": pa.array([place], pa.int64()), "body": pa.array([packed(arrays)], pa.binary())})

    return written(df.mapInArrow(tidy(run), "part long, place long, body binary"), name)


def numbered_blocks(table: DataFrame) -> tuple[DataFrame, int]:
    """(number, body) with numbers from 0 without gaps, and how many there are; the driver sees one row for each task that made blocks."""
    before, starts = 0, []
    for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    first = table.sparkSession.createDataFrame(starts or [(0, 0)], "part long, first long")
    return table.join(F.broadcast(first), "part").select((F.col("first") + F.col("place")).alias("number"), "body"), before


def met(index: DataFrame, queries: DataFrame, answer: Callable[[list[bytes]], tuple[Callable[[bytes], None], Callable[[], pa.RecordBatch]]], schema: str) -> DataFrame:
    """What every query finds in every block of the index.

    In each task `answer(bodies of queries)` gives two functions: one takes a block's body, the other gives the rows found
    once all blocks of the shard were taken.
    """
    blocks_, n_blocks = numbered_blocks(index)
    asked, n_asked = numbered_blocks(queries)
    shards = max(1, min(n_blocks, partitions(index.sparkSession)))
    groups = max(1, min(n_asked, max(math.ceil(n_asked / HELD), math.ceil(partitions(index.sparkSession) / shards))))

    def cells(df: DataFrame, own: int, others: int, cell, kind: int) -> DataFrame:
        both = df.withColumn("own", F.col("number") % own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return both.select(cell(F.col("own"), F.col("other")).cast("int").alias("cell"), F.lit(kind).alias("kind"), "body")

    sent = cells(asked, groups, shards, lambda own, other: other * groups + own, 0).unionByName(cells(blocks_, shards, groups, lambda own, other: own * groups + other, 1))
    sent = sent.repartitionById(shards * groups, "cell").sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: list[bytes] = []
        take = give = None
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body")):
                if kind == 0:
                    bodies.append(body.as_py())
                elif bodies:
                    if take is None:
                        take, give = answer(bodies)
                    take(body.as_py())
        if give is not None:
            yield give()

    return sent.select("kind", "body").mapInArrow(tidy(run), schema)


def best(found: DataFrame, query: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first `k` rows of each query by `order`, with their `rank` from 1."""
    from pyspark.sql import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
