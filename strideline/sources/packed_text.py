"""Lines of files that gzip packed under any name, unpacked in tasks.

Spark takes a file without the suffix .gz for plain text. Its text source hands on the bytes between line feeds as they are, so
the packed bytes come through it from any store, in splits. Each file's pieces then go to one task, in their order, which
unpacks them as they stream by; a packed file can't be unpacked in parts. Files that aren't packed pass as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.sources.detect import GZIP

#: Lines of a batch that a task hands on.
LINES = 10_000


class Unpacked:
    """Whole lines out of a file's bytes as they come."""

    def __init__(self) -> None:
        self.inflate: zlib._Decompress | None = None
        self.plain: bool | None = None
        self.rest = b""

    def lines(self, data: bytes) -> list[bytes]:
        if self.plain is None:
            self.plain = data[:2] != GZIP
        out = [data] if self.plain else []
        while data and not self.plain:
            self.inflate = self.inflate or zlib.decompressobj(31)
            out.append(self.inflate.decompress(data))
            # Behind one packed member there may be another; anything else behind it is no text.
            data = self.inflate.unused_data.lstrip(b"\0") if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate, data = None, data if data[:1] == GZIP[:1] else b""
        *found, self.rest = (self.rest + b"".join(out)).split(b"\n")
        return found


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of each file in one task; `start` is 0, as of a file that is one split."""
    read = spark.read.option("lineSep", "\n").text(path)
    files = sorted(read.inputFiles())
    raw = read.select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("i"))
    n = max(1, min(len(files), 10_000))
    # Few files are dealt by their place in the list, so that each has a task of its own.
    task = F.pmod(F.xxhash64("file"), F.lit(n)).cast("int")
    if len(files) <= 1000:
        # An address without an authority is written with one slash or with three.
        names = F.array(*(F.lit(re.sub(r"^(\w+):/+", r"\1:/", f)) for f in files))
        at = F.array_position(names, F.regexp_replace("file", r"^(\w+):/+", "$1:/")).cast("int") if files else F.lit(0)
        task = F.when(at > 0, at - 1).otherwise(task)
    dealt = raw.withColumn("task", task).repartitionById(n, F.col("task")).sortWithinPartitions("file", "begin", "i").select("raw", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, Unpacked()

        def rows(found: list[bytes]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(found), LINES):
                text = [x.decode("utf-8", "replace") for x in found[a : a + LINES]]
                yield pa.RecordBatch.from_pydict({"value": pa.array(text, pa.string()), "file": pa.array([file] * len(text), pa.string()), "start": pa.array([0] * len(text), pa.int64())})

        for batch in batches:
            names, pieces = batch.column("file").to_pylist(), batch.column("raw").to_pylist()
            a = 0
            while a < len(names):
                z = a + 1
                while z < len(names) and names[z] == names[a]:
                    z += 1
                if names[a] != file:
                    if held.rest:
                        yield from rows([held.rest])
                    file, held = names[a], Unpacked()
                yield from rows(held.lines(b"".join(p + b"\n" for p in pieces[a:z])))
                a = z
        if held.rest:
            yield from rows([held.rest])

    return dealt.mapInArrow(run, "value string, file string, start long")
