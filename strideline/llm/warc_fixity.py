"""WARC fixity: Merkle trees over records and their offset ranges, compared from the root down.

Records stand in segments at ordered offset ranges. A leaf hashes a record's range and digest, an inner node the hashes of
up to FANOUT neighbours, and a node knows its place by number alone, so a level is one aggregation over groups of at most
FANOUT rows. Two replicas are compared root first; only the children of nodes that differ are looked at next, down to the
records that are damaged or missing. All of it is DataFrame work.

Defined cases: a null url or html is empty; a null page_id is written as 0 and sorts first; repeated pages are records of
their own; other columns are ignored; without records there are no trees and no damage.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm.common import arrow_flat, globally_ranked, numbered, written

FANOUT = 16
#: Records in a segment.
SEGMENT = 1024
_END = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record, as a string."""
    html = F.coalesce(html, F.lit(""))
    head = ["WARC/1.1", "WARC-Type: response", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id, F.lit(0)).cast("string"), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), "Content-Type: text/html"]
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")))
    lines = [x if isinstance(x, Column) else F.lit(x) for x in head]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END * 2), html, F.lit(_END * 2))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def laid_out(records: DataFrame, order: list, length: str = "length") -> DataFrame:
    """Adds each record's number, segment and offset, in place of columns of these names: segments of SEGMENT records in the order of the columns named."""
    from pyspark.sql import Window

    plain, (size, *by) = numbered(records.drop("number", "segment", "offset"), length, *order)
    names = [c for c in records.columns if c not in ("number", "segment", "offset")]
    rows = globally_ranked(plain, by, "records", "number").withColumn("segment", F.expr(f"number div {SEGMENT}"))
    before = Window.partitionBy("segment").orderBy("number")
    rows = rows.withColumn("offset", F.sum(size).over(before) - F.col(size)).select(*plain.columns, "number", "segment", "offset")
    return written(rows.toDF(*names, "number", "segment", "offset"), "segments")


def leaves(records: DataFrame, digest: str) -> DataFrame:
    """(number, hash) of records that have a digest."""
    span = F.concat_ws(":", F.col("segment").cast("string"), F.col("offset").cast("string"), (F.col("offset") + F.col("length")).cast("string"), F.col(digest))
    return records.where(F.col(digest).isNotNull()).select("number", sha256(span).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the root, each (number, hash)."""
    levels = [written(leaf, "level")]
    while True:
        top = levels[-1].agg(F.max("number").alias("m")).first()["m"]
        if not top:
            return levels
        children = F.sort_array(F.collect_list(F.struct("number", "hash")))  # FANOUT rows at most
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["number"].cast("string"), c["hash"])), "|")
        up = levels[-1].groupBy(F.expr(f"number div {FANOUT}").alias("parent")).agg(sha256(joined).alias("hash"))
        levels.append(written(up.withColumnRenamed("parent", "number"), "level"))


def damaged(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """Numbers of the records that differ or that one replica lacks: below nodes that differ alone."""
    suspect = None
    deep = max(len(primary), len(replica))
    for level in reversed(range(deep)):
        sides = []
        for levels, name in ((primary, "a"), (replica, "b")):
            if level >= len(levels):
                continue
            side = levels[level].withColumnRenamed("hash", name)
            if suspect is not None:
                side = side.join(suspect, F.expr(f"number div {FANOUT}") == F.col("_parent"), "left_semi")
            sides.append(side)
        if len(sides) < 2:  # trees of different heights: everything under the taller one's root is looked at
            continue
        both = sides[0].join(sides[1], "number", "full")
        suspect = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("number").alias("_parent"))
    return suspect.select(F.col("_parent").alias("number"))


def audit(records: DataFrame, digest: str = "sha256", replica: str = "replica_sha256") -> DataFrame:
    """The records with `intact`: false where the replica's bytes at the record's range aren't the record's."""
    mark = "bad"
    while mark in records.columns:
        mark += "_"
    found = damaged(tree(leaves(records, digest)), tree(leaves(records, replica))).withColumn(mark, F.lit(True))
    return records.join(found, "number", "left").withColumn("intact", F.col(mark).isNull()).drop(mark)


def rotated(html: Column) -> Column:
    """A damaged copy of the same length."""
    return F.concat(F.substring(html, 2, 1 << 30), F.substring(html, 1, 1))


def page_audit(pages: DataFrame, damage: Column) -> DataFrame:
    """Pages as records, audited against a replica in which the pages that `damage` marks have gone bad."""
    bad = F.when(damage, rotated(F.col("html"))).otherwise(F.col("html"))
    text, copy = record(F.col("page_id"), F.col("url"), F.col("html")), record(F.col("page_id"), F.col("url"), bad)
    hashed = pages.select("page_id", F.octet_length(text).cast("long").alias("length"), sha256(text).alias("sha256"), sha256(copy).alias("replica_sha256"))
    return audit(laid_out(hashed, ["page_id", "sha256"])).select("page_id", "segment", "offset", "length", "sha256", "intact")


def split_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of the records of a WARC file; of a packed one, places of its members."""
    at = 0
    if data[:2] == b"\x1f\x8b":
        view, step = memoryview(data), 1 << 16
        while at < len(data):
            member, parts, end = zlib.decompressobj(31), [], at
            while not member.eof and end < len(data):  # by steps, so that what follows isn't copied for each member
                parts.append(member.decompress(view[end : end + step]))
                end = min(len(data), end + step)
            if not member.eof:
                raise ValueError(f"the member at {at} has no end")
            end -= len(member.unused_data)
            yield at, end - at, b"".join(parts)
            at = end
        return
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            raise ValueError(f"the record at {at} has no end of its header")
        sizes = [line.split(b":", 1)[1] for line in data[at:head].split(b"\r\n") if line.lower().startswith(b"content-length:")]
        end = head + 4 + int(sizes[0] if sizes else 0) + 4
        yield at, end - at, data[at:end]
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, content) of the records of WARC files, packed or not, one task for each file; Spark refuses files over 2 GB."""

    def make():
        def run(paths: list, contents: list) -> list:
            rows = [(p, *r) for p, c in zip(paths, contents) for r in split_records(c)]
            return list(zip(*rows)) if rows else [[]]

        return run

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return arrow_flat(files, ["file", "content"], [("file", "string"), ("offset", "long"), ("length", "long"), ("content", "binary")], make, by="content")


def packed_record(text: str) -> bytes:
    """A record as one member of a packed WARC file."""
    return gzip.compress(text.encode(), mtime=0)
