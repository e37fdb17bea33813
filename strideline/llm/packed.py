"""Keys of documents, and texts packed for the way through a shuffle."""

from __future__ import annotations

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import arrow_flat, written

#: A null doc_id takes part as the smallest of all.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the key of each document, (doc, sub), that sorts like doc_id.

    Rows of one doc_id and text are one document. `sub` is 0 where an id has one text, below 0, by the text's hash, where it
    has several; every row without an id is a document of its own, with NO_ID and a number above 0.
    """
    number = F.col(doc_id).cast("long")
    named = docs.where(number.isNotNull())
    h = F.xxhash64(F.col(text))
    several = named.groupBy(number.alias("_several")).agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("_several")
    several = written(several, "several")  # small as a rule, which Spark sees once it is written
    own = -F.shiftrightunsigned(h, 1) - 1
    named = named.join(several, number == F.col("_several"), "left").withColumn("doc", number).withColumn("sub", F.when(F.col("_several").isNull(), F.lit(0).cast("long")).otherwise(own)).drop("_several")
    nameless = docs.where(number.isNull()).withColumn("doc", F.lit(NO_ID).cast("long")).withColumn("sub", F.monotonically_increasing_id() + 1)
    return named.unionByName(written(nameless, "nameless"))  # written, as these numbers must stay the same


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, sub, packed) of (doc, sub, text): what a join moves instead of plain texts."""

    def make():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda doc, sub, texts: [doc, sub, [pack.compress((t or "").encode()) for t in texts]]

    return arrow_flat(docs, ["doc", "sub", "text"], [("doc", "long"), ("sub", "long"), ("packed", "binary")], make)
