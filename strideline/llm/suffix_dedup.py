"""Suffix-array deduplication over bytes, by distributed prefix doubling.

Positions are ranked by the bytes that follow them: by a hash of 25 at first, then Spark sorts pairs of the ranks at a
position and at an offset (25, then 50) and ranks anew, until a position is unique or the 100 bytes of the threshold are
reached (see `doubling`). A rank is the earliest address with the same bytes, so that a position whose rank is smaller
than itself repeats an earlier one. Ranks tell equal strings from different ones, which is all that removal asks for;
the lexical order of suffixes is not made.

Only positions that can repeat take part: anchors with a unique 32-byte gram rule out all positions near them, and of
equal contexts of anchors one stays (see `repeats`). All positions of all texts in each round would shuffle a row for
each byte of input, beyond the disk that the check allows.

Strings of 25 bytes and pairs of ranks are told apart by 64-bit hashes, which aren't verified: among n positions that
are still open in a round, some pair is taken for equal with a probability of about n * n / 2 ** 65, 3 % at a billion.

Defined cases: a null or empty text has no bytes; rows with one doc_id and one text are one document and each get its
result; one doc_id with several texts is a document for each, in the order of their hashes; a null doc_id counts as the
smallest and each row with one is a document of its own, in the order of the table; other columns, whatever their names,
pass through untouched in `trimmed`, where bytes that a cut leaves of a character go with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import numbered
from strideline.llm.packed import keyed
from strideline.llm.repeats import Repeats, byte_symbols, with_spans
from strideline.llm.windows import intervals

WINDOW, GRAM = 100, 32


def utf8_symbols(text: str) -> np.ndarray:
    return byte_symbols(text.encode())


def repeated_bytes(window: int = WINDOW, gram: int = GRAM) -> Repeats:
    return Repeats(window, gram, True, utf8_symbols, True)


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[bytes, int, int, int]:
    """(bytes kept, bytes in all, bytes removed, removed runs)."""
    raw = text.encode()
    runs = intervals(spans, len(raw))
    kept, at = [], 0
    for a, z in runs:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return b"".join(kept), len(raw), sum(z - a for a, z in runs), len(runs)


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    plain = keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))

    def row(t: str | None, spans: list) -> tuple:
        kept, n, removed, runs = cut(t or "", spans)
        return n, removed, runs, hashlib.sha256(kept).hexdigest()

    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
    return with_spans(plain, repeated_bytes(window, gram).spans(plain.select("doc", "sub", "text")), ["doc_id"], fields, row)


def trimmed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with what repeats earlier bytes cut from their texts, and n_chars, if there is one, counted anew."""
    plain, (i, t) = numbered(docs, doc_id, text)
    keys = keyed(plain, i, t)
    texts = keys.withColumnRenamed(t, "text")
    spans = repeated_bytes(window, gram).spans(texts.select("doc", "sub", "text"))
    others = [c for c in plain.columns if c != t]
    new = with_spans(texts, spans, others, [(t, "string")], lambda t, s: (None if t is None else cut(t, s)[0].decode("utf-8", "ignore"),))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        new = new.withColumn(n, F.length(t).cast(docs.schema["n_chars"].dataType))
    return new.select(*plain.columns).toDF(*docs.columns)
