"""Substring deduplication over words, by level-wise doubling.

Windows repeated at one length alone are extended to twice that length: 9 words, then 18, then the 35 of a window, until
no candidates survive or the length is reached (see `doubling`). Before the first round, anchors with a unique gram of 8
words rule out all windows near them, and of equal contexts of anchors one goes on (see `repeats`).

Strings of 9 words and pairs of ranks are told apart by 64-bit hashes, which aren't verified: among n positions that
are still open in a round, some pair is taken for equal with a probability of about n * n / 2 ** 65, 3 % at a billion.

Defined cases: a null or empty text has no words; rows with one doc_id and one text are one document and each get
its result, one doc_id with several texts is a document for each; a text of fewer words than a window loses none; each row
with a null doc_id is a document of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import WORD
from strideline.llm.near_dup import word_hashes
from strideline.llm.packed import keyed
from strideline.llm.repeats import Repeats, with_spans
from strideline.llm.windows import intervals

WINDOW, GRAM = 35, 8


def word_symbols(text: str) -> np.ndarray:
    return word_hashes(WORD.findall(text))


def repeated_words(window: int = WINDOW, gram: int = GRAM) -> Repeats:
    return Repeats(window, gram, False, word_symbols, False)


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], int, int]:
    """(words kept, words in all, words removed)."""
    words = WORD.findall(text)
    removed, kept, at = 0, [], 0
    for a, z in intervals(spans, len(words)):
        kept += words[at:a]
        removed, at = removed + z - a, z
    return kept + words[at:], len(words), removed


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; with `texts`, the kept words as `kept` too."""
    plain = keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    fields = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "string")]
    fields = fields if texts else fields[:-1]

    def row(t: str | None, spans: list) -> tuple:
        kept, n, removed = cut(t or "", spans)
        joined = " ".join(kept)
        return (n, removed, hashlib.sha256(joined.encode()).hexdigest(), joined)[: len(fields)]

    return with_spans(plain, repeated_words(window, gram).spans(plain.select("doc", "sub", "text")), ["doc_id"], fields, row)
