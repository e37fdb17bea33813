"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Spark range-sorts the pieces by length and ranks each among its equals. A round takes all pieces of one length, the
longest first: each looks for the smallest gap that holds it (the successor of its length among the gaps); pieces that
want the same gaps are dealt to them by rank, gaps shrink, and pieces without one open sequences. Pieces of a length and
gaps of a size are held as runs of ranks and of sequence numbers, so a round's sweep is over run boundaries, whose number
the capacity bounds and the data doesn't; every row then finds its run by its rank, where it lies.

Defined cases: a null or empty text is one piece, the closing id alone; repeated rows are packed each; a document whose
ids just fill a sequence isn't cut; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import deque
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import arrow_flat, arrow_map, written
from strideline.llm.token_counts import byte_chars

#: Fixed value: how byte-level vocabularies of this family split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The ids of a byte-level vocabulary file; its special strings inside texts are its special ids, as its library reads them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_chars())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids with a closing id, long ones cut so that only the first piece is shorter."""

    def make():
        bpe = byte_bpe(path)

        def run(ids: list, texts: list) -> list:
            rows = []
            for doc, text in zip(ids, texts):
                found = np.array([*bpe.encode(text or "", allowed_special="all"), closing], "<u4")
                first = len(found) % capacity or capacity
                cuts = [0, *range(first, len(found) + 1, capacity)] if len(found) > capacity else [0, len(found)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(found[a:b].tobytes())))
            return list(zip(*rows)) if rows else [[]]

        return run

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    fields = [("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    return arrow_flat(plain, ["doc_id", "text"], fields, make, limit=1 << 20)


def sweep(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit for `count[length]` pieces: runs (length, first rank, first sequence, offset), and the sequences opened.

    A run ends where the next one of its length begins; within it rank and sequence number rise together.
    """
    gaps: dict[int, deque[list[int]]] = {}  # gap -> runs of sequences that have it: [first, number]
    order: list[int] = []  # gaps that have runs, ascending
    runs, opened = [], 0

    def add(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = deque()
                insort(order, gap)
            gaps[gap].append([first, number])

    for length in sorted(count, reverse=True):
        left, rank = count[length], 0
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                break
            gap = order[at]
            first, number = gaps[gap][0]
            k = min(left, number)
            runs.append((length, rank, first, capacity - gap))
            if k == number:
                gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gaps[gap][0] = [first + k, number - k]
            add(gap - length, first, k)
            left, rank = left - k, rank + k
        if left:
            layers = capacity // length
            whole, rest = divmod(left, layers)
            for layer in range(layers if whole else 0):
                runs.append((length, rank, opened, layer * length))
                rank += whole
            add(capacity - layers * length, opened, whole)
            opened += whole
            for layer in range(rest):
                runs.append((length, rank, opened, layer * length))
                rank += 1
            if rest:
                add(capacity - rest * length, opened, 1)
                opened += 1
    return runs, opened


def packed(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` with a sequence_id and the offset there."""
    spark = found.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = found.repartitionByRange(n, F.col("length").desc(), "ids_crc32", "doc_id", "piece").sortWithinPartitions(F.col("length").desc())
    # The id holds the partition in its high bits and the row's place there in its low ones.
    ranked = written(ranked.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    # A row for each length and partition that has it: sorted by length, so at most the capacity plus the partitions.
    held = ranked.groupBy("length", part.alias("part")).agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n")).orderBy(F.col("length").desc(), "part").collect()
    count: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in held:
        base[r["length"], r["part"]] = count.get(r["length"], 0) - r["first"]
        count[r["length"]] = count.get(r["length"], 0) + r["n"]
    runs, _ = sweep(count, capacity)
    runs.sort()
    keys = sorted(base)
    shift = 45
    shared = spark.sparkContext.broadcast(
        (
            np.array([(a << shift) + b for a, b in keys], np.int64), np.array([base[k] for k in keys], np.int64),
            np.array([(r[0] << shift) + r[1] for r in runs], np.int64), np.array(runs, np.int64).reshape(-1, 4),
        )
    )

    def make():
        at, add, start, run = shared.value

        def place(lengths: list, places: list) -> tuple[np.ndarray, np.ndarray]:
            length, place = np.array(lengths, np.int64), np.array(places, np.int64)
            rank = place + add[np.searchsorted(at, (length << shift) + (place >> 33))]
            mine = run[np.searchsorted(start, (length << shift) + rank, side="right") - 1]
            return mine[:, 2] + rank - mine[:, 1], mine[:, 3]

        return place

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return arrow_map(ranked, keep, ["length", "_place"], [("sequence_id", "long"), ("offset", "long")], make, by=None)


def best_fit(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; `path` is a vocabulary file that every node has."""
    return packed(written(pieces(docs, path, capacity), "pieces"), capacity)  # written: sampling for the range sort reads it again
