"""Exact top-k search by inner product over a bit-sliced index.

Components become integers floor(scale * x). A block of rows, ascending by id, stores each attribute above its least
value as bitmaps, one for each binary digit. A query's score of all rows of a block is then a sum of bitmaps with binary
weights: a digit of the coefficient shifts an attribute's slices, a negative coefficient takes their complements, and
carry-save adders reduce all bitmaps of a weight to one. The k best are selected from the most significant slice of the
sum downward; rows that are equal through all slices at the boundary are taken by ascending id.

Defined cases: vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count as filled
up with zeros. Every row that `asks` is a query of its own; rows under its id, repeated ones included, aren't its
candidates. A null id sorts last and asks nothing. Components beyond 2**25 / scale in magnitude are refused. An empty
table, or one without queries, gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.blocks import best, blocks, ids_of, met, unpacked
from strideline.llm.common import dropped, partitions, written
from strideline.llm.vectors import floored, widened

#: Rows of a block of the index, and queries of a block of queries.
ROWS, ASKED = 1 << 15, 64


def matrices(batches: Iterator[pa.RecordBatch], scale: int, rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Ids and whole vectors of a task, `rows` at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def joined(parts):
        width = max(x.shape[1] for _, _, x in parts)
        return {"ids": np.concatenate([i for i, _, _ in parts]), "none": np.concatenate([n for _, n, _ in parts]), "rows": np.concatenate([widened(x, width) for _, _, x in parts])}

    for batch in batches:
        whole, x = floored(batch.column("vector"), scale)
        ids = {k: v[whole] for k, v in ids_of(batch.column("id")).items()}
        at = 0
        while at < len(x):
            room = rows - sum(len(i) for i, _, _ in held)
            held.append((ids["ids"][at : at + room], ids["none"][at : at + room], x[at : at + room]))
            at += room
            if sum(len(i) for i, _, _ in held) == rows:
                yield joined(held)
                held = []
    if held:
        yield joined(held)


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Packed bits along the last axis, in whole 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)]).view(np.uint64)


def sliced(ids: np.ndarray, none: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """A block's slices: `slices[first[d] : first[d + 1]]` are the digits of attribute d above `least[d]`, the lowest first."""
    order = np.lexsort((ids, none))
    rows = rows[order]
    least = rows.min(axis=0)
    above = rows - least
    digits = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int64)
    first = np.concatenate([[0], np.cumsum(digits)])
    made = [bitmap((above[:, d][None, :] >> np.arange(n)[:, None]) & 1 == 1) for d, n in enumerate(digits) if n]
    words = -(-len(rows) // 64)
    return {"ids": ids[order], "none": none[order], "least": least, "first": first, "slices": np.concatenate(made) if made else np.zeros((0, words), np.uint64)}


def added(columns: list[np.ndarray], words: int) -> list[np.ndarray]:
    """The binary digits of the sum of bitmaps, `columns[w]` holding those of weight 2**w as rows, by carry-save adders."""
    out, carried, w = [], [], 0
    while w < len(columns) or carried:
        x = np.concatenate([*(columns[w : w + 1]), *carried]) if w < len(columns) or carried else None
        carried = []
        while len(x) >= 3:
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            half = a ^ b
            carried.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * n :]])
        if len(x) == 2:
            carried.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        w += 1
    return out


def score_slices(block: dict[str, np.ndarray], query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The slices of every row's score above a constant, and that constant."""
    first, least, slices = block["first"], block["least"], block["slices"]
    plain: list[list[int]] = []
    turned: list[list[int]] = []
    base = 0
    for d, q in enumerate(query[: len(least)].tolist()):
        n = int(first[d + 1] - first[d])
        base += q * int(least[d])
        if q < 0:
            base += q * ((1 << n) - 1)  # q * u = -q * (2**n - 1 - u) + q * (2**n - 1)
        kind, m, shift = (turned if q < 0 else plain), abs(q), 0
        while m and n:
            if m & 1:
                while len(kind) < shift + n:
                    kind.append([])
                for b in range(n):
                    kind[shift + b].append(int(first[d]) + b)
            m >>= 1
            shift += 1
    columns = []
    for w in range(max(len(plain), len(turned))):
        a = slices[plain[w]] if w < len(plain) and plain[w] else slices[:0]
        b = ~slices[turned[w]] if w < len(turned) and turned[w] else slices[:0]
        columns.append(np.concatenate([a, b]))
    return added(columns, slices.shape[1]), base


def places(bits: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))[0]


def selected(digits: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of `among` with the largest sums; of equal ones at the boundary the first."""
    count = lambda bits: int(np.bitwise_count(bits).sum())
    sure, open_, n = np.zeros_like(among), among, 0
    for digit in reversed(digits):
        ones = open_ & digit
        m = count(ones)
        if n + m > k:
            open_ = ones
        else:
            sure, n, open_ = sure | ones, n + m, open_ & ~digit
            if n == k:
                return places(sure)
    return np.concatenate([places(sure), places(open_)[: k - n]])


def top(block: dict[str, np.ndarray], query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a block's k best rows that aren't the query's own."""
    digits, base = score_slices(block, query)
    among = bitmap((block["ids"] != own) | block["none"])
    at = selected(digits, among, k)
    scores = np.full(len(at), base, np.int64)
    for w, digit in enumerate(digits):
        scores += ((digit[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
    return at, scores


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, rows: int = ROWS) -> DataFrame:
    """The written bit-sliced index of all whole vectors, in blocks of up to `rows`."""

    def make():
        return lambda batches: (sliced(m["ids"], m["none"], m["rows"]) for m in matrices(batches, scale, rows))

    used = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    least = max(1, -(-used.count() // rows))
    # A small table may be read in splits of a few rows; it is dealt to as few tasks as make whole blocks. Splits of a large one fill blocks as they are.
    return blocks(used.repartition(least) if least < partitions(vectors.sparkSession) else used, make, "slices")


def searched(sliced_: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` best rows for every row of `queries`, ties to the smaller vec_id."""

    def asked():
        def run(batches):
            part = TaskContext.get().partitionId() << 33
            for i, m in enumerate(matrices(batches, scale, ASKED)):
                yield m | {"keys": part + i * ASKED + np.arange(len(m["ids"]))}

        return run

    def answer(bodies: list[bytes]):
        held = [unpacked(b) for b in bodies]
        found: list[tuple[np.ndarray, ...]] = []

        def take(body: bytes) -> None:
            block = unpacked(body)
            for m in held:
                for key, own, query in zip(m["keys"], m["ids"], m["rows"]):
                    at, scores = top(block, query, own, k)
                    found.append((np.full(len(at), key), np.full(len(at), own), block["ids"][at], block["none"][at], scores))
            key, own, ids, none, scores = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((ids, none, -scores, key))
            nth = np.arange(len(order)) - np.searchsorted(key[order], key[order])
            found[:] = [tuple(c[order[nth < k]] for c in (key, own, ids, none, scores))]

        def give() -> pa.RecordBatch:
            key, own, ids, none, scores = found[0]
            return pa.RecordBatch.from_pydict({"key": key, "query_id": own, "vec_id": pa.array(ids, mask=none), "score": scores})

        return take, give

    used = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")
    rows = blocks(used, asked, "queries")
    found = written(met(sliced_, rows, answer, "key long, query_id long, vec_id long, score long"), "found")
    dropped(rows)
    return best(found, ["key"], [F.desc("score"), F.asc_nulls_last("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """`searched` for the rows of `vectors` where `asks` is true, against all other rows."""
    sliced_ = index(vectors, vec_id, vector, scale)
    out = searched(sliced_, vectors.where(asks), k, vec_id, vector, scale)
    dropped(sliced_)
    return out
