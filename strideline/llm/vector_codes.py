"""Vector code compression: product codes whose codebooks are trained by Lloyd rounds under Hamerly's bounds.

Components become integers floor(scale * x); a vector is cut into `parts` equal parts, each with a codebook of its own that
starts as the parts of the smallest ids. A round assigns every part to its nearest entry and replaces each entry by the
floor of its parts' mean. Each part keeps, in the written table of a round, an upper bound of the distance to its entry and
a lower bound of that to any other. When entries move, the bounds widen by as much; while the upper one is strictly below
the lower (or below half the way from the entry to its nearest neighbour), the entry is the nearest and no other is as
near, so nothing is computed. Else the upper bound is made exact, and if that isn't enough, all entries are scanned with
exact integers, where the lower index wins a tie. Bounds are rounded outward.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped. Shorter vectors count as filled
up with zeros, to the longest one's length made a multiple of `parts`. Repeated ids are rows of their own, ordered by
vector; null ids come last. With fewer rows than entries the codebook has an entry for each row. Components beyond
2**25 / scale in magnitude are refused. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import dropped, partitions, tidy, written
from strideline.llm.vectors import floored, widened

#: Rows whose distances are computed at once.
AT_ONCE = 4096

#: Sums of squares below this are exact in doubles.
EXACT = 1 << 53


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * reach * reach * x.shape[1] < EXACT:  # every sum below is a whole number that doubles hold, whatever the order
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def own_distances(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - entries[code]) ** 2).sum(axis=1)


def above(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf)


def below(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared.astype(np.float64)), -np.inf), 0)


class Motion:
    """How far a codebook's entries moved, and half the way of each entry to its nearest neighbour."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        self.far = above(((now - before) ** 2).sum(axis=1))
        order = np.argsort(-self.far, kind="stable")
        self.most = np.full(len(now), self.far[order[0]])  # by any other entry
        self.most[order[0]] = self.far[order[1]] if len(now) > 1 else 0
        if len(now) > 1:
            apart = distances(now, now)
            np.fill_diagonal(apart, np.iinfo(np.int64).max)
            self.half = np.nextafter(below(apart.min(axis=1)) / 2, 0)
        else:
            self.half = np.full(1, np.inf)


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower index on ties, and both bounds."""
    code, upper, lower = (np.zeros(len(x), t) for t in (np.int64, float, float))
    for a in range(0, len(x), AT_ONCE):
        d = distances(x[a : a + AT_ONCE], entries)
        rows = np.arange(len(d))
        best = d.argmin(axis=1)
        code[a : a + AT_ONCE], upper[a : a + AT_ONCE] = best, above(d[rows, best])
        d[rows, best] = np.iinfo(np.int64).max
        lower[a : a + AT_ONCE] = below(d.min(axis=1)) if len(entries) > 1 else np.inf
    return code, upper, lower


def reassigned(x: np.ndarray, entries: np.ndarray, motion: Motion, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after entries moved, and how many rows had to be scanned."""
    upper = np.nextafter(upper + motion.far[code], np.inf)
    lower = np.maximum(np.nextafter(lower - motion.most[code], -np.inf), 0)
    code, limit = code.copy(), np.maximum(lower, motion.half[code])
    loose = np.nonzero(upper >= limit)[0]
    upper[loose] = above(own_distances(x[loose], entries, code[loose]))
    loose = loose[upper[loose] >= limit[loose]]
    code[loose], upper[loose], lower[loose] = scanned(x[loose], entries)
    return code, upper, lower, len(loose)


def cut(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(rows, parts, axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of integer arrays, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def integers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v) of the whole vectors."""
    used = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            whole, x = floored(column, scale)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[whole]
            values = x[np.arange(x.shape[1])[None, :] < lengths[:, None]].astype(np.int32)
            rows = batch.filter(pa.array(whole))
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), v], names=["id", "label", "v"])

    return used.mapInArrow(tidy(run), f"id long, label {dict(used.dtypes)['label']}, v array<int>")


_STATE = "id long, label {}, v array<int>, code binary, upper array<double>, lower array<double>, error long"


def assigned(state: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """`state` with every part at its nearest entry of `books`; its codes and bounds are those for `before`, if given."""
    parts, width = len(books), sum(b.shape[1] for b in books)
    motions = [Motion(a, b) for a, b in zip(before, books)] if before else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = cut(matrix(batch.column("v"), width), parts), batch.num_rows
            if motions:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                upper, lower = (batch.column(c).flatten().to_numpy().reshape(n, parts) for c in ("upper", "lower"))
                found = [reassigned(x[p], books[p], motions[p], code[:, p], upper[:, p], lower[:, p])[:3] for p in range(parts)]
            else:
                found = [scanned(x[p], books[p]) for p in range(parts)]
            error = sum(own_distances(x[p], books[p], found[p][0]) for p in range(parts))
            codes, upper, lower = (np.stack(c, axis=1) for c in zip(*found))
            ends = pa.array(np.arange(n + 1) * parts, pa.int32())
            bounds = [pa.ListArray.from_arrays(ends, pa.array(b.ravel())) for b in (upper, lower)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "label", "v")), pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), *bounds, pa.array(error, pa.int64())],
                names=["id", "label", "v", "code", "upper", "lower", "error"],
            )

    return state.mapInArrow(tidy(run), _STATE.format(dict(state.dtypes)["label"]))


def sums(state: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part position, how many parts each entry has, and their sum. Tasks add up what they read, Spark adds up tasks."""
    parts, width = len(books), sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = cut(matrix(batch.column("v"), width), parts)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=len(counts[p]))
                np.add.at(totals[p], code[:, p], x[p])
        for p in range(parts):
            held = np.nonzero(counts[p])[0]
            if len(held):
                rows = np.concatenate([counts[p][held, None], totals[p][held]], axis=1).tolist()
                yield pa.RecordBatch.from_pydict({"part": pa.array([p] * len(held), pa.int32()), "entry": pa.array(held, pa.int32()), "sums": pa.array(rows, pa.list_(pa.int64()))})

    of_tasks = state.select("v", "code").mapInArrow(tidy(run), "part int, entry int, sums array<long>").select("part", "entry", F.posexplode("sums").alias("at", "x"))
    out = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
    for r in of_tasks.groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect():  # as many as the codebooks have numbers
        counts, totals = out[r["part"]]
        if r["at"]:
            totals[r["entry"], r["at"] - 1] = r["x"]
        else:
            counts[r["entry"]] = r["x"]
    return out


def moved(book: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.where(counts[:, None] > 0, totals // np.maximum(counts, 1)[:, None], book)


def trained(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """The written table (id, label, v, code, upper, lower, error) after `rounds` rounds and a last assignment, and the codebooks."""
    if entries > 256:
        raise ValueError("a code is one byte")
    state = written(integers(vectors, vec_id, vector, label, scale), "integers")
    longest = state.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    seeds = [r["v"] for r in state.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]  # at most `entries`
    books = cut(np.array([[*v, *[0] * (width - len(v))] for v in seeds], np.int64).reshape(len(seeds), width), parts)
    if not seeds:
        return state.select("*", F.lit(b"").alias("code"), *(F.array().cast("array<double>").alias(c) for c in ("upper", "lower")), F.lit(0).cast("long").alias("error")), books
    before = None
    for r in range(rounds + 1):
        now = written(assigned(state, books, before), f"codes-{r}")
        dropped(state)
        state = now
        if r < rounds:
            before, books = books, [moved(b, *s) for b, s in zip(books, sums(state, books))]
    return state, books


def label_errors(rows: DataFrame) -> DataFrame:
    """`rows` with label_error. Labels that hold more than a partition's share of rows are as few as partitions, so theirs are broadcast; the rest is joined."""
    n = partitions(rows.sparkSession)
    own = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("held")), "labels")
    share = (own.agg(F.sum("held")).first()[0] or 0) / n
    many = F.broadcast(own.where(F.col("held") > share).select(F.col("label").alias("name"), "label_error"))
    few = own.where(F.col("held") <= share).select(F.col("label").alias("name"), "label_error")
    same = F.col("label").eqNullSafe(F.col("name"))
    common = rows.join(many, same)
    rare = rows.join(many, same, "left_anti").join(few, same)
    return common.unionByName(rare).drop("name")


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector; `how` goes to `trained`."""
    state, books = trained(vectors, vec_id, vector, label, **how)
    numbers = ",".join(str(x) for b in books for x in b.ravel().tolist())
    rows = state.select(F.col("id").alias("vec_id"), "label", F.lower(F.hex("code")).alias("code"), "error")
    digest = F.lit(hashlib.sha256(numbers.encode()).hexdigest())
    return label_errors(rows).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
