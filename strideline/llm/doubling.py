"""Doubling over positions: which strings of a given length occur twice, found from those of half the length.

Every position has an address, a long that sorts like (document, place). Its rank at a length is the smallest address
at which the same string of that length starts. A round deals pairs of ranks (of a position and of the one at an offset)
to tasks by the pairs' hashes; a task sorts its share, rows with equal pairs take the first one's address as their rank
at the doubled length, and rows without an equal drop out. Ranks go back to their addresses, which blocks of the space
hold, and make the next pairs there. A string that repeats has halves that repeat, so what dropped out is never needed.

Rows travel as packed arrays of many, ascending by address: a copied passage has one distance to its first place all
along, so that its ranks pack to next to nothing. Pairs that very many positions hold don't go to one task: a sample
finds them, an aggregation with map-side combining finds their first addresses, and their rows are dealt out by place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import arrow_flat, dropped, join_hash, partitions, tidy, written

#: Addresses of a unit, the least part of the space that a document gets.
UNIT_BITS = 10
UNIT = 1 << UNIT_BITS
#: Positions that a task holds before it deals them out.
FLUSH = 1 << 19
#: One position in so many is looked at to find pairs that very many hold; so many of these make one.
SAMPLE, HEAVY = 64, 1024

_ROUTED = "part int, known boolean, at binary, val binary"


def packed(x: np.ndarray) -> bytes:
    """Longs by their differences, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


@dataclass(frozen=True)
class Space:
    """The space of addresses in blocks; a task pairs the positions of one."""

    blocks: int
    size: int


@dataclass(frozen=True)
class Source:
    """Positions to be ranked: `keys` gives (key, at), ascending by at, from the columns `use` of some rows."""

    rows: DataFrame
    use: tuple[str, ...]
    keys: Callable[..., tuple[np.ndarray, np.ndarray]]


def changes(part: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a row of a sorted batch begins a group; its first row does."""
    new = np.ones(part.num_rows, bool)
    if part.num_rows:
        new[1:] = False
        for k in keys:
            v = np.asarray(part.column(k))
            new[1:] |= v[1:] != v[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 1 << 18) -> Iterator[tuple[pa.Table, bool]]:
    """Parts of a sorted stream: whole groups (False), and rows of the groups at the partition's two edges (True).

    The first group comes out in parts of any size; of another one no more than itself is held.
    """
    held: list[pa.RecordBatch] = []
    count, limit = 0, rows
    first: tuple | None = None
    leading = True  # the first group may go on
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            count += batch.num_rows
        if not count or (batch is not None and count < limit):
            continue
        part = pa.Table.from_batches(held)
        new, n = changes(part, keys), part.num_rows
        key = tuple(part.column(k)[0].as_py() for k in keys)
        first = first or key
        a = 0
        if leading and key == first:
            a = int(np.argmax(new[1:])) + 1 if new[1:].any() else n
        leading = leading and a == n
        z = max(a, n - 1 - int(np.argmax(new[::-1])))
        for x, y, edge in ((0, a, True), (a, z, False), *([(z, n, True)] if batch is None else [])):
            if x < y:
                yield part.slice(x, y - x), edge
        held, count = part.slice(z).to_batches(), n - z
        limit = max(rows, 2 * count)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a stream sorted by `key`, group after group."""
    at: int | None = None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cut = [*np.nonzero(changes(batch, [key]))[0].tolist(), batch.num_rows] if batch.num_rows else []
        for a, z in zip(cut, cut[1:]):
            k = batch.column(key)[a].as_py()
            if held and k != at:
                yield at, held
                held = []
            at = k
            held.append(batch.slice(a, z - a))
    if held:
        yield at, held


def joined(rows: list[pa.RecordBatch], column: str, read: Callable[[bytes], np.ndarray] = unpacked) -> np.ndarray:
    found = [read(b) for r in rows for b in r.column(column).to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def heavy_keys(source: Source) -> tuple[np.ndarray, np.ndarray]:
    """Keys that very many positions hold, at most four for each partition, ascending, and their first addresses."""

    keys = source.keys

    def sample(*columns: list) -> list:
        key, at = keys(*columns)
        return [key[at % SAMPLE == 0]]

    n = 4 * partitions(source.rows.sparkSession)
    seen = arrow_flat(source.rows, source.use, [("key", "long")], lambda: sample, by=None)
    top = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY).orderBy(F.col("n").desc(), "key").limit(n).collect()
    wanted = np.sort(np.array([r["key"] for r in top], np.int64))
    if not len(wanted):
        return wanted, wanted

    def least(*columns: list) -> list:
        key, at = keys(*columns)
        mine = np.isin(key, wanted)
        found, back = np.unique(key[mine], return_inverse=True)
        first = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(first, back, at[mine])
        return [found, first]

    rows = arrow_flat(source.rows, source.use, [("key", "long"), ("at", "long")], lambda: least, by=None)
    firsts = {r["key"]: r["at"] for r in rows.groupBy("key").agg(F.min("at").alias("at")).collect()}
    return wanted, np.array([firsts[k] for k in wanted.tolist()], np.int64)


def ranked(source: Source, space: Space, step: int) -> DataFrame:
    """(part, known, at, val): positions whose keys others have too with their distance from the first one, dealt to their blocks.

    Those that begin a block come into the block before too, for `step` addresses.
    """
    n = partitions(source.rows.sparkSession)
    keys, use = source.keys, source.use
    wanted, firsts = heavy_keys(source)

    def rows_of(parts: np.ndarray, at: np.ndarray, known: bool, val: np.ndarray, out: list) -> None:
        order = np.argsort(parts.astype(np.uint16) if n < 1 << 16 else parts, kind="stable")
        parts, at, val = parts[order], at[order], val[order]
        cut = [*np.nonzero(np.append(True, parts[1:] != parts[:-1]))[0].tolist(), len(parts)] if len(parts) else []
        for a, z in zip(cut, cut[1:]):
            out.append((int(parts[a]), known, packed(at[a:z]), packed(val[a:z]) if known else val[a:z].tobytes()))

    def table(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 4
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["part", "known", "at", "val"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in chain(batches, [None]):
            for k in range(0, batch.num_rows if batch is not None else 1, 256):
                if batch is not None:
                    held.append(keys(*(batch.slice(k, 256).column(c).to_pylist() for c in use)))
                    if sum(len(h[0]) for h in held) < FLUSH:
                        continue
                if not held:
                    continue
                key, at = (np.concatenate([h[i] for h in held]) for i in range(2))
                held, out = [], []
                if len(wanted):
                    place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    heavy = wanted[place] == key
                    rows_of(at[heavy] // UNIT % n, at[heavy], True, at[heavy] - firsts[place[heavy]], out)
                    key, at = key[~heavy], at[~heavy]
                part = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                rows_of(part, at, False, key, out)
                yield table(out)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "part"):
            fresh = [r.filter(pc.invert(r.column("known"))) for r in rows]
            settled = [r.filter(r.column("known")) for r in rows]
            key, at = joined(fresh, "val", lambda b: np.frombuffer(b, np.int64)), joined(fresh, "at")
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            head = np.nonzero(new)[0]
            size = np.diff(np.append(head, len(key)))
            first = np.repeat(np.minimum.reduceat(at, head) if len(head) else at, size)
            twin = np.repeat(size > 1, size)
            at, far = np.append(at[twin], joined(settled, "at")), np.append((at - first)[twin], joined(settled, "val"))
            order = np.argsort(at)
            at, far = at[order], far[order]
            out: list = []
            rows_of(at // space.size, at, True, far, out)
            ahead = (at % space.size < step) & (at >= space.size)
            rows_of(at[ahead] // space.size - 1, at[ahead], True, far[ahead], out)
            yield table(out)

    def by_part(df: DataFrame, k: int) -> DataFrame:
        return df.repartitionById(k, F.col("part")).sortWithinPartitions("part")

    plain = source.rows.select(*use)
    return by_part(by_part(plain.mapInArrow(tidy(deal), _ROUTED), n).mapInArrow(tidy(rank), _ROUTED), space.blocks)


def paired(ranks: DataFrame, space: Space, step: int) -> DataFrame:
    """(at, near, far): positions with their own rank's distance and that of the position `step` behind, where both are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in grouped(batches, "part"):
            at, far = joined(rows, "at"), joined(rows, "val")
            order = np.argsort(at)
            at, far = at[order], far[order]
            mine = np.nonzero(at // space.size == block)[0]
            found = np.searchsorted(at, at[mine] + step)
            found[found == len(at)] = 0
            both = at[found] == at[mine] + step
            mine, found = mine[both], found[both]
            for k in range(0, len(mine), FLUSH // 8):
                a, b = mine[k : k + FLUSH // 8], found[k : k + FLUSH // 8]
                yield pa.RecordBatch.from_arrays([pa.array([packed(x)], pa.binary()) for x in (at[a], far[a], far[b])], names=["at", "near", "far"])

    return ranks.mapInArrow(tidy(run), "at binary, near binary, far binary")


def hits(ranks: DataFrame, space: Space, earlier: bool) -> DataFrame:
    """(unit, x, y): neighbouring positions that repeat, within units; with `earlier`, but for the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "part"):
            at = joined(rows, "at")
            at = np.sort(at[joined(rows, "val") > 0] if earlier else at)
            new = np.append(True, (at[1:] != at[:-1] + 1) | (at[1:] >> UNIT_BITS != at[:-1] >> UNIT_BITS))[: len(at)]
            cut = np.nonzero(new)[0]
            x, y = at[cut], at[np.append(cut[1:], len(at)) - 1] if len(cut) else at
            unit = x >> UNIT_BITS
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (unit, x - (unit << UNIT_BITS), y - (unit << UNIT_BITS))], names=["unit", "x", "y"])

    return ranks.mapInArrow(tidy(run), "unit long, x long, y long")


def pair_keys(ats: list[bytes], nears: list[bytes], fars: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pairs of ranks. The second rank's distance is from its own position."""
    if not ats:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, near, far = (np.concatenate([unpacked(b) for b in x]) for x in (ats, nears, fars))
    # The offset is one for all, so that at - far stands for the second rank.
    return join_hash((at - near).view(np.uint64), (at - far).view(np.uint64)).view(np.int64), at


def repeated(units: DataFrame, count: int, keys: Callable[..., tuple[np.ndarray, np.ndarray]], length: int, window: int, earlier: bool) -> DataFrame:
    """(unit, x, y) of positions whose strings of `window` repeat, by rounds from `length` on.

    `keys` gives the hashes of strings of `length` from rows (unit, raw) of the `count` units.
    """
    n = partitions(units.sparkSession)
    # A block is no smaller than a window, so that what a position is paired with lies in the next block at most.
    space = Space(n, max(-(-window // UNIT), -(-count // n)) * UNIT)
    source, before = Source(units, ("unit", "raw"), keys), None
    while length < window:
        step = min(length, window - length)
        pairs = written(paired(ranked(source, space, step), space, step), "pairs")
        if before is not None:
            dropped(before)
        source, before, length = Source(pairs, ("at", "near", "far"), pair_keys), pairs, length + step
        if not pairs.limit(1).count():
            break
    return hits(ranked(source, space, 0), space, earlier)
