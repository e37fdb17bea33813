"""Windows of texts that occur elsewhere or earlier; shared by both substring dedups.

Anchors come first (see `windows`): every window has one, and equal windows have equal grams at it. Grams that are unique
go at once, and whole contexts (all windows that an anchor stands for) that are equal settle copies: one of them stays
open, the others repeat it. What is left are contexts that differ under one gram: where copies begin, end and vary. The
stretches of text that these cover are laid out in one space of addresses and go through the rounds of `doubling`.

Anchors are range-sorted by gram, context and place, so that a gram that any number of rows hold is dealt to many tasks;
the grams at a partition's edges are settled by an aggregation and a join. Equal contexts within a slice of text travel
as one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import M3, arrow_flat, arrow_map, dropped, globally_ranked, join_hash, mix, partitions, tidy, written
from strideline.llm.doubling import UNIT, UNIT_BITS, changes, repeated, whole_groups
from strideline.llm.packed import packed_texts
from strideline.llm.windows import anchor_places, intervals, window_hashes, window_starts

#: Symbols of a text whose anchors are looked for at once; longer texts go in parts.
PART_SYMBOLS = 1 << 22

#: A document is (doc, sub), see `packed.keyed`.
_ANCHOR = [("g", "long"), ("f", "long"), ("doc", "long"), ("sub", "long"), ("lo", "int"), ("na", "int"), ("twins", "array<long>")]
_FOUND = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("f", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("lo", pa.int32()), ("na", pa.int32())])
_FOUND_SQL = "kind int, g long, f long, doc long, sub long, lo int, na int"
#: What `settled` makes of a context: it repeats, it is one of several of a gram, it can't be told within the partition.
REPEATS, VARIES, OPEN = 0, 1, 2


@dataclass(frozen=True)
class Repeats:
    """What is looked for: `symbols` gives the hashed symbols of a text; `earlier` spares the first occurrence."""

    window: int
    gram: int
    earlier: bool
    symbols: Callable[[str], np.ndarray]
    #: Symbols are bytes, which travel as they are; else their hashes do.
    raw: bool

    @property
    def first(self) -> int:
        """The length that the rounds begin with: a quarter of a window, twice doubled."""
        return -(-self.window // 4)

    # ---- anchors ----

    def anchors(self, docs: list[int], subs: list[int], texts: list[str | None]) -> list:
        """Columns of _ANCHOR for a slice: gram, context, place, and twins (doc, sub, place) with the same context."""
        step = PART_SYMBOLS
        parts = []
        for d, s, t in zip(docs, subs, texts):
            whole = self.symbols(t or "")
            parts += [(d, s, at, whole[at : at + step + self.window - 1]) for at in range(0, max(1, len(whole) - self.window + 1), step)]
        found, group, size = [], [], 0
        for k, p in enumerate(parts):
            group.append(p)
            size += len(p[3])
            if size >= step or k + 1 == len(parts):
                found.append(self._anchors(group))
                group, size = [], 0
        return found[0] if len(found) == 1 else [[v for f in found for v in f[i]] for i in range(len(_ANCHOR))]

    def _anchors(self, parts: list[tuple[int, int, int, np.ndarray]]) -> list:
        lengths = np.array([len(p[3]) for p in parts])
        base = np.concatenate([p[3] for p in parts])
        starts = window_starts(lengths, self.window)
        if not len(starts):
            return [[] for _ in _ANCHOR]
        known = window_hashes(base, [self.gram, self.window])
        gram, whole = known[self.gram], known[self.window]
        del known
        at = anchor_places(gram, starts, self.window, self.gram)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(starts)))
        low, high, at = starts[first], starts[first] + n - 1, at[first]
        na = n << 16 | (at - low)
        g = gram[at]
        f = join_hash(join_hash(whole[low], whole[high]), na.astype(np.uint64))
        text = np.searchsorted(np.cumsum(lengths), low, side="right")
        doc, sub, skip = (np.array([p[i] for p in parts], np.int64)[text] for i in range(3))
        lo = low - (np.cumsum(lengths) - lengths)[text] + skip
        order = np.lexsort((lo, sub, doc, f, g))
        g, f, doc, sub, lo, na = g[order], f[order], doc[order], sub[order], lo[order], na[order]
        lead = np.ones(len(g), bool)
        lead[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
        head = np.nonzero(lead)[0]
        size = np.diff(np.append(head, len(g)))
        twins: list = [None] * len(head)
        places = np.stack([doc, sub, lo], axis=1)
        for k in np.nonzero(size > 1)[0].tolist():
            twins[k] = places[head[k] + 1 : head[k] + size[k]].ravel()
        signed = lambda x: x[head].view(np.int64)
        return [signed(g), signed(f), doc[head], sub[head], lo[head].astype(np.int32), na[head].astype(np.int32), twins]

    def settled(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts (kind, ...) over rows sorted by (g, f, doc, sub, lo). Of grams at the partition's edges, which may go on
        elsewhere, the first context of each class stays open."""
        for part, edge in whole_groups(batches, ["g"]):
            cols = [part.column(c).to_numpy() for c in ("g", "f", "doc", "sub", "lo", "na")]
            twins = part.column("twins").combine_chunks()
            new = changes(part, ["g", "f"])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            own = np.nonzero(np.asarray(twins.is_valid()))[0]
            if len(own):  # twins as rows of their own, behind the rows that they came with
                flat = twins.flatten().to_numpy().reshape(-1, 3)
                at = np.repeat(own, np.asarray(pc.list_value_length(twins).fill_null(0))[own] // 3)
                cols = [np.concatenate([c, x]) for c, x in zip(cols, (cols[0][at], cols[1][at], flat[:, 0], flat[:, 1], flat[:, 2], cols[5][at]))]
                head = np.concatenate([head, head[at]])
            # The same place again (a repeated row) isn't another occurrence.
            other = np.zeros(len(head), bool)
            for c in cols[2:5]:
                other |= c != c[head]
            several = np.zeros(len(head), bool)
            several[head[other]] = True
            repeats = other if self.earlier else other | (several & (head == np.arange(len(head))))
            yield _found(np.full(int(repeats.sum()), REPEATS), [c[repeats] for c in cols])
            heads = np.nonzero(new)[0]
            if edge:
                yield _found(np.full(len(heads), OPEN), [c[heads] for c in cols])
            else:
                group = np.cumsum(changes(part, ["g"]))[heads]
                varies = heads[np.bincount(group)[group] > 1]
                yield _found(np.full(len(varies), VARIES), [c[varies] for c in cols])

    def told(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc, sub, lo, na) of the contexts that repeat, and of one context of each class under a gram that has several."""
        place = F.struct("doc", "sub", "lo", "na")
        rows = found.where(F.col("kind") == OPEN)
        class_ = rows.groupBy("g", "f").agg(F.min(place).alias("head"), F.max(place).alias("tail"))
        # Two grams of each partition at most.
        mixed = class_.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
        again = rows.join(class_.where("head <> tail"), ["g", "f"])
        again = again.where(F.struct("doc", "sub", "lo", "na") != F.col("head")) if self.earlier else again
        names = ["doc", "sub", "lo", "na"]
        heads = class_.join(F.broadcast(mixed), "g", "left_semi").select(*(F.col(f"head.{c}").alias(c) for c in names))
        return (
            found.where(F.col("kind") == REPEATS).select(*names).unionByName(again.select(*names)),
            found.where(F.col("kind") == VARIES).select(*names).unionByName(heads),
        )

    # ---- stretches of text that are still open, in one space of addresses ----

    def units(self, docs: list[int], subs: list[int], packed: list[bytes], reps: list[list]) -> list:
        """Rows (doc, sub, stretch, start, raw): the stretches that the contexts of each text cover, in units.

        A unit's symbols go on into the next one for as long as its own strings need. A stretch ends with as many free
        addresses as a window has, so that no string seems to go on in the next stretch.
        """
        unpack = zstandard.ZstdDecompressor()
        size, wide = UNIT, 1 if self.raw else 8
        out: list[list] = [[], [], [], [], []]
        for d, s, z, wanted in zip(docs, subs, packed, reps):
            whole = unpack.decompress(z)
            if not self.raw:
                whole = self.symbols(whole.decode()).tobytes()
            for a, b in intervals([(r["lo"], r["lo"] + (r["na"] >> 16) - 1 + self.window) for r in wanted], len(whole) // wide):
                for u in range(a, b + self.window, size):
                    row = d, s, a, u, whole[u * wide : min(u + size + self.first - 1, b) * wide] if u < b else b""
                    for column, v in zip(out, row):
                        column.append(v)
        return out

    def positions(self, units: list[int], raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(key, at) of the positions of units: hashes of their strings of the first length."""
        joined = b"".join(raws)
        base = byte_symbols(joined) if self.raw else np.frombuffer(joined, np.uint64)
        lengths = np.array([len(r) for r in raws]) // (1 if self.raw else 8)
        n = np.maximum(lengths - self.first + 1, 0)
        starts = window_starts(lengths, self.first)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.repeat((np.array(units, np.int64) << UNIT_BITS) - (np.cumsum(n) - n), n)
        return window_hashes(base, [self.first])[self.first][starts].view(np.int64), begin + np.arange(len(begin))

    def varied(self, docs: DataFrame, contexts: DataFrame) -> DataFrame:
        """(doc, sub, a, z): what repeated windows cover within `contexts`, by doubling."""
        asked = contexts.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "na")).alias("reps"))
        fields = [("doc", "long"), ("sub", "long"), ("stretch", "long"), ("start", "long"), ("raw", "binary")]
        joined = packed_texts(docs).join(asked, ["doc", "sub"]).dropDuplicates(["doc", "sub"])
        stretches = written(arrow_flat(joined, ["doc", "sub", "packed", "reps"], fields, lambda: self.units, by="packed", limit=1 << 20), "stretches")
        units = globally_ranked(stretches, ["doc", "sub", "stretch", "start"], "units", "unit")
        dropped(stretches)
        count = units.agg(F.max("unit")).first()[0]
        runs = repeated(units, 0 if count is None else count + 1, self.positions, self.first, self.window, self.earlier)
        placed = runs.join(units.select("unit", "doc", "sub", "start"), "unit")
        return placed.select("doc", "sub", (F.col("start") + F.col("x")).alias("a"), (F.col("start") + F.col("y") + self.window).alias("z"))

    # ---- the whole ----

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc, sub, spans) of (doc, sub, text): for each document with repeated windows what they cover, as (a, z) in symbols."""
        sort = ("g", "f", "doc", "sub", "lo")
        rows = written(arrow_flat(docs, ["doc", "sub", "text"], _ANCHOR, lambda: self.anchors, limit=1 << 20), "anchors")
        found = written(rows.repartitionByRange(partitions(docs.sparkSession), *sort).sortWithinPartitions(*sort).mapInArrow(tidy(self.settled), _FOUND_SQL), "contexts")
        dropped(rows)
        repeat, vary = self.told(found)
        lo, n = F.col("lo").cast("long"), F.shiftright("na", 16)
        settled = repeat.select("doc", "sub", lo.alias("a"), (lo + n - 1 + self.window).alias("z"))
        return settled.unionByName(self.varied(docs, vary)).groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def _found(kind: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([kind, *cols], _FOUND)], schema=_FOUND)


def byte_symbols(raw: bytes) -> np.ndarray:
    """The hashed symbols of bytes."""
    return _BYTES[np.frombuffer(raw, np.uint8)]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * M3)


def with_spans(docs: DataFrame, spans: DataFrame, keep: list[str], fields: list[tuple[str, str]], row: Callable[[str | None, list], tuple]) -> DataFrame:
    """The columns `keep` of every row (doc, sub, text) and `fields`, by `row(text, spans)`; the row's columns travel with its packed text."""

    def make_packed():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda texts: [[None if t is None else pack.compress(t.encode()) for t in texts]]

    def make():
        unpack = zstandard.ZstdDecompressor()

        def run(packed: list, starts: list, ends: list) -> list:
            rows = [row(None if p is None else unpack.decompress(p).decode(), list(zip(a or [], z or []))) for p, a, z in zip(packed, starts, ends)]
            return list(zip(*rows)) if rows else [[] for _ in fields]

        return run

    packed = arrow_map(docs, ["doc", "sub", *keep], ["text"], [("packed", "binary")], make_packed)
    # Arrays of numbers reach the task as lists; an array of structs would as a dictionary for each span.
    joined = packed.join(spans.select("doc", "sub", F.col("spans.a").alias("_starts"), F.col("spans.z").alias("_ends")), ["doc", "sub"], "left")
    return arrow_map(joined, keep, ["packed", "_starts", "_ends"], fields, make, by="packed", limit=1 << 20)
