"""A sketch as one binary value: what reports store and runs exchange.

Twelve bytes of header, the mark and the number of filled slots, then deflated pairs of numbers, each seven bits a byte with the
lowest first: how far the slot is from the one before, and its count. Packing is an aggregate of one key's slots, of which there are
3200 at most; merging unpacks in tasks and adds up counts by slot, so that no key's sketches meet in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.sketch import LAST_SLOT, QUANTILES, merged, quantiles

MARK = b"slsketch"


def numbers_to_bytes(numbers: Sequence[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def bytes_to_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.nonzero(raw < 128)[0]
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("a packed sketch ends inside a number")
    begins = np.append(0, ends[:-1] + 1)
    shift = 7 * (np.arange(len(raw)) - np.repeat(begins, ends - begins + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, begins)


def pack(slots: Sequence[int], counts: Sequence[int]) -> bytes:
    """The filled slots of one sketch, in any order, each once."""
    slots, counts = np.asarray(slots, np.int64), np.asarray(counts, np.int64)
    filled = np.nonzero(counts)[0]
    order = filled[np.argsort(slots[filled])]
    slots, counts = slots[order], counts[order]
    if len(slots) and (slots[0] < 0 or slots[-1] > LAST_SLOT or (np.diff(slots) == 0).any() or counts.min() < 0):
        raise ValueError("slots must be distinct, from 0 to the last one, with counts above 0")
    pairs = np.stack([np.diff(slots, prepend=0), counts], axis=1).ravel().tolist()
    return struct.pack("<8sI", MARK, len(slots)) + zlib.compress(numbers_to_bytes(pairs))


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots, ascending, and their counts. Raises ValueError for anything that `pack` doesn't make."""
    if len(packed) < 12 or packed[:8] != MARK:
        raise ValueError("not a packed sketch")
    try:
        numbers = bytes_to_numbers(zlib.decompress(packed[12:]))
    except zlib.error as e:
        raise ValueError(f"not a packed sketch: {e}") from e
    if len(numbers) != 2 * struct.unpack("<I", packed[8:12])[0]:
        raise ValueError("a packed sketch has another number of slots than it says")
    slots, counts = np.cumsum(numbers[::2]), numbers[1::2]
    if len(slots) and (slots[-1] > LAST_SLOT or (numbers[2::2] < 1).any() or (counts < 1).any()):
        raise ValueError("a packed sketch has slots or counts out of range")
    return slots, counts


def packed(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sketch) of (keys, slot, c) rows; a key's slots are rows of their own, each once."""

    @F.pandas_udf("binary")
    def packed_slots(slot: pd.Series, c: pd.Series) -> bytes:
        return pack(slot.to_numpy(), c.to_numpy())

    return histograms.groupBy(*keys).agg(packed_slots("slot", "c").alias("sketch"))


def unpacked(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, slot, c) of (keys, sketch); null sketches have no rows."""
    plain = sketches.where("sketch is not null").select(*keys, "sketch")
    types = dict(plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(b.as_py()) for b in batch.column("sketch")]
            if not found:
                continue
            row = pa.array(np.repeat(np.arange(len(found)), [len(s) for s, _ in found]))
            slots, counts = (pa.array(np.concatenate(x), pa.int64()) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), slots, counts], names=[*keys, "slot", "c"])

    return plain.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", slot long, c long")


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch for each key, of all values that its sketches count."""
    return packed(merged(unpacked(sketches, keys), keys), keys)


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """(keys, one column for each quantile) of one or more sketches of a key together."""
    return quantiles(merged(unpacked(sketches, keys), keys), keys, wanted)
