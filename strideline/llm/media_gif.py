"""Media columns: GIF.

`encode` stores bytes losslessly as 8-bit grey samples of an animated GIF; `decode` reads any GIF: LZW code streams,
global and local palettes, interlacing, transparency and the disposal rules, composed into timed RGB frames.
A dictionary of GIF's LZW is a set of back references into the decoded output, so a segment between two clear codes is
decoded with array operations: code widths follow from a code's place, string lengths from chains of entries, and
sample values by pointer doubling.

Defined cases: a null or empty text is stored as one block of 64 zero bytes; equal texts have equal values; a broken
stream raises ValueError in `decode`, and `frame_columns` reports it as a row with `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import arrow_flat, arrow_map

#: Samples in a row and rows in a frame of stored payloads; hundredths of a second that a frame stands.
WIDTH, ROWS, DELAY_CS = 64, 256, 4
#: Fixed values of the format: clear and end codes and the first free entry for 8-bit samples, the last entry's end.
CLEAR, END, FREE, FULL = 256, 257, 258, 4096
#: Fixed values of the format: a frame stays on the screen, or what was there before it comes back.
KEEP, RESTORE = 1, 3
#: Codes between two clear codes when the dictionary is full.
SEGMENT = FULL - FREE


_FRAME = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))])


class Frame(NamedTuple):
    delay_cs: int
    left: int
    top: int
    samples: np.ndarray  # palette indexes of the frame's own rectangle
    canvas: np.ndarray  # RGB of the whole screen once the frame is drawn


@lru_cache(maxsize=64)
def _widths(n: int, bits: int = 8) -> np.ndarray:
    """Bits of the codes 0..n-1 after a clear code."""
    free = (1 << bits) + 1 + np.arange(n)  # next free entry when code k is read is this, but for k = 0
    free[:1] = 0
    return np.clip(np.floor(np.log2(np.maximum(free, 1))).astype(np.int64) + 1, bits + 1, 12)


_W8 = _widths(SEGMENT + 1)


#: The low bits of a 16-bit number that a code of so many bits uses.
_USED = np.arange(16) < np.arange(13)[:, None]


def lzw_codes(data: bytes) -> list[list[int]]:
    """Greedy LZW codes of 8-bit samples, one list for each segment between clear codes."""
    out, codes, table, free = [], [], {}, FREE
    word = data[0]
    for byte in data[1:]:
        key = word << 8 | byte
        code = table.get(key)
        if code is not None:
            word = code
            continue
        codes.append(word)
        word = byte
        if free == FULL - 1:
            out.append(codes)
            codes, table, free = [], {}, FREE
        else:
            table[key] = free
            free += 1
    codes.append(word)
    out.append(codes)
    return out


def lzw_pack(segments: list[list[int]]) -> bytes:
    """The bit stream, low bits first: each segment follows a clear code, the last ends with the end code."""
    values, widths = [np.array([CLEAR])], [np.array([9])]
    for i, codes in enumerate(segments):
        values.append(np.array([*codes, END if i == len(segments) - 1 else CLEAR]))
        widths.append(_W8[: len(codes) + 1])
    v, w = np.concatenate(values).astype("<u2"), np.concatenate(widths)
    planes = np.unpackbits(v.view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(planes[_USED[w]], bitorder="little").tobytes()


def frames_of(payload: bytes) -> Iterator[tuple[bytes, int, int | None]]:
    """(samples, disposal, transparent index) of each frame of a payload.

    A frame most of whose samples stand on the screen already leaves these transparent, if some sample value is free to mean
    that. The screen is what the frame before left, or, where more of it is the next frame's, what was there before that one.
    """
    area = WIDTH * ROWS
    grids = [np.frombuffer(payload[a : a + area], np.uint8) for a in range(0, len(payload), area)]
    before = np.zeros(min(len(payload), area), np.uint8)
    for k, grid in enumerate(grids):
        same, samples, clear = before[: len(grid)] == grid, grid, None
        free = np.nonzero(np.bincount(grid, minlength=256) == 0)[0]
        if k and 2 * same.sum() > len(grid) and len(free):
            clear = int(free[0])
            samples = np.where(same, np.uint8(clear), grid)
        after = before.copy()
        after[: len(grid)] = grid
        disposal = KEEP
        if k + 1 < len(grids):
            following = grids[k + 1]
            kept, restored = (int((x[: len(following)] == following).sum()) for x in (after, before))
            disposal = RESTORE if restored > kept and 2 * restored > len(following) else KEEP
        yield samples.tobytes(), disposal, clear
        before = after if disposal == KEEP else before


def encode(payload: bytes) -> bytes:
    """An animated GIF whose grey screens, frame after frame, are the payload: a positive multiple of WIDTH bytes."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of the row width")
    rows = len(payload) // WIDTH
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), grey]
    for data, disposal, clear in frames_of(payload):
        stream = lzw_pack(lzw_codes(data))
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), DELAY_CS, clear or 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(data) // WIDTH, 0) + b"\x08")
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            parts.append(bytes([len(block)]) + block)
        parts.append(b"\0")
    parts.append(b"\x3b")
    return b"".join(parts)


def _segment(codes: np.ndarray, first: int) -> np.ndarray:
    """Samples of the codes between two clear codes; `first` is the first free entry."""
    n = len(codes)
    entry = codes - first
    ref = codes >= first
    own = np.arange(n)
    if n and (ref[0] or (entry >= own).any()):
        raise ValueError("an LZW code refers to an entry that isn't there yet")
    parent = np.where(ref, entry, own)
    size = ref.astype(np.int64)
    jump = parent
    while True:
        far = jump[jump]
        if (far == jump).all():
            break
        size = size + size[jump]
        jump = far
    size += 1
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if n else 0
    source = np.repeat(np.where(ref, start[parent], start) - start, size) + np.arange(total)
    while True:
        far = source[source]
        if (far == source).all():
            break
        source = far
    base = np.zeros(total, np.uint8)
    base[start[~ref]] = codes[~ref]
    return base[source]


def lzw_decode(stream: bytes, bits: int, count: int) -> np.ndarray:
    """`count` samples of a code stream whose smallest code size is `bits`."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    at, limit, out, have = 0, len(stream) * 8, [], 0
    chunk, offset = SEGMENT + 2, None
    while have < count:
        if offset is None or len(offset) < chunk:
            width = _widths(chunk, bits)
            offset = np.cumsum(width) - width
        n = int(np.searchsorted(offset + width, limit - at, side="right"))
        n = min(n, chunk)
        if n <= 0:
            break
        place = at + offset[:n]
        byte = place >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (place & 7)) & ((1 << width[:n]) - 1)
        stop = np.nonzero((codes == clear) | (codes == end))[0]
        if not len(stop) and n == chunk:
            chunk *= 2  # a clear code that is put off: the dictionary stays full and codes stay at 12 bits
            continue
        m = int(stop[0]) if len(stop) else n
        if m:
            out.append(_segment(codes[:m], first))
            have += len(out[-1])
        if not len(stop) or codes[m] == end:
            break
        at += int(offset[m] + width[m])
    got = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(got) < count:
        raise ValueError(f"the code stream has {len(got)} samples, not {count}")
    return got[:count]


def decode(media: bytes) -> list[Frame]:
    """All frames of a GIF at once."""
    return list(drawn(media))


def drawn(media: bytes) -> Iterator[Frame]:
    """Frames of a GIF one by one, drawn by its palettes, transparency and disposal rules; ValueError where it is broken."""
    try:
        yield from _drawn(media)
    except (IndexError, struct.error) as e:
        raise ValueError(f"the file is cut off or broken: {e}") from e


def _drawn(media: bytes) -> Iterator[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    wide, high, flags, back, _ = struct.unpack("<HHBBB", media[6:13])
    at, shared = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        shared = np.frombuffer(media, np.uint8, size * 3, at).reshape(-1, 3)
        at += size * 3
    blank = shared[back] if shared is not None and back < len(shared) else np.zeros(3, np.uint8)
    screen = np.empty((high, wide, 3), np.uint8)
    screen[:] = blank
    delay, clear_index, disposal = 0, None, 0
    while True:
        if at >= len(media):
            raise ValueError("the file ends without its trailer")
        kind = media[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label, at = media[at + 1], at + 2
            body, at = _blocks(media, at)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack("<HHHHB", media[at + 1 : at + 10])
            at += 10
            palette = shared
            if packed & 0x80:
                size = 2 << (packed & 7)
                palette = np.frombuffer(media, np.uint8, size * 3, at).reshape(-1, 3)
                at += size * 3
            if palette is None:
                raise ValueError("a frame has no palette")
            bits = media[at]
            body, at = _blocks(media, at + 1)
            samples = lzw_decode(body, bits, w * h).reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(samples)
                straight[rows] = samples
                samples = straight
            before = screen.copy() if disposal == 3 else None
            area = screen[top : top + h, left : left + w]
            inside = samples[: area.shape[0], : area.shape[1]]
            if inside.size and int(inside.max()) >= len(palette):
                full = np.zeros((256, 3), np.uint8)
                full[: len(palette)] = palette
                palette = full
            if clear_index is None:
                area[:] = palette[inside]
            else:
                shown = inside != clear_index
                area[shown] = palette[inside[shown]]
            yield Frame(delay, left, top, samples, screen.copy())
            if disposal == 2:
                area[:] = blank
            elif disposal == 3:
                screen = before
            delay, clear_index, disposal = 0, None, 0
        else:
            raise ValueError(f"unknown block {kind:#x}")


def _blocks(media: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := media[at] if at < len(media) else 0) or at < len(media):
        if not n:
            return b"".join(parts), at + 1
        parts.append(media[at + 1 : at + 1 + n])
        at += 1 + n
    raise ValueError("a block has no end")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colour bins: the two high bits of red, green and blue."""
    top = canvas.reshape(-1, 3) >> 6
    return np.bincount(top[:, 0] << 4 | top[:, 1] << 2 | top[:, 2], minlength=64)


def timed(media: bytes) -> Iterator[tuple[tuple, Frame]]:
    """Each frame with what is stored of it: (frame, start_ms, delay_ms, left, top, width, height, histogram)."""
    clock = 0
    for i, f in enumerate(drawn(media)):
        h, w = f.samples.shape
        yield (i, 10 * clock, 10 * f.delay_cs, f.left, f.top, w, h, histogram(f.canvas)), f
        clock += f.delay_cs


def stored_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Each text as a GIF and the digest of what is read back from it; with `media`, the stored file too.

    The feature holds the number of frames, their time, and the colour histogram of all of them, bins that aren't empty;
    `frames` holds each frame's begin and time and its own histogram. Both come from the file that is read back.
    """

    def row(text: str | None) -> tuple:
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))
        stored = encode(payload)
        bins, ms, parts, frames = np.zeros(64, np.int64), 0, [], []
        for (_, start, delay, *_, colours), f in timed(stored):
            bins, ms = bins + colours, start + delay
            frames.append({"start_ms": start, "delay_ms": delay, "histogram": colours})
            parts.append(f.canvas[: f.samples.shape[0], :, 0].tobytes())
        back = b"".join(parts)
        hist = "-".join(f"{i}:{bins[i]}" for i in np.nonzero(bins)[0])
        digest = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]))
        return *digest, len(stored), hashlib.sha256(stored).hexdigest(), f"frames={len(frames)};ms={ms};hist={hist}", frames, stored

    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long")]
    fields += [("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("frames", "array<struct<start_ms:bigint,delay_ms:bigint,histogram:array<bigint>>>"), ("media", "binary")]
    fields = fields if media else fields[:-1]

    def make():
        def run(texts: list) -> list:
            columns = [list(c) for c in zip(*map(row, texts))] or [[] for _ in fields]
            at = [n for n, _ in fields].index("frames")
            columns[at] = pa.array(columns[at], pa.list_(_FRAME))
            return columns[: len(fields)]

        return run

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(plain, ["doc_id"], ["text"], fields, make)


def frame_columns(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each frame of each stored GIF: its time, place, size and colour histogram; a broken file has one row with `error`."""

    def make():
        def run(keys: list, files: list) -> list:
            rows = []
            for k, data in zip(keys, files):
                try:
                    own = [(k, *place, colours.tolist(), None) for (*place, colours), _ in timed(data or b"")]
                except ValueError as e:
                    own = [(k, None, None, None, None, None, None, None, None, str(e))]
                rows += own
            return list(zip(*rows)) if rows else [[]]

        return run

    names = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height"]
    fields = [("doc_id", "long"), *((n, "long") for n in names), ("histogram", "array<long>"), ("error", "string")]
    plain = media.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("media"))
    return arrow_flat(plain, ["doc_id", "media"], fields, make, by="media")
