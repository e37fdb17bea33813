"""Windows of hashed symbols over many texts at once: doubling hashes and content-defined anchors.

Symbols (words or bytes) of a slice of texts stand in one flat array. A window's hash is made from those of its two
halves, so lengths double. Every window has an anchor: the leftmost smallest gram in it, which equal windows have at the
same place, so windows need to be compared only where their anchors' grams are equal.
"""

from __future__ import annotations

import numpy as np

from strideline.llm.common import HASH_BLOCK, M1, join_into

#: Low bits of a sort key that hold a place; the rest hold a gram's hash, where a tie only moves the anchor leftward.
PLACE_BITS = 28
#: More intervals than this are merged as arrays.
MANY = 64


def window_hashes(base: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of each length in the flat array, by doubling; the last step to a length may overlap.

    The array goes in blocks through all lengths, each with as many symbols of the next as its windows need.
    """
    steps, sizes = [], [1]  # (from, to)
    for want in sorted(lengths):
        size = max(k for k in sizes if k <= want)
        while size < want:
            step = min(size, want - size)
            steps.append((size, size + step))
            size += step
            sizes.append(size)
    out = {k: np.empty(max(0, len(base) - k + 1), np.uint64) for k in lengths}
    most = max(sizes)
    spare = np.empty(HASH_BLOCK + most, np.uint64)
    held = {k: np.empty(HASH_BLOCK + most, np.uint64) for k in sizes[1:]}
    for at in range(0, len(base), HASH_BLOCK):
        known = {1: base[at : at + HASH_BLOCK + most - 1]}
        for size, longer in steps:
            h, step = known[size], longer - size
            n = max(0, len(h) - step)
            known[longer] = held[longer][:n]
            if n:
                join_into(h[:-step], h[step:], known[longer], spare[:n])
        for k, hashes in out.items():
            part = known[k][: HASH_BLOCK]
            hashes[at : at + len(part)] = part
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if size < width else m


def window_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """Places of the flat array where a window starts that stays inside its text."""
    n = np.maximum(lengths - window + 1, 0)
    first = np.cumsum(lengths) - lengths
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def anchor_places(grams: np.ndarray, starts: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of the window at each of `starts`."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    if len(grams) > int(mask):
        raise ValueError("a slice of texts is longer than places can tell")
    key = grams * M1  # grams are hashes already; another order than theirs
    key &= ~mask
    key |= np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(key, window - gram + 1)[starts] & mask).astype(np.int64)


def intervals(found: list, n: int) -> list[tuple[int, int]]:
    """Merged (from, to) out of any (from, to) within 0..n, neighbours joined."""
    if len(found) > MANY:
        a, b = np.array(found, np.int64).reshape(-1, 2).clip(0, n).T
        a, b = a[a < b], b[a < b]
        order = np.argsort(a)
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.append(True, a[1:] > b[:-1])[: len(a)]
        last = np.append(new[1:], True)[: len(a)]
        return list(zip(a[new].tolist(), b[last].tolist()))
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in found):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
