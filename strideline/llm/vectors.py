"""Vectors of an Arrow column as matrices of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Integers stay below this, so that sums of products over thousands of components fit 64 bits.
LARGEST = 1 << 25


def floored(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole (not null, all components finite), and floor(scale * x) of these, rows filled up with zeros to the longest.

    Components too large for exact 64-bit sums are refused.
    """
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    whole, held = lengths >= 0, np.maximum(lengths, 0)
    x = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(n), held)
    finite = np.isfinite(x)
    whole &= np.bincount(rows[~finite], minlength=n) == 0
    out = np.zeros((n, int(held.max(initial=0))))
    out[rows, np.arange(len(x)) - np.repeat(np.cumsum(held) - held, held)] = np.floor(np.where(finite, x, 0.0) * scale)
    out = out[whole]
    if np.abs(out).max(initial=0) >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale} in magnitude")
    return whole, out.astype(np.int64)


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows filled up with zeros."""
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows
