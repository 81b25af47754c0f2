"""Embedding columns as float64 blocks inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(mask, vectors): a vector is usable if it and all its components are there and finite, and it has any."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    out: list[np.ndarray | None] = []
    for n, e in zip(lengths.tolist(), ends.tolist(), strict=True):
        v = values[e - n : e]
        out.append(v if n and np.isfinite(v).all() else None)
    return np.array([v is not None for v in out], bool), out


def block(col) -> np.ndarray:
    """Rows of float64 bytes of one length as a matrix."""
    got = col.to_pylist()
    return np.frombuffer(b"".join(got), np.float64).reshape(len(got), -1)
