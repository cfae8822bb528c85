"""Arrow columns of sample arrays as matrices, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lengths(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """How many samples each row has; a null array has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, undefined: float = np.nan) -> np.ndarray:
    """[row, sample] of arrays of one length; null and non-finite samples become `undefined`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return np.where(np.isfinite(out), out, undefined)


def arrays(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix; what isn't finite becomes null."""
    flat = np.ascontiguousarray(values, dtype=float).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(flat, mask=~np.isfinite(flat)))
