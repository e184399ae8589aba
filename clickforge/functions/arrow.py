"""Conversions between Arrow list columns and numpy matrices, used inside Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def to_matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """A list column whose lists all have ``dim`` numbers, as an (n, dim) matrix.

    A null list or one of another length ends the job: ``flatten`` would leave it out and shift the rows behind it.
    """
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if (sizes != dim).any():
        raise ValueError(f"{(sizes != dim).sum()} of {len(sizes)} vectors are null or have not {dim} elements")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=dtype).reshape(len(column), dim)


def to_cube(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """A list-of-vectors column with equally many vectors per row, as an (n, fields, dim) array.

    A null vector, as a lookup gives for an unknown id, counts as zeros. A null list, lists of different lengths, or a
    vector that has not ``dim`` elements end the job: nothing may slip into another row.
    """
    fields = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if not len(column):
        return np.zeros((0, 0, dim), dtype)
    if fields.min() != fields.max() or fields[0] < 0:
        raise ValueError(f"rows have no list or between {max(fields.min(), 0)} and {fields.max()} vectors")
    vectors = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(vectors), dim).to_numpy(zero_copy_only=False)
    if (sizes != dim).any():
        raise ValueError(f"{(sizes != dim).sum()} of {len(sizes)} vectors have not {dim} elements")
    cube = np.zeros((len(vectors), dim), dtype)
    cube[vectors.is_valid().to_numpy(zero_copy_only=False)] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return cube.reshape(len(column), int(fields[0]), dim)


def from_matrix(matrix: np.ndarray, kind: pa.DataType | None = None, missing: np.ndarray | None = None) -> pa.Array:
    """An (n, dim) matrix as a list column; rows marked ``missing`` become null."""
    kind = kind or pa.float64()
    n, dim = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()).cast(kind),
                                    mask=None if missing is None else pa.array(missing))
