"""Helpers on Arrow lists and numpy segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def segments(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values and the lengths of a list column; a null list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def blobs(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The flat values, of a numpy kind, of a binary column without nulls, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat.view(kind), np.diff(at) // np.dtype(kind).itemsize


def to_blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column: the bytes of values, cut into rows of so many bytes."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(starts_of(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts_of(lengths).astype(np.int32)), pa.array(values, type=kind))


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), vectorised."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the segments that begin at start[:-1], modulo 2**64; 0 for an empty segment."""
    out = np.zeros(len(start) - 1, dtype=np.uint64)
    some = np.diff(start) > 0
    if some.any():
        out[some] = np.add.reduceat(values.view(np.uint64), start[:-1][some])
    return out
