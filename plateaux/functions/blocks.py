"""Batches of packed features as numpy matrices, and their per-group sums in Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of sums that a task holds before it hands them on.
HELD = 64 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, null elements and null rows as NaN; every list has ``width`` elements."""
    n = len(values)
    if values.null_count:
        out = np.full((n, width), np.nan)
        own = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        if len(own):
            out[own] = matrix(values.drop_null(), width)
        return out
    flat = values.flatten()
    dense = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)  # nulls become NaN
    return dense.reshape(n, width)


def finite(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix with 0 for missing values (NaN and infinities), and where values are."""
    here = np.isfinite(x)
    return np.where(here, x, 0.0), here


def by_group(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, np.ndarray]]:
    """The values of the key in a batch, each with its rows; null is a group like others."""
    coded = column(batch, key).dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    order = np.argsort(code, kind="stable")
    present, first = np.unique(code[order], return_index=True)
    for c, rows in zip(present.tolist(), np.split(order, first[1:]), strict=True):
        yield (names[c] if c >= 0 else None), rows


class Held:
    """Sums by group that a task holds, handed on when they get too large and at the end."""

    def __init__(self, new: Callable[[], object], size: int, out: Callable[[object, object], pa.RecordBatch]):
        self.new, self.most, self.out, self.sums = new, max(1, HELD // max(1, size)), out, {}

    def of(self, group: object) -> object:
        if group not in self.sums:
            self.sums[group] = self.new()
        return self.sums[group]

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.sums) > self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for group, own in self.sums.items():
            yield self.out(group, own)
        self.sums = {}
