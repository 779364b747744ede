"""Rows of an Arrow batch in slices of few bytes, so that what a function makes of a batch is never held as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the first column's values in a slice, unless one row alone has more.
SLICE = 1 << 20


def slices(batches: Iterator[tuple[pa.Array, ...]], most: int = SLICE) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of all batches in order, cut where the first column, of binary values, or of lists of these, would go beyond `most` bytes. An empty batch stays one."""
    for columns in batches:
        first = columns[0]
        at = first.offsets if pa.types.is_list(first.type) else None
        ends = _ends(first) if at is None else _ends(first.values)[at.to_numpy()]
        n, start = len(first), 0
        if not n:
            yield columns
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield tuple(c.slice(start, min(stop, n) - start) for c in columns)
            start = stop


def _ends(values: pa.BinaryArray) -> np.ndarray:
    """Offsets of binary values, one more than there are."""
    wide = pa.types.is_large_binary(values.type)
    return np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32, len(values) + 1, values.offset * (8 if wide else 4)).astype(np.int64) if len(values) else np.zeros(1, np.int64)


def bodies(values: pa.BinaryArray) -> Iterator[bytes | None]:
    """Each value as bytes, one at a time."""
    return (v.as_py() for v in values)
