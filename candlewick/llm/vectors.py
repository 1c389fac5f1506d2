"""Vectors of an Arrow batch as numpy matrices, one for each length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(batch: pa.RecordBatch, column: str, limit: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of float64) for each length of vectors in a batch.

    ``column`` is a list of float64. Vectors that are null or empty, or hold an entry that is null,
    non-finite or at least ``limit`` in size, are left out.
    """
    lists = batch.column(column).cast(pa.large_list(pa.float64()))
    ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    flat = lists.values.slice(ends[0], ends[-1] - ends[0]) if len(lists) else lists.values
    entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    bad = np.zeros(len(entries) + 1, np.int64)
    np.cumsum(~(np.abs(entries) < limit), out=bad[1:])
    size = np.diff(ends)
    whole = (bad[ends[1:]] == bad[ends[:-1]]) & (size > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(size[whole]):
        at = np.flatnonzero(whole & (size == dim))
        yield at, entries[ends[at][:, None] + np.arange(dim)[None, :]]
