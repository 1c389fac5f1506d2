"""Whole texts as numpy arrays, a bounded block of an Arrow batch at a time.

Arrow keeps the texts of a batch as one run of UTF-8 bytes, so words, lines and
hashes of thousands of documents come out of a few vector operations instead of
a Python loop over words. White space is ``[\\x20\\x09-\\x0D]``; a text that is
null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n, kept between blocks."""
    if len(_cache.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        _cache["up"], _cache["down"] = _powers(_BASE, size), _powers(_inverse(_BASE), size)
    return _cache["up"][:n], _cache["down"][:n]


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span codes[start:end], by differences of one running sum."""
    up, down = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=run[1:])
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` text bytes each, one row at least."""
    lengths = batch.column(column).cast(pa.large_string())
    size = np.diff(_offsets(lengths))
    at, n = 0, batch.num_rows
    ends = np.cumsum(size)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(strings: pa.Array) -> np.ndarray:
    raw = np.frombuffer(strings.buffers()[1], np.int64)
    return raw[strings.offset : strings.offset + len(strings) + 1]


class Texts:
    """The texts of a block: ``data`` (uint8) and ``bounds`` (n + 1 offsets into it)."""

    def __init__(self, column: pa.Array):
        strings = column.cast(pa.large_string()).fill_null("")
        off = _offsets(strings)
        raw = strings.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[off[0] : off[-1]]
        self.bounds = off - off[0]
        self.n = len(strings)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.bounds, at, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        inside = ~SPACE[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        first = self.bounds[:-1][self.bounds[:-1] < len(inside)]
        before[first] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        last = self.bounds[1:] - 1
        after[last[last >= 0]] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, self.doc_of(start)


def count_by(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)
