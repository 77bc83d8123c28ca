"""Text columns of Arrow batches as byte arrays, and hashes over them, for functions that run inside tasks.

A batch is walked in slices of about a megabyte, so that temporary arrays stay small whatever the
length of the texts.
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

SLICE_BYTES = 1 << 20
U8 = np.uint64
_MIX1, _MIX2 = U8(0xFF51AFD7ED558CCD), U8(0xC4CEB9FE1A85EC53)
_rng = np.random.Generator(np.random.PCG64(20240117))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U8(2) + U8(1)
_BASE = (int(_rng.integers(1, 1 << 60)) * 8 + 5) % (1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit values."""
    x = (x ^ (x >> U8(33))) * _MIX1
    x = (x ^ (x >> U8(29))) * _MIX2
    return x ^ (x >> U8(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 21)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, U8(base), np.uint64))])
                for base in (_BASE, inverse)
            )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], times the inverse base to the power i, a hash of the bytes i to j."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each range of bytes."""
    _, down = POWERS.get(len(h) + 1)
    return mix((h[end] - h[start]) * down[start] ^ (end - start).astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and len + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `budget` bytes; a longer text is a slice of its own."""
    sizes = np.diff(column_bytes(batch.column(column))[1])
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + budget, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned values, byte by byte, so that a shuffle's compression meets like with like."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes | memoryview, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, count * width).reshape(width, count).T
    return out.reshape(-1).view("<u8")


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(sorted_values)))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)


def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns of one length, each less its minimum and in as few byte planes as it needs."""
    parts = [np.array([len(columns[0])], "<i8").tobytes()]
    for values in columns:
        values = values.astype(np.int64, copy=False)
        least = int(values.min()) if len(values) else 0
        rest = values.view(np.uint64) - np.int64(least).astype(np.uint64)
        width = (int(rest.max()).bit_length() + 7) // 8 if len(rest) else 0
        parts += [np.array([least, width], "<i8").tobytes(), planes(rest, width)]
    return b"".join(parts)


def unpack(raw: bytes | memoryview) -> list[np.ndarray]:
    """The columns given to `pack`, as signed 64-bit values."""
    raw = memoryview(raw)
    (count,), at, out = np.frombuffer(raw, "<i8", 1), 8, []
    while at < len(raw):
        least, width = np.frombuffer(raw, "<i8", 2, at)
        at += 16
        rest = from_planes(raw[at : at + count * width], count, width)
        out.append((rest + least.astype(np.uint64)).view(np.int64))
        at += count * int(width)
    return out


def unpack_all(blobs: pa.ChunkedArray | pa.Array, n_columns: int) -> list[np.ndarray]:
    got = [unpack(b.as_buffer()) for b in blobs if b.is_valid]
    if not got:
        return [np.zeros(0, np.int64)] * n_columns
    return [np.concatenate(c) for c in zip(*got, strict=True)]


def by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, columns) for each part; the order inside a part stays."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    starts, lengths = runs_of(ordered)
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        take = order[s : s + n]
        yield int(ordered[s]), [c[take] for c in columns]


@lru_cache(maxsize=1)
def _trim() -> Callable:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # a C library without it
        return lambda _: 0


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker lives on for other tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy_map(f: Callable) -> Callable:
    """A function from batches to batches that gives memory back at its end."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def tidy_group(f: Callable) -> Callable:
    """The same for a function from the table of a group to a table."""

    @wraps(f)
    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            give_back()

    return run
