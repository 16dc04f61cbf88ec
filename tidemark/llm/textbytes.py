"""Arrow text columns as NumPy byte buffers, in bounded blocks.

A block holds whole texts up to ``BLOCK_BYTES``; only a longer single text is cut,
and then at a white-space byte, so that no word is ever split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and their n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int | None = None, cut: bool = True, gap: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets of the block's texts from 0, bytes) of consecutive blocks.

    A text over ``limit`` (default ``BLOCK_BYTES``) bytes comes as several blocks with the
    same first row, or with ``cut=False`` as one larger block.  Texts are cut after bytes
    that the table ``gap`` marks.  Callers carry what reaches over a cut, so that results
    do not depend on the limit.
    """
    limit = limit or BLOCK_BYTES
    buf, offsets = column_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        if j > i:
            yield i, offsets[i : j + 1] - offsets[i], buf[offsets[i] : offsets[j]]
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        if not cut:
            yield i, offsets[i : i + 2] - at, buf[at:end]
            at = end
        while at < end:
            stop = min(end, at + limit)
            if stop < end:
                spaces = np.flatnonzero(gap[buf[at:stop]])
                stop = at + int(spaces[-1]) + 1 if len(spaces) else _next_gap(buf, stop, end, gap)
            yield i, np.array([0, stop - at], np.int64), buf[at:stop]
            at = stop
        i += 1


def _next_gap(buf: np.ndarray, at: int, end: int, gap: np.ndarray) -> int:
    """Just after the first byte from ``at`` that ``gap`` marks, or ``end``."""
    step = 1 << 16
    while at < end:
        found = np.flatnonzero(gap[buf[at : min(end, at + step)]])
        if len(found):
            return at + int(found[0]) + 1
        at += step
    return end


SLICE_ROWS = 1024


def emit(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """The kept columns of a batch and new ones, in slices that bound what is in flight on both sides."""
    out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new.values()], names=[*keep, *new])
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield out.slice(at, SLICE_ROWS)
    del out
    pa.default_memory_pool().release_unused()  # an executor's workers share its memory with the JVM


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z, and nothing else, lower-cased."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; no run crosses an offset in ``cuts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = cuts[cuts < n]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0)] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(1 << 12)], np.uint64)


def _powers(where: np.ndarray) -> np.ndarray:
    """The base to the power of each place."""
    far, near = where >> 12, _POWERS[where & 0xFFF]
    if not far.any():
        return near
    return near * np.array([pow(0xD6E8FEB86659FD93, i << 12, 1 << 64) for i in range(int(far.max()) + 1)], np.uint64)[far]


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, by position within the run and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    marks = np.zeros(len(buf) + 1, np.int64)
    marks[starts] = starts
    base = np.maximum.accumulate(marks[:-1])
    terms = _MIX[buf] * _powers(np.arange(len(buf)) - base)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    h = sums[ends] - sums[starts]
    h ^= lengths.astype(np.uint64) * _P
    return mix64(h)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_MIX = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
