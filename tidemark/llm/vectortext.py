"""Whole Arrow batches of texts as numpy arrays: words, rolling hashes, sampled positions.

Everything here works inside one task on a bounded piece of a batch; Spark partitions and shuffles the rest.
Hashes depend on content alone, so equal strings get equal numbers on every executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(n: int, of: U, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, PIECE + 4096), of, U)
        got[0] = 1
        _powers[name] = got = np.cumprod(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A new array of well mixed 64-bit values, one to one with x."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about limit bytes; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+; words never cross rows."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] telling what values[i:j] are, up to a power; see substring_hash."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), BASE, "up"), out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal substrings get equal hashes; the length goes into the hash."""
    down = powers(len(prefix), INVERSE, "down")
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return substring_hash(prefix_hash(BYTES[data]), starts, ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; the caller drops those that cross rows."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= BASE
        out += hashes[k : k + m]
    return mix(out)


def join_ids(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Bucket ids of strings from the ids of their first part and of what starts shift positions later."""
    m = len(right) - shift
    if m <= 0:
        return np.zeros(0, U)
    return mix(left[:m] * BASE + right[shift:])


def sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over each run of width values."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def sampled(ids: np.ndarray, rows: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions whose id is the least in some window of `window` symbols that lies in one row.

    ids[i] names the gram that starts at i; rows[i] is the row of symbol i. Equal windows sample equal
    positions, so each window has at least one sampled gram, the same wherever the window occurs.
    """
    width = window - gram + 1
    least = sliding(ids, width, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    least = np.where(rows[: len(least)] == rows[window - 1 : window - 1 + len(least)], least, U(0))
    pad = np.zeros(width - 1, U)
    best = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero((ids == best[: len(ids)]) & (best[: len(ids)] != 0))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))
