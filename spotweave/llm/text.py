"""Vectorised word and n-gram hashing over Arrow string columns.

Words are runs of bytes other than space and tab to carriage return; A-Z count
as a-z.  Every function works on slices of a batch of bounded bytes (a single
longer text is a slice of its own), so a task's memory doesn't follow the
length of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2_000_000

#: Odd, so each has an inverse modulo 2^64.
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _symbol_table(size: int, fold: bool) -> np.ndarray:
    table = mix64(np.arange(1, size + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_BYTES = _symbol_table(256, fold=True)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers at least; the table is kept for the worker's life, and its length enters no result."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE_BYTES), base, U64)
        held[0] = 1
        held = _powers[base] = np.cumprod(held, dtype=U64)
    return held


def _hashes(values: np.ndarray, starts: np.ndarray, cuts: list[np.ndarray], base: int = _BASE, table: np.ndarray | None = None) -> list[np.ndarray]:
    """Hashes of the spans from ``starts`` to each of ``cuts`` (the first of which are the furthest) over ``values``, or over what ``table`` holds for them.

    A span's hash is the sum of its values times the base's powers, moved back to
    the span's start by the inverse's.  Where spans are in order, long values are
    taken in pieces of ``SLICE_BYTES``, which bounds the tables and the memory.
    """
    far = cuts[0]
    if len(values) > SLICE_BYTES and len(starts) > 1 and (starts[1:] >= starts[:-1]).all() and (far[1:] >= far[:-1]).all():
        parts, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(far, starts[i] + SLICE_BYTES, "right")))
            low = starts[i]
            parts.append(_hashes(values[low : far[j - 1]], starts[i:j] - low, [c[i:j] - low for c in cuts], base, table))
            i = j
        return [np.concatenate(p) for p in zip(*parts)]
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum((values if table is None else table[values]) * powers(base, n + 1)[:n], out=total[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)[starts]
    return [mix64((total[c] - total[starts]) * back + (c - starts).astype(U64)) for c in cuts]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, whatever its place and whatever the worker hashed before."""
    return _hashes(values, starts, [ends], table=table)[0]


def second_span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 more bits that don't follow from ``span_hashes``."""
    return _hashes(mix64(values), starts, [ends], _BASE2)[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and each row's first word (one more at the end)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(data, starts, ends, _BYTES)


def word_and_prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """``word_hashes``, then those of the words' first ``length`` bytes for each length (all of a shorter one)."""
    return _hashes(data, starts, [ends, *(np.minimum(ends, starts + k) for k in lengths)], table=_BYTES)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on, for the len(h) - n + 1 places that have so many."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out *= U64(0x9FB21C651E98DF25)
        out += h[i : i + m]
        out ^= out >> U64(29)
    return mix64(out)


def row_gram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of every row, and each row's first one; grams don't cross rows.  Shorter rows have none."""
    grams = gram_hashes(h, n)
    count = np.maximum(np.diff(first) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - out[:-1], count) + np.arange(out[-1])
    return grams[at] if len(at) else np.zeros(0, U64), out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-word shingles; a row of fewer words has them all as one, a row of none nothing."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    grams, at = row_gram_hashes(h, first, n)
    out = []
    for i in range(len(offsets) - 1):
        g = grams[at[i] : at[i + 1]]
        if not len(g) and first[i] < first[i + 1]:
            short = h[first[i] : first[i + 1]]
            g = gram_hashes(short, len(short)) ^ U64(len(short))
        if len(g) > 1:
            g = np.sort(g)
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        out.append(g)
    return out
