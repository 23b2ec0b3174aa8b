"""64-bit hashes of the words of many texts at once, as numpy helpers for code that runs inside tasks.

Each byte stands for a fixed random number; a word's hash is the sum of its bytes' numbers times powers of an odd base,
modulo 2^64, mixed at the end. Sums over any stretch come from one running sum, so no word is looked at on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, np.uint64)
_POWERS: dict[int, np.ndarray] = {}

# What op5 and op10 call a word: no blank and no \t \n \v \f \r.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


LOWER = lower_table()


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, for at least n."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        n = max(n, 1 << 16)
        kept = np.full(n, base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 1 << 23:
            _POWERS[base] = kept
    return kept


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 places where its texts begin and end; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, cuts: np.ndarray, gap: np.ndarray, lower: np.ndarray = LOWER):
    """Hashes of the words in the texts between `cuts`, where `gap` tells which bytes are no part of a word.

    Returns the hashes, and the n + 1 places in them where the words of each text begin and end.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    running = BYTES[lower[data]]
    running *= powers(BASE, n)[:n]
    np.cumsum(running, out=running)
    sums = running[stops]
    sums[starts > 0] -= running[starts[starts > 0] - 1]
    sums *= powers(INVERSE, n)[starts]
    sums += (stops - starts).astype(np.uint64)
    return mixed(sums), np.searchsorted(starts, cuts), starts, stops + 1
