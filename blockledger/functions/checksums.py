"""CRC sums of chunks that Spark has no function for, and the sum of a whole from the sums of its chunks.

All chunks of a transfer batch advance together, a byte at a time. Sums combine without the bytes: appending n bytes to
a text changes its sum by a linear map over bits, that of n zero bytes, and the sum of those bytes is added to it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The polynomials of both kinds, lowest power in the highest bit.
POLYNOMIALS = {"crc32": 0xEDB88320, "crc32c": 0x82F63B78}
ONES = np.uint32(0xFFFFFFFF)


@lru_cache
def remainders(kind: str) -> np.ndarray:
    """What each value of the lowest byte leaves after eight shifts."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIALS[kind]), table >> 1)
    return table


def chunk_crcs(texts: list[bytes | None], size: int, kind: str) -> list[list[int] | None]:
    """The sums of the consecutive chunks of `size` bytes of every text; none for an empty one, null for null."""
    table = remainders(kind)
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    chunks = -(-lengths // size)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(texts)), chunks)
    first = np.cumsum(chunks) - chunks
    start = begins[owner] + (np.arange(len(owner)) - first[owner]) * size
    length = np.minimum(begins[owner + 1] - start, size)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    sums = np.full(len(order), ONES, np.uint32)
    for at in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -at, side="left"))  # the chunks that have a byte here
        c = sums[:n]
        sums[:n] = (c >> np.uint32(8)) ^ table[(c ^ data[start[:n] + at]) & np.uint32(0xFF)]
    out = np.empty(len(order), np.int64)
    out[order] = sums ^ ONES
    return [None if t is None else out[a : a + n].tolist() for t, a, n in zip(texts, first, chunks)]


@lru_cache(maxsize=4096)
def appended(kind: str, n: int) -> tuple[int, ...]:
    """What `n` zero bytes make of each single bit of a sum."""
    table = remainders(kind)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = (bits >> np.uint32(8)) ^ table[bits & np.uint32(0xFF)]
    total = bits
    while n:
        if n & 1:
            total = moved(step, total)
        step = moved(step, step)
        n >>= 1
    return tuple(total.tolist())


def moved(images: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of single bits, on many sums."""
    out = np.zeros(len(sums), np.uint32)
    for bit in range(32):
        out ^= np.where((sums >> np.uint32(bit)) & np.uint32(1), images[bit], np.uint32(0)).astype(np.uint32)
    return out


def combined(sums: list[int], length: int, size: int, kind: str) -> int:
    """The sum of a text of `length` bytes from the sums of its chunks, two neighbours at a time."""
    if not sums:
        return 0
    parts = [(s, min(size, length - i * size)) for i, s in enumerate(sums)]
    while len(parts) > 1:
        pairs = [(*parts[i], *parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
        left = np.array([p[0] for p in pairs], np.uint32)
        joined = np.zeros(len(pairs), np.uint32)
        sizes = np.array([p[3] for p in pairs])
        for n in np.unique(sizes):
            of = sizes == n
            joined[of] = moved(np.array(appended(kind, int(n)), np.uint32), left[of])
        rest = parts[-1:] if len(parts) % 2 else []
        parts = [(int(j) ^ p[2], p[1] + p[3]) for j, p in zip(joined, pairs)] + rest
    return int(parts[0][0])


def crc_chunks(data: Column, size: int, kind: str) -> Column:
    """`chunk_crcs` of a binary column."""

    @F.pandas_udf("array<bigint>")
    def sums(texts: pd.Series) -> pd.Series:
        return pd.Series(chunk_crcs(texts.tolist(), size, kind), dtype=object)

    return sums(data)


def combined_crc(sums: Column, length: Column, size: int, kind: str) -> Column:
    """The sum of the whole from those of its chunks, without reading the contents; null for null."""

    @F.pandas_udf("bigint")
    def whole(chunks: pd.Series, lengths: pd.Series) -> pd.Series:
        found = [None if c is None else combined(list(c), int(n), size, kind) for c, n in zip(chunks, lengths)]
        return pd.Series(found, dtype="Int64")

    return whole(sums, length)
