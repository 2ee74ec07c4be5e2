"""Vectorised splitting and hashing of the words of many texts at once.

The helpers work on one byte buffer that holds several texts.  A word's hash
adds one random 64-bit number per (position, byte) and mixes the sum, so two
different words share a hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np

WIDTH = 64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(
    0, 2**64, size=WIDTH * 256, dtype=np.uint64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit sums."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """Hash of every span [starts[i], starts[i + 1]); bytes flagged in ``skip``
    (separators after a word) add nothing."""
    if len(starts) == 0:
        return np.empty(0, dtype=np.uint64)
    n = len(buf)
    ends = np.append(starts[1:], n)
    pos = np.arange(starts[0], n, dtype=np.int32)
    pos -= np.repeat(starts.astype(np.int32), ends - starts)
    body = buf[starts[0]:]
    part = _TABLE[((pos & (WIDTH - 1)) << 8) + body]
    if len(pos) and pos.max() >= WIDTH:
        part *= (2 * (pos >> 6) + 1).astype(np.uint64)
    if skip is not None:
        part[skip[starts[0]:]] = 0
    return mix(np.add.reduceat(part, starts - starts[0]))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased,
    and for each text the index of its first word (one more entry at the end)."""
    joined = b"\n".join(texts)
    buf = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    return span_hashes(buf, starts, space), np.searchsorted(starts, offsets)


def batches(texts: list[bytes], limit: int = 1 << 19):
    """Index ranges of texts that together hold about ``limit`` bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
