"""Words of many texts at once, as 64-bit hashes, found in the UTF-8 bytes of an Arrow column with numpy.

The word patterns in use only set ASCII characters apart, so that bytes do as well as code points. A word's hash is a
polynomial over its bytes; prefix sums over a shard give it for all words together, in a few passes over the bytes.
"""

from __future__ import annotations

import numpy as np

from .common import buffers, shards

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base & (1 << 64) - 1, np.uint64))])
    return _powers[0], _powers[1]


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and where each text's words begin among them (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = _LOWER[data]
    inside = kind[low]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] & ~inside[:-1]
    edge[0], edge[-1] = inside[0], False
    heads = off[:-1][off[:-1] < len(data)]
    edge[heads] = inside[heads]
    starts = np.flatnonzero(edge)
    edge[1:-1] = inside[:-1] & ~inside[1:]
    edge[0], edge[-1] = False, inside[-1]
    tails = off[1:][off[1:] > 0]
    edge[tails] = inside[tails - 1]
    ends = np.flatnonzero(edge)
    power, inverse = _up_to(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((low + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), np.searchsorted(starts, off)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at each word; the last n - 1 are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + size]
    return mix(out)


def word_shards(col, kind: np.ndarray, limit: int = 1 << 20):
    """(first row, last row, hashes, offsets) over a string column, shard by shard."""
    data, off = buffers(col)
    for i, j in shards(off, limit):
        yield i, j, *words(data[off[i] : off[j]], off[i : j + 1] - off[i], kind)
