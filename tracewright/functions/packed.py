"""Postings of a block as bytes: ids that are whole numbers, and places, by their differences, seven bits to a byte.

A block is a term's row: n_ids documents with n_places places in all. If a block holds any other id, its ids are joined as text
(names), and their lengths stand in place of the differences. No column is nested: handing over lists row by row to Python costs
several times as much as bytes do.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a packed block has beside its key.
FIELDS = "n_ids int, n_places int, ids binary, names binary, places binary"
NAMES = ("n_ids", "n_places", "ids", "names", "places")
#: Ids that are whole numbers: texts as such a number is written, of 18 digits at most.
_WHOLE, _TOP = r"^(0|-?[1-9][0-9]{0,17})$", 10**18


class Ids(NamedTuple):
    """Ids in order: those that are named, as text, the others as whole numbers."""

    named: np.ndarray
    numbers: np.ndarray
    names: pa.Array

    def take(self, keep: np.ndarray) -> Ids:
        """Those of a mask."""
        return Ids(self.named[keep], self.numbers[keep[~self.named]], self.names.filter(pa.array(keep[self.named])))

    def texts(self) -> pa.Array:
        at = np.where(self.named, len(self.numbers) + np.cumsum(self.named) - 1, np.cumsum(~self.named) - 1)
        return pa.concat_arrays([pa.array(self.numbers).cast(pa.string()), self.names]).take(pa.array(at))


class Postings(NamedTuple):
    """Blocks: n ids of each, all ids, how many places each id has, and all places."""

    n: np.ndarray
    ids: Ids
    counts: np.ndarray
    places: np.ndarray


def ids_of(values: pa.Array) -> Ids:
    """Ids from texts or whole numbers; a number and its text are the same id."""
    if pa.types.is_signed_integer(values.type):
        plain = pc.fill_null(values.cast(pa.int64()), _TOP).to_numpy(zero_copy_only=False)
        named = (plain >= _TOP) | (plain <= -_TOP)
    else:
        values = values.cast(pa.string())
        named = ~pc.fill_null(pc.match_substring_regex(values, _WHOLE), False).to_numpy(zero_copy_only=False)
    numbers = values.filter(pa.array(~named)).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return Ids(named, numbers, values.filter(pa.array(named)).cast(pa.string()))


def postings_of(ids: pa.Array, places: pa.Array) -> Postings:
    """From lists of ids and lists of lists of places."""
    n, each = lengths(ids), places.flatten()
    return Postings(n, ids_of(ids.flatten()), lengths(each), each.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(n: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of the lengths n."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values)


def _steps(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first of each list, then how much is added (modulo 2^64)."""
    out = np.diff(values, prepend=np.int64(0))
    first = (np.cumsum(n) - n)[n > 0]
    out[first] = values[first]
    return out


def _sums(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values that have these steps."""
    total = np.cumsum(steps)
    n = n[n > 0]
    first = np.cumsum(n) - n
    return total - np.repeat(total[first] - steps[first], n)


def _bytes(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Unsigned numbers of 64 bits, n for each entry: seven bits to a byte, the lowest first, the last below 128."""
    size = np.ones(len(values), np.int8)
    for k in range(7, int(values.max(initial=0)).bit_length(), 7):
        size += values >= np.uint64(1 << k)
    at = np.append(0, np.cumsum(size, dtype=np.int64))
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = values.astype(np.uint8) & 127 | (size > 1).view(np.uint8) << 7
    some, k = np.flatnonzero(size > 1), 1
    while len(some):
        more = size[some] > k + 1
        out[at[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more.view(np.uint8) << 7
        some, k = some[more], k + 1
    ends = at[np.append(0, np.cumsum(n))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _data(packed: pa.Array) -> np.ndarray:
    """The bytes of all entries."""
    packed = pc.fill_null(packed, b"")
    if not len(packed) or packed.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :][: len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _numbers(packed: pa.Array) -> np.ndarray:
    """All numbers of all entries."""
    data = _data(packed)
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)[: len(last)]
    out = (data[first] & 127).astype(np.uint64)
    some, k = np.flatnonzero(last > first), 1
    while len(some):
        out[some] |= (data[first[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        some, k = some[last[some] > first[some] + k], k + 1
    return out


def pack_ids(n: np.ndarray, ids: Ids) -> tuple[pa.Array, pa.Array]:
    """ids and names of blocks of n ids; names are null where all ids are whole numbers."""
    of = np.repeat(np.arange(len(n)), n)
    mixed = np.zeros(len(n), bool)
    mixed[of[ids.named]] = True
    named = mixed[of]
    steps = _steps(ids.numbers[~named[~ids.named]], np.where(mixed, 0, n))
    values = np.empty(len(of), np.uint64)
    values[~named] = (steps << 1 ^ steps >> 63).view(np.uint64)
    if not mixed.any():
        return _bytes(values, n), pa.nulls(len(n), pa.binary())
    texts = ids.texts().filter(pa.array(named))
    size = pc.fill_null(pc.binary_length(texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values[named] = (size + 1).view(np.uint64)
    ends = np.append(0, np.cumsum(np.maximum(size, 0)))[np.append(0, np.cumsum(np.where(mixed, n, 0)))]
    joined = b"".join(x.encode() for x in texts.to_pylist() if x)
    return _bytes(values, n), pa.Array.from_buffers(pa.binary(), len(n), [pa.array(mixed).buffers()[1], pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(joined)])


def unpack_ids(n: np.ndarray, packed: pa.Array, names: pa.Array) -> Ids:
    mixed = names.is_valid().to_numpy(zero_copy_only=False)
    named, values = np.repeat(mixed, n), _numbers(packed)
    steps = values[~named]
    steps = (steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64)
    size = values[named].view(np.int64) - 1
    ends = np.append(0, np.cumsum(np.maximum(size, 0))).astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(size), [pa.array(size >= 0).buffers()[1], pa.py_buffer(ends), pa.py_buffer(_data(names))])
    return Ids(named, _sums(steps, np.where(mixed, 0, n)), texts)


def _between(n: np.ndarray, n_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, among the numbers of all blocks, the counts of each block stand, and its places behind them."""
    before_ids, before_places = np.cumsum(n) - n, np.cumsum(n_places) - n_places
    return np.arange(n.sum()) + np.repeat(before_places, n), np.arange(n_places.sum()) + np.repeat(before_ids + n, n_places)


def pack(some: Postings) -> list[pa.Array]:
    """The columns FIELDS."""
    n, ids, counts, places = some
    n_places = np.bincount(np.repeat(np.arange(len(n)), n), counts, len(n)).astype(np.int64)
    at_counts, at_places = _between(n, n_places)
    values = np.empty(len(counts) + len(places), np.uint64)
    values[at_counts], values[at_places] = counts.view(np.uint64), _steps(places, counts).view(np.uint64)
    return [pa.array(n.astype(np.int32)), pa.array(n_places.astype(np.int32)), *pack_ids(n, ids), _bytes(values, n + n_places)]


def unpack_places(n: np.ndarray, n_places: np.ndarray, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """counts and places."""
    at_counts, at_places = _between(n, n_places)
    values = _numbers(packed).view(np.int64)
    counts = values[at_counts]
    return counts, _sums(values[at_places], counts)


def runs(*keys: pa.Array) -> np.ndarray:
    """Where rows begin whose keys differ from those of the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        codes = [pc.fill_null(pc.dictionary_encode(k).indices, -1).to_numpy(zero_copy_only=False) for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return np.flatnonzero(new)
