"""Benchmark decontamination with suffix arrays of the training texts.

Each task builds a suffix array over a shard of a few MB of its documents' words, and every test suffix is searched in it
by bisection, by its first `width` words; the documents never move. Only suffixes that begin like some test window (its
first words, at most four) are put into the array: no other can match one. An occurrence is an interval of the array, and
each document word lies in at most one interval of each window length, so repetitive texts cost no more than others.
Where windows occur, whole suffixes of documents and items are ranked together, and neighbours in that array give the longest
verbatim matches and all their places (longest.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, aside, staged
from .longest import Suffixes, cover, neighbours
from .words import ALNUM, mix, word_shards

#: Words of test items that one pass over the documents holds; more items mean more passes, written to the shared folder.
BLOCK_WORDS = 2_000_000
#: Places of pairs of a document and an item with common windows that are compared together.
PAIRS = 1 << 20
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", MATCH)]
#: Begin and end of a document's hit words, one pair after the other; only passes of their own need it.
SPANS = T.StructField("__spans", T.ArrayType(T.IntegerType()))
_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))


class Windows:
    """The different windows of a block of test items, sorted for bisection, and all their places in each item."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        self.width, self.ids = width, ids
        found = [(h, np.diff(o)) for _, _, h, o in word_shards(pa.array(texts, pa.string()), ALNUM)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
        length = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        self.vocabulary, code = np.unique(hashes, return_inverse=True)
        padded = np.concatenate([code.astype(np.uint32) + 1, np.zeros(width, np.uint32)])
        n = np.where(length > 0, np.maximum(1, length - width + 1), 0)
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(length[item], width)
        place = (np.cumsum(length) - length)[item] + at
        columns = np.arange(width)
        codes = np.where(columns < size[:, None], padded[place[:, None] + columns], 0).astype(np.uint32)
        self.keys, first, which = np.unique(_keys(codes), return_index=True, return_inverse=True)
        codes, self.size = codes[first], size[first]
        self.short = np.flatnonzero(self.size < width)
        upper = codes[self.short]
        upper[columns >= self.size[self.short][:, None]] = 0xFFFFFFFF
        self.upper = _keys(upper)
        order = np.lexsort((at, item, which))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(which[order]) != 0) | (np.diff(item[order]) != 0)
        self.at = at[order].astype(np.int32)
        self.places = np.append(np.flatnonzero(new), len(order))
        order = order[new]
        self.item, self.window = item[order].astype(np.int32), which[order].astype(np.int32)
        self.holds = np.searchsorted(self.window, np.arange(len(self.keys) + 1))
        self.starts = {p: np.unique(_start(codes[:, :p])[np.minimum(self.size, 4) == p]) for p in (1, 2, 3, 4)}
        self.maybe = _bits(self.vocabulary)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, from 1; 0 for all others."""
        out = np.zeros(len(hashes), np.uint32)
        if len(self.vocabulary):
            at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[place] == hashes[at], place + 1, 0)
        return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[hashes >> np.uint64(44)] = True
    return bits


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows as byte strings whose order is that of the rows."""
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel()


def _start(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = out * np.uint64(0xD6E8FEB86659FD93) + codes[:, k]
    return mix(out)


def suffix_array(codes: np.ndarray, off: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and word places of the suffixes that can match; a suffix ends with its text."""
    padded = np.concatenate([codes, np.zeros(w.width, np.uint32)])
    last = np.repeat(off[1:], np.diff(off))
    here = np.flatnonzero(codes)
    keep = np.zeros(len(here), bool)
    for p, known in w.starts.items():
        if len(known):
            whole = here + p <= last[here]
            head = _start(np.stack([padded[here[whole] + k] for k in range(p)], 1))
            keep[np.flatnonzero(whole)] |= known[np.minimum(np.searchsorted(known, head), len(known) - 1)] == head
    here = here[keep]
    place = here[:, None] + np.arange(w.width)
    keys = _keys(np.where(place < last[here][:, None], padded[place], 0)) if len(here) else np.zeros(0, f"S{4 * w.width}")
    order = np.argsort(keys, kind="stable")
    return keys[order], here[order]


def search(codes: np.ndarray, off: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, word place) of every occurrence of every different window in a shard."""
    if not len(w.keys) or not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = suffix_array(codes, off, w)
    low, high = np.searchsorted(keys, w.keys, "left"), np.searchsorted(keys, w.keys, "right")
    high[w.short] = np.searchsorted(keys, w.upper, "right")
    n = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(n)), n)
    return window, at[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, .. of each of several ranges, and the range that each is of."""
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), which


def longest(w: Windows, off: np.ndarray, window: np.ndarray, place: np.ndarray):
    """(document, item, the item's word, the document's word, length) of the longest matches, sorted, of some documents and items
    at a time. All occurrences of windows in a shard are given, as search finds them."""
    doc = np.searchsorted(off, place, "right") - 1
    order = np.lexsort((place, window, doc))
    doc, window, place = doc[order], window[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(window) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    doc, window = doc[first], window[first]
    low, high = w.holds[window], w.holds[window + 1]
    total = np.cumsum(n * (high - low) + w.places[high] - w.places[low])
    i = 0
    while i < len(doc):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right"))
        j = int(np.searchsorted(doc, doc[min(max(j, i + 1), len(doc)) - 1], "right"))  # whole documents
        held, group = _ranges(low[i:j], (high - low)[i:j])
        group += i
        # documents with more go through their items in several parts
        parts = 1 + (int(total[j - 1]) - (int(total[i - 1]) if i else 0)) // PAIRS
        for k in range(parts):
            some = w.item[held] % parts == k
            if some.any():
                yield _matched(w, off, doc[group[some]], held[some], first[group[some]], n[group[some]], place)
        i = j


def _matched(w: Windows, off: np.ndarray, doc: np.ndarray, held: np.ndarray, first: np.ndarray, n: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """longest, of rows of a document, an item's window (held) and its places in the document (n, from `first` on)."""
    pair = doc * len(w.ids) + w.item[held]
    whole = w.size[w.window[held]] == w.width
    out = []
    if len(short := np.flatnonzero(~whole)):  # items that are one shorter window
        at, of = _ranges(first[short], n[short])
        row = short[of]
        size = w.size[w.window[held[row]]].astype(np.int64)
        kept = cover(pair[row], place[at], size)
        out.append((pair[row[kept]], np.zeros(len(kept), np.int64), place[at[kept]], size[kept]))
    if whole.any():
        pair, held, first, n = pair[whole], held[whole], first[whole], n[whole]
        at, row = _ranges(first, n)
        used, entry = np.unique(held, return_inverse=True)
        item_at, of = _ranges(w.places[used], np.diff(w.places)[used])
        text = w.item[used][of].astype(np.int64)
        order = np.lexsort((w.at[item_at], text))
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        here, one = np.unique(place[at], return_index=True)
        owner = np.searchsorted(off, here, "right") - 1
        suffixes = Suffixes(
            np.concatenate([owner, len(off) + text[order]]),
            np.concatenate([here, w.at[item_at][order]]),
            np.concatenate([w.window[held[row[one]]], w.window[used][of][order]]),
        )
        mine, of_row = _ranges(np.searchsorted(of, entry), np.diff(w.places)[held])
        pairs = np.concatenate([pair[row], pair[of_row]])
        is_item = np.arange(len(pairs)) >= len(row)
        suffix = np.concatenate([np.searchsorted(here, place[at]), len(here) + where[mine]])
        partner, size = neighbours(pairs, suffix, is_item, suffixes)
        size += w.width - 1
        begin = np.concatenate([here, w.at[item_at][order]])
        for side in (False, True):
            rows = np.flatnonzero(is_item == side)
            rows = rows[cover(pairs[rows], begin[suffix[rows]], size[rows])]
            own, other = begin[suffix[rows]], begin[partner[rows]]
            out.append((pairs[rows], own if side else other, other if side else own, size[rows]))
    pair, item_word, word, size = (np.concatenate(x) for x in zip(*out, strict=True))
    found = np.unique(np.stack([pair, word, item_word, size], 1), axis=0)
    doc, item = found[:, 0] // len(w.ids), found[:, 0] % len(w.ids)
    return [doc, item, found[:, 2], found[:, 1] - off[doc], found[:, 3]]


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 13, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), items (sorted ids of the test items with such
    windows) and matches (longest verbatim matches of at least a window: item, its word, the document's word, length).

    Words are runs of a-z, 0-9 and all non-ASCII characters after lower-casing A-Z. A window is `width` consecutive words
    of an item; a shorter item is one window; an item without words has none. A null or empty text has no words and no
    hits. Repeated documents and items are each treated alone; without items nothing is hit. n_hit and items know every
    occurrence. matches hold, for each item, those that cover all the document's words which its windows hit, and those that
    cover all the item's words which the document holds: each is the longest at its place in the document or in the item, so
    that a passage that repeats in either is reported at each place; of places that overlap (a text that repeats itself
    throughout) those that reach furthest are. Columns of docs with these four names are replaced, all others pass. Items are dealt by hash to blocks of about BLOCK_WORDS words, which reach
    the driver and the tasks one after the other, a pass over the documents each.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    n_words = items.agg(F.sum(F.regexp_count(F.col("t"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-n_words // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    fields = [*FIELDS, SPANS]
    for k in range(blocks):
        rows = items.filter(block == k).toArrow()
        held = sc.broadcast(Windows(rows.column("i").to_pylist(), rows.column("t").to_pylist(), width))
        docs = docs.withColumnsRenamed({f.name: f"__was_{f.name}" for f in fields}) if k else docs
        earlier = [f"__was_{f.name}" for f in fields] if k else []

        def compute(held=held, earlier=earlier):
            return lambda batch, col: _match(col, held.value, [batch.column(c).to_pylist() for c in earlier])

        docs = append_columns(docs, text, fields, compute).drop(*earlier)
        if k + 1 < blocks:
            docs = staged(docs, "pass")
            held.unpersist()
    return docs.drop(SPANS.name)


def _match(col: pa.Array, w: Windows, earlier: list[list]) -> dict[str, pa.Array]:
    n_words, n_hit = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
    items, matches, spans = ([[] for _ in range(len(col))] for _ in range(3))
    for i, j, hashes, off in word_shards(col, ALNUM, 1 << 20):
        n_words[i:j] = np.diff(off)
        window, place = search(w.codes(hashes), off, w)
        inside = np.zeros(off[-1] + 1, np.int64)
        np.add.at(inside, place, 1)
        np.add.at(inside, place + w.size[window], -1)
        for d, before in enumerate(earlier[-1][i:j] if earlier else []):
            for a, b in zip(before[::2], before[1::2], strict=True):
                inside[off[d] + a] += 1
                inside[off[d] + b] -= 1
        hit = np.cumsum(inside)[:-1] > 0
        n_hit[i:j] = np.diff(np.concatenate([[0], np.cumsum(hit)])[off])
        if hit.any():
            owner = np.repeat(np.arange(j - i), np.diff(off))
            edge = np.ones(len(hit), bool)
            edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(hit))
            for a, b in zip(first[hit[first]].tolist(), last[hit[first]].tolist(), strict=True):
                d = int(owner[a])
                spans[i + d] += [a - int(off[d]), b - int(off[d])]
        for met in longest(w, off, window, place):
            for d, item, iw, dw, n in zip(*(x.tolist() for x in met), strict=True):
                matches[i + d].append({"item_id": w.ids[item], "item_word": iw, "doc_word": dw, "n_words": n})
    for d, found in enumerate(matches):
        items[d] = {m["item_id"] for m in found}
        if earlier:
            items[d].update(earlier[2][d])
            found.extend(earlier[3][d])
    return {
        "n_words": pa.array(n_words),
        "n_hit": pa.array(n_hit),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        "matches": pa.array(matches, _ARROW),
        SPANS.name: pa.array(spans, pa.list_(pa.int32())),
    }


def contaminated(n_hit, n_words):
    """At least one word and at least a twentieth of them inside windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all the columns they had."""
    rows, back = aside(docs, [f.name for f in FIELDS])
    found = find_matches(rows, benchmark, **options)
    return found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select(*back)
