"""Alignment of two tokenizers' tokens by byte offsets, and how typical each link is of the corpus.

A text is encoded by a byte-level BPE (A, with a space before the text) and by a SentencePiece BPE (B, which adds that
space). One numpy state vector holds a pointer into A's and one into B's tokens for every piece of text of a batch; each
step moves the pointer of the token that ends first, or both where two end together, which is a link and a cut. Pieces that
are through are compacted away. Long texts are dealt to that vector in pieces, cut where neither model can join the sides.

Pairs of linked ids are counted over the corpus. The most frequent ones are broadcast, a bounded number; links of all
others meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged, tidied, without
from .token_counts import provable

#: Characters after which a text is cut at the next proven place, and characters that a task aligns together.
PIECE, BLOCK = 8192, 1 << 20
#: Pieces that can't be cut are encoded by the tokenizers library beyond so many characters.
LONGEST = 1 << 16
#: Counts of pairs that are broadcast at most.
HEAD = 1 << 20
_SHIFT = 24
_MOST_ROWS = 1 << 14

#: Fixed value: how byte-level BPE cuts a text before it merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between visible ASCII characters always begins a token of either model.
_SAFE = re.compile(r"[!-~] (?=[!-~])")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache
def _model_a(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes], bool]:
    """An encoder to ids, the bytes of every id, and whether texts may be cut (the model cuts and merges as is assumed)."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    if before.get("type") != "ByteLevel" or model["type"] != "BPE":
        raise ValueError(f"{path} isn't a byte-level BPE model")
    byte_of = _byte_of()
    table: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items()}
    table |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", []) if x["id"] not in table}
    known = [table.get(i, b"") for i in range(max(table) + 1)]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()

    def slow(text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    plain = not (spec["normalizer"] or before["add_prefix_space"] or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if not (plain and before.get("use_regex", True) and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges)):
        return slow, known, False
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={known[i]: i for i in model["vocab"].values()}, special_tokens={})
    return lambda text: np.array(fast.encode_ordinary(text), np.int64) if len(text) <= LONGEST else slow(text), known, True


@lru_cache
def _model_b(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes], bool]:
    """The same of a SentencePiece model; the encoder takes many texts."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    known = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
    return lambda texts: p.encode(texts, num_threads=1), known, provable(path) and not any("▁" in x.lstrip("▁") for x in pieces)


@lru_cache
def _spelt(path_a: str, path_b: str) -> tuple[list[bytes], int, int]:
    """Ids in decimal, each followed by what can follow it: A's by , or |, then B's by , or ; one after another."""
    a, b = len(_model_a(path_a)[1]), len(_model_b(path_b)[1])
    return [b"%d%s" % (i, x) for n, ends in ((a, b",|"), (b, b",;")) for x in (ends[:1], ends[1:]) for i in range(n)], a, b


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of at least so many characters; the space between two is left out, as a space before each is due."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start() + 1]
        at = m.start() + 2
    yield text[at:]


def lockstep(end_a: np.ndarray, off_a: np.ndarray, end_b: np.ndarray, off_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that end together, in order: off_* are where each piece's tokens begin among end_*, their ends
    in bytes. Both sides of a piece end at the same byte; no token is empty."""
    some = off_a[1:] > off_a[:-1]
    a, b, last = off_a[:-1][some], off_b[:-1][some], off_a[1:][some]
    links = [(a[:0], b[:0])]
    while len(a):
        x, y = end_a[a], end_b[b]
        meet = x == y
        if meet.any():
            links.append((a[meet], b[meet]))
        a, b = a + (x <= y), b + (y <= x)
        if (a == last).any():
            live = a < last
            a, b, last = a[live], b[live], last[live]
    a, b = (np.concatenate(side) for side in zip(*links, strict=True))
    order = np.argsort(a)
    return a[order], b[order]


class _Aligned:
    """The alignments of a batch of texts, gathered block by block."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str, whole: bool):
        self.encode_a, self.bytes_a, cut_a = _model_a(path_a)
        self.encode_b, self.bytes_b, cut_b = _model_b(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.spelt, self.n_ids_a, self.n_ids_b = _spelt(path_a, path_b)
        n = len(texts)
        self.good = np.array([bool(t) for t in texts], bool)
        self.n_a, self.n_b, self.n_links = (np.zeros(n, np.int64) for _ in range(3))
        self.sums = [hashlib.sha256() for _ in texts]
        self.begun = np.zeros(n, bool)
        self.rows, self.keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.spans: list[list] | None = [[[], [], []] for _ in texts] if whole else None
        held, total = [], 0
        for row, text in enumerate(texts):
            for piece in pieces(text, PIECE if cut_a and cut_b else 1 << 62) if text else ():
                held.append((row, piece))
                total += len(piece)
                if total >= BLOCK:
                    self.block(held)
                    held, total = [], 0
        self.block(held)

    def block(self, held: list[tuple[int, str]]) -> None:
        held = [x for x in held if self.good[x[0]]]
        ids_a = [self.encode_a(" " + text) for _, text in held]
        ids_b = [np.array(x, np.int64) for x in self.encode_b([text for _, text in held])]
        for (row, text), a, b in zip(held, ids_a, ids_b, strict=True):
            plain = b" " + text.encode()
            self.good[row] &= all(int(size[ids].sum()) == len(plain) and b"".join(map(known.__getitem__, ids.tolist())) == plain for known, size, ids in ((self.bytes_a, self.size_a, a), (self.bytes_b, self.size_b, b)))
        use = [k for k, (row, _) in enumerate(held) if self.good[row]]
        if not use:
            return
        row_of = np.array([held[k][0] for k in use])
        off_a, off_b = (np.concatenate([[0], np.cumsum([len(ids[k]) for k in use])]) for ids in (ids_a, ids_b))
        a, b = (np.concatenate([ids[k] for k in use]) for ids in (ids_a, ids_b))
        at_a, at_b = lockstep(np.cumsum(self.size_a[a]), off_a, np.cumsum(self.size_b[b]), off_b)
        piece = np.searchsorted(off_a, at_a, "right") - 1
        n = len(self.good)
        for total, count in ((self.n_a, np.diff(off_a)), (self.n_b, np.diff(off_b)), (self.n_links, np.bincount(piece, minlength=len(use)))):
            total += np.bincount(row_of, count, n).astype(np.int64)
        self.rows.append(row_of[piece])
        self.keys.append(a[at_a] << _SHIFT | b[at_b])
        # groups are told: A's tokens of a group, then B's, each with the sign that follows it
        first_b, after_a = np.concatenate([[0], at_b[:-1] + 1]), at_a + 1
        cut_a, cut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        cut_a[at_a], cut_b[at_b] = 1, 1
        told = np.empty(len(a) + len(b), np.int64)
        told[np.arange(len(a)) + first_b[np.cumsum(cut_a) - cut_a]] = a + cut_a * self.n_ids_a
        told[np.arange(len(b)) + after_a[np.cumsum(cut_b) - cut_b]] = b + 2 * self.n_ids_a + cut_b * self.n_ids_b
        edges = np.flatnonzero(np.diff(row_of, prepend=-1, append=-1))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            row = int(row_of[i])
            part = b"".join(map(self.spelt.__getitem__, told[off_a[i] + off_b[i] : off_a[j] + off_b[j]].tolist()))
            self.sums[row].update((b";" if self.begun[row] else b"") + part[:-1])
            self.begun[row] = True
            if self.spans is not None:
                inside = slice(*np.searchsorted(at_a, [off_a[i], off_a[j]]))
                base_a, base_b = (sum(map(len, x)) for x in self.spans[row][:2])
                for held_ids, new in zip(self.spans[row], (a[off_a[i] : off_a[j]], b[off_b[i] : off_b[j]], np.stack([at_a[inside] + 1 - off_a[i] + base_a, at_b[inside] + 1 - off_b[i] + base_b], 1)), strict=True):
                    held_ids.append(new)

    def columns(self) -> dict[str, pa.Array]:
        out = {"n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_links, "n_links": self.n_links}
        out = {k: pa.array(np.where(self.good, v, 0)) for k, v in out.items()}
        told = self.good & self.begun
        out["groups_sha256"] = pa.array([s.hexdigest() if ok else "" for s, ok in zip(self.sums, told, strict=True)], pa.string())
        rows, keys = np.concatenate(self.rows), np.concatenate(self.keys)
        rows, keys = rows[self.good[rows]], keys[self.good[rows]]
        both, times = np.unique(rows << 2 * _SHIFT | keys, return_counts=True)
        off = pa.array(np.searchsorted(both, np.arange(len(self.good) + 1) << 2 * _SHIFT).astype(np.int32))
        out["pairs"] = pa.ListArray.from_arrays(off, pa.array(both & (1 << 2 * _SHIFT) - 1))
        out["times"] = pa.ListArray.from_arrays(off, pa.array(times, pa.int64()))
        if self.spans is not None:
            for k, name in enumerate(("a_ids", "b_ids", "cuts")):
                flat = lambda parts: np.concatenate(parts).tolist() if parts else []
                out[name] = pa.array([flat(s[k]) if ok else [] for s, ok in zip(self.spans, told, strict=True)], pa.list_(pa.int64()) if k < 2 else pa.list_(pa.list_(pa.int64())))
        return out


def align(docs: DataFrame, model_a: str, model_b: str, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with n_a, n_b (tokens), n_groups (stretches between neighbouring cuts), n_links, groups_sha256, and pairs and times:
    the linked ids (A's << 24 | B's), each once, and how many links hold them. With spans also a_ids, b_ids and cuts: at each
    cut, how many tokens of A and of B lie before it.

    Special tokens' strings are plain text. Null and empty texts, and those whose tokens' bytes differ from a space and the
    text (what a model can't spell), have no tokens: zeros, '' and empty lists. Texts are encoded whole, whatever their
    length; repeated rows are each reported; columns of docs with these names are replaced.
    """
    names = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [T.StructField(x, T.LongType()) for x in names] + [T.StructField("groups_sha256", T.StringType()), *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("pairs", "times"))]
    fields += [T.StructField("a_ids", T.ArrayType(T.LongType())), T.StructField("b_ids", T.ArrayType(T.LongType())), T.StructField("cuts", T.ArrayType(T.ArrayType(T.LongType())))] if spans else []
    docs = without(docs, [f.name for f in fields])
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in slices(batches, 2 << 20):
            for start in range(0, every.num_rows, _MOST_ROWS):
                batch = every.slice(start, _MOST_ROWS)
                new = _Aligned(batch.column(batch.schema.get_field_index(text)).to_pylist(), model_a, model_b, spans).columns()
                yield pa.RecordBatch.from_arrays([*batch.columns, *(new[f.name] for f in fields)], names=schema.names)

    return docs.mapInArrow(tidied(run), schema)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows of align hold each pair of ids."""

    def run(batches):
        for batch in batches:
            keys, n = _summed(*(batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(tidied(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, head: int | None = None) -> DataFrame:
    """Rows of align, pairs and times left out, with n_best (links whose pair is as frequent as any of its id of B) and count_sum
    (the sum of all links' counts). aligned is read several times and should be a written table."""
    head = head or HEAD
    counts = staged(pair_counts(aligned), "pairs")
    low = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int").alias("b")
    most = counts.groupBy(low).agg(F.max("n").alias("most")).toArrow()  # a row an id of B
    best = np.zeros(1 << _SHIFT if len(most) else 1, np.int64)[: 1 + max(most.column("b").to_pylist(), default=0)]
    best[most.column("b").to_numpy()] = most.column("most").to_numpy()
    top = (counts if counts.count() <= head else counts.orderBy(F.desc("n"), "pair").limit(head)).toArrow()
    order = np.argsort(keys := top.column("pair").to_numpy().astype(np.int64))
    sent = aligned.sparkSession.sparkContext.broadcast((keys[order], top.column("n").to_numpy().astype(np.int64)[order], best))
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    new = T.StructType([aligned.schema[c] for c in names]).add("n_best", "long").add("count_sum", "long").add("rest", T.ArrayType(T.LongType())).add("rest_times", T.ArrayType(T.LongType()))

    def run(batches):
        known, n_of, most = sent.value
        for batch in slices(batches, 2 << 20):
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            keys, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (pairs, times))
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            met = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            count = np.where(met, n_of[at] if len(known) else 0, 0)
            is_best = met & (count == most[keys & (1 << _SHIFT) - 1])
            total = lambda v: np.add.reduceat(np.append(v, 0), (ends := np.searchsorted(row, np.arange(batch.num_rows)))) * (np.append(ends[1:], len(row)) > ends)  # noqa: B023, E731
            off = pa.array(np.searchsorted(row[~met], np.arange(batch.num_rows + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(off, pa.array(x[~met])) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(total(n * is_best)), pa.array(total(n * count)), *rest], names=new.names)

    rows = aligned.mapInArrow(tidied(run), new)
    if len(keys) < head:  # all pairs are known
        return rows.drop("rest", "rest_times")
    rows = staged(rows, "rest")
    # equal groups have equal links, so that their digest names them
    rest = rows.filter(F.size("rest") > 0).dropDuplicates(["groups_sha256"]).select("groups_sha256", F.explode(F.arrays_zip("rest", "rest_times")).alias("x"))
    rest = rest.select("groups_sha256", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    known = counts.withColumn("b", low).join(F.broadcast(counts.groupBy(low).agg(F.max("n").alias("most"))), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    more = rest.join(known, "pair").groupBy("groups_sha256").agg(F.sum(F.col("times") * F.col("n")).alias("__sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("__best"))
    added = rows.join(more, "groups_sha256", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))})
    return added.select(*names, "n_best", "count_sum")
