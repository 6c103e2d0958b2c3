"""Stupid-backoff scores, every document scored by what the others hold.

S(w | u .. v) is the count of "u .. v w" in the other documents over the count of "u .. v" as a context; where no other
document holds "u .. v w", it is ALPHA times S of w after a context one word shorter, and in the end the share of w among all
words. Contexts have at most order - 1 words, and fewer at a document's begin. A document's score is the mean of ln S over
its words. Counts cover all documents.

Documents are dealt to blocks of about BLOCK bytes, a written row each. A block's n-grams are exploded and counted by their
hash, so that each crosses the network once a block and not once a document; ranges of hashes are groups, which add the
blocks' counts up and tell each block those of its own n-grams. A block is joined with what it is told by its number: blocks
are written in buckets of it, so that texts aren't shuffled. Of n-grams that only one document holds nothing is told, as a
document's own n-grams don't count for it. Hot n-grams are a number in each block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import shared_dir
from .common import tidied
from .words import ALNUM, mix, word_shards

ALPHA = 0.4
#: Words of the longest n-grams that are counted unless the caller says otherwise.
ORDER = 3
#: Bytes of text whose n-grams are exploded and counted together.
BLOCK = 11 << 20
#: Bytes of text whose words are found together: this takes some fifty times as much memory.
SHARD = 2 << 20
#: Bytes of text for each range of hashes that is added up at once.
RANGE = 8 << 20
_ASKED = "k int, range int, block long, size int, grams binary, count binary, followed binary, shared binary"
_TOLD = "k int, range int, block long, size int, words long, known binary, count binary, followed binary"


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(w ^ mix(v + np.uint64(1)))


def _packed(x: np.ndarray) -> bytes:
    """Numbers as a compressed column, their lowest bytes first."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _dealt(schema: T.StructType):
    """Of (doc_id, text): rows (block, bytes, ids, texts) of about BLOCK bytes of text."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def row():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            one = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(k)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), *one], names=schema.names)

        for batch in batches:
            length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = length[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(length, before + BLOCK - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(length[min(to, batch.num_rows) - 1] - before)
                at = to
                if size >= BLOCK or at < batch.num_rows:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return run


def _levels(texts: pa.Array, order: int):
    """For k = 1 .. order: the n-grams of k words of a block's texts, their documents and the places of their last words;
    first the number of words of each text."""
    found = [(gram, np.diff(off)) for _, _, gram, off in word_shards(texts, ALNUM, SHARD)]
    gram, words = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found))
    del found
    doc = np.repeat(np.arange(len(texts)), words)
    place = np.arange(len(gram))
    yield words
    for k in range(1, order + 1):
        if k > 1:
            at = np.flatnonzero(doc[1:] == doc[:-1])
            gram, doc, place = _pair(gram[at], gram[at + 1]), doc[at], place[at + 1]
        yield k, gram, doc, place


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _range_edges(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of so many ranges of hashes begins in sorted ones, and their end."""
    firsts = np.array([-(-(r << 64) // ranges) for r in range(ranges)], np.uint64)
    return np.append(np.searchsorted(grams, firsts), len(grams))


def _asked(order: int, ranges: int):
    """Of blocks: what each holds of every range of hashes, a row for each, even where it holds nothing."""

    def run(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                block, levels = batch.column(0)[b].as_py(), _levels(batch.column(1)[b].values, order)
                next(levels)
                for k, gram, doc, _ in levels:
                    by = np.argsort(gram, kind="stable")
                    last = np.append(doc[1:] != doc[:-1], True)[by]
                    gram, doc = gram[by], doc[by]
                    at = _runs(gram)
                    ends = np.append(at[1:], len(gram))
                    count = ends - at
                    followed = count - (np.add.reduceat(last.astype(np.int64), at) if len(at) else 0)
                    shared = doc[at] != doc[ends - 1]
                    held = gram[at]
                    edges = _range_edges(held, ranges)
                    rows = []
                    for r in range(ranges):
                        i, j = edges[r], edges[r + 1]
                        rows.append((k, r, block, j - i, _packed(np.diff(held[i:j], prepend=np.uint64(0))), _packed(count[i:j]), _packed(followed[i:j]), _packed(shared[i:j])))
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ASKED.split(", ")])

    return run


def _told(order: int):
    """Adds up what blocks hold of a range of hashes; each is told of its own n-grams, in their order, which of them several
    documents hold, and the counts of these (of words, of all)."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        column = lambda c: table.column(c).to_pylist()
        sizes = column("size")
        read = lambda c, kind=np.int64: np.concatenate([_unpacked(x, n, kind) for x, n in zip(column(c), sizes)])
        gram = np.concatenate([np.cumsum(_unpacked(x, n, np.uint64), dtype=np.uint64) for x, n in zip(column("grams"), sizes)])
        by = np.argsort(gram, kind="stable")
        at = _runs(gram[by])
        which = np.empty(len(by), np.int64)
        which[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
        add = lambda x: np.add.reduceat(x[by], at) if len(at) else x
        count, followed = add(read("count")), add(read("followed"))
        known = (np.diff(np.append(at, len(by))) > 1) | (add(read("shared", np.bool_).astype(np.int64)) > 0)
        words = int(count.sum()) if k == 1 else 0
        if k == 1:
            known[:] = True
        rows, end = [], 0
        for n in sizes:
            own = which[end : end + n]
            end += n
            kept = known[own]
            rows.append((words, _packed(np.packbits(kept)), _packed(count[own][kept]), _packed(followed[own][kept]) if k < order else b""))
        kinds = (pa.int64(), *[pa.binary()] * 3)
        return pa.Table.from_arrays([*(table.column(c) for c in ("k", "range", "block", "size")), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=[x.split()[0] for x in _TOLD.split(", ")])

    return run


def _scored(order: int, schema: T.StructType):
    """Of (ids, texts, told): a row for each document."""

    def run(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                texts, told = batch.column(1)[b].values, sorted(batch.column(2)[b].as_py(), key=lambda x: (x["k"], x["range"]))
                levels = _levels(texts, order)
                words = next(levels)
                total, context = sum(x["words"] for x in told), None
                value = np.zeros(int(words.sum()))
                for k, gram, doc, place in levels:
                    own = [x for x in told if x["k"] == k]
                    known = np.concatenate([np.unpackbits(_unpacked(x["known"], -(-x["size"] // 8), np.uint8), count=x["size"]) for x in own]).astype(bool)
                    which_known = np.cumsum(known) - 1
                    read = lambda c: np.concatenate([_unpacked(x[c], int(m), np.int64) for x, m in zip(own, marks)])  # noqa: B023, E731
                    ends = np.cumsum([x["size"] for x in own])
                    marks = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(known)])[ends]]))
                    by = np.argsort(gram, kind="stable")
                    at = _runs(gram[by])
                    if len(at) != len(known):
                        raise ValueError("a block was told of other n-grams than it asked for")
                    which = np.empty(len(gram), np.int64)
                    which[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
                    hit = known[which]
                    n = which_known[which[hit]]
                    count = read("count")[n]
                    if k == 1:
                        value = np.log(count / total) if total else value
                    else:
                        both = np.flatnonzero(np.concatenate([[True], (np.diff(gram[by]) != 0) | (np.diff(doc[by]) != 0)])) if len(by) else np.zeros(0, np.int64)
                        mine = np.empty(len(gram), np.int64)
                        mine[by] = np.repeat(np.diff(np.append(both, len(by))), np.diff(np.append(both, len(by))))
                        value[place[~hit]] += math.log(ALPHA)
                        value[place[hit]] = np.log((count - mine[hit]) / context[place[hit] - 1])
                    if k < order:
                        context = np.zeros(len(value), np.int64)  # by the place of the n-gram's last word
                        context[place[hit]] = read("followed")[n]
                sums = np.bincount(np.repeat(np.arange(len(texts)), words), value, len(texts))
                mean = pa.array(np.divide(sums, words, where=words > 0, out=np.zeros(len(texts))), pa.float64(), mask=words == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[b].values, pa.array(words, pa.int64()), mean], names=schema.names)

    return run


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, bytes, ids, texts), written in buckets of block. The catalog forgets the table; its files stay, as all scratch does."""
    spark, kind = docs.sparkSession, docs.schema[0].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("texts", T.ArrayType(T.StringType()))])
    name = f"backoff_blocks_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(tidied(_dealt(schema)), schema)
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").options(path=f"{shared_dir(spark)}/{name}", compression="zstd").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return blocks


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """doc_id, n_words and score (mean ln S of the document's words; null without words) of every row.

    order is the number of words of the longest n-grams. Words are runs of a-z, 0-9 and non-ASCII characters after
    lower-casing A-Z. Repeated rows are documents of their own, so each is the other's corpus; null ids are ids. Rows are
    dealt to blocks in a written copy, so that an input that gives its rows in another order when it is read again does no
    harm. N-grams are known by 64-bit hashes. Other columns play no part.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = _blocks(docs)
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    asked = blocks.select("block", "texts").mapInArrow(tidied(_asked(order, max(1, -(-size // RANGE)))), _ASKED)
    told = asked.groupBy("k", "range").applyInArrow(_told(order), _TOLD)
    told = told.groupBy("block").agg(F.collect_list(F.struct("k", "range", "size", "words", "known", "count", "followed")).alias("told"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    return blocks.join(told, "block").select("ids", "texts", "told").mapInArrow(tidied(_scored(order, schema)), schema)
