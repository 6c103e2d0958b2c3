"""Near duplicates by MinHash signatures in an inverted index of their coordinates.

1. A set's signature has WIDTH coordinates. A coordinate's value is a pair: the least values of two hash functions over the
   set's shingles. Two sets agree in a least value with the probability of their Jaccard similarity, in a coordinate with
   its square. Linked sets agree in fewer coordinates (or least values) than `matches` says with a probability of at most
   MISS, which gives the thresholds on collisions.
2. Every pair of coordinate and value is a posting list. Sets that collide `matches` times share one of the first
   WIDTH - matches + 1 coordinates of either, in any one order of all lists: those frequent in a sample go last. Only these
   prefixes are posted and merged; the long lists behind are skipped, and looked up for candidates alone.
3. Lists with the same least set are merged to one region. There, collisions over whole signatures (a byte a least value)
   are counted, and a set stays if it has a partner above the threshold that it meets in no region before.
4. What stays is compared on full shingle sets, as the exact join does: links are exact, groups may be of any size, and
   pairs never leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, tidied
from .jaccard_join import FREQUENT, MOST, NAME_BITS, SAMPLE, filtered, linked_sets, node_names, shingle_sets, told_apart
from .words import mix

WIDTH = 64
#: Least values that make up a coordinate's value.
EACH = 2
#: The probability with which two sets at the very threshold of similarity may fail to collide often enough.
MISS = 1e-9
#: Shingles whose coordinates are found together.
_TOGETHER = 1 << 17
_FACTORS = mix(np.arange(1, 1 + (1 << 12), dtype=np.uint64)) | np.uint64(1)


def matches(p: float, width: int, miss: float = MISS) -> int:
    """The most collisions, each of probability p, that all but a share `miss` of the pairs have."""
    below = 0.0
    for k in range(width):
        below += math.comb(width, k) * p**k * (1 - p) ** (width - k)
        if below > miss:
            return k
    return width


def minima(sets: list[np.ndarray], width: int = WIDTH * EACH) -> np.ndarray:
    """A row a set: the least values of its shingles under each of the hash functions."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), width), np.uint64)
    held = np.empty_like(every)
    for k in range(width):
        np.multiply(every, _FACTORS[k], out=held)
        out[:, k] = np.minimum.reduceat(held, at)
    return out


def tokens(least: np.ndarray) -> np.ndarray:
    """Names of the pairs of coordinate and value."""
    parts = mix(least).reshape(len(least), -1, EACH)
    out = _FACTORS[: parts.shape[1]] + parts[:, :, 0]
    for k in range(1, EACH):
        out = mix(out) + parts[:, :, k]
    return mix(out)


def partners(size: np.ndarray, sketch: list[bytes], barred: np.ndarray, percent: int, needed: int) -> np.ndarray:
    """Which sets collide often enough with another one (barred pairs aside) whose size doesn't rule a link out."""
    out = np.zeros(len(size), bool)
    rows = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(size), -1)
    for i in range(len(size) - 1):
        least, most = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        at = i + 1 + np.flatnonzero((100 * least >= percent * most) & ~barred[i, i + 1 :])
        at = at[np.count_nonzero(rows[at] == rows[i], axis=1) >= needed]
        if len(at):
            out[i] = True
            out[at] = True
    return out


def _together(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    held, total = [], 0
    for row, s in found:
        held.append((row, s))
        total += len(s)
        if total >= _TOGETHER:
            yield held
            held, total = [], 0
    if held:
        yield held


def _signed(n: int, prefix: int, often, width: int, bits: int):
    """Of (doc_id, said, text): the set's size and names and, once a task for each set, its prefix and sketch."""

    def run(batches):
        seen = set()
        last = often.value
        for batch in slices(batches):
            size, node, other, first, sketch = np.zeros(batch.num_rows, np.int64), *([None] * batch.num_rows for _ in range(4))

            def new(batch=batch, size=size, node=node, other=other):
                for row, s in shingle_sets(batch.column(2), n):
                    if len(s):
                        size[row], (node[row], other[row]) = len(s), (names := node_names(s, bits))
                        if names not in seen:
                            seen.add(names)
                            yield row, s

            for held in _together(new()):
                least = minima([s for _, s in held], width * EACH)
                named = np.sort(tokens(least), axis=1)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, named), len(last) - 1)] == named
                    named = np.take_along_axis(named, np.argsort(late, axis=1, kind="stable"), axis=1)
                short = (mix(least) >> np.uint64(56)).astype(np.uint8)
                for (row, _), t, b in zip(held, named[:, :prefix].view(np.int64), short, strict=True):
                    first[row], sketch[row] = t, b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "said", "n_shingles", "node", "other", "prefix", "sketch"])

    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 2, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, its own included) and kept (whether it is its own).

    Two documents link if 100 * shared >= percent * all of their different runs of n words; links are confirmed on whole sets.
    A text of fewer than n words is one run; null texts and texts without words have none, link with nothing and are kept.
    Rows with equal sets link with each other. A null doc_id takes part but names no component, and isn't kept unless it has
    no words; repeated rows are each reported. Columns of docs other than these two play no part.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    p = percent / 100
    needed, prefix = matches(p, width * EACH), width - matches(p**EACH, width) + 1

    def sampled(batches):
        for batch in slices(batches):
            for held in _together((row, s) for row, s in shingle_sets(batch.column(0), n) if len(s)):
                yield pa.RecordBatch.from_arrays([pa.array(tokens(minima([s for _, s in held], width * EACH)).ravel().view(np.int64))], names=["token"])

    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").distinct().mapInArrow(tidied(sampled), "token long")
    often = few.groupBy("token").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MOST).toArrow()
    often = docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(often.column("token")).astype(np.int64).view(np.uint64)))

    said = docs.select("doc_id", F.xxhash64("text").alias("said"), "text")
    sig = said.mapInArrow(tidied(_signed(n, prefix, often, width, NAME_BITS)), f"doc_id {kind}, said long, n_shingles long, node long, other long, prefix array<long>, sketch binary")
    sig = told_apart(staged(sig, "signatures"))
    posted = sig.filter("prefix is not null").select("node", F.explode("prefix").alias("token"))
    leaders = posted.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("__top")).filter(F.col("pivot") != F.col("__top")).drop("__top")
    member = staged(posted.join(leaders, "token").select("pivot", "node").distinct(), "regions")
    sketches = staged(sig.filter("sketch is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")), "sketches")
    member = staged(filtered(member, sketches, partial(partners, percent=percent, needed=needed)), "kept")

    rows, result = linked_sets(docs, sig, member, n, percent)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(result, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), "node")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("node").isNull()).alias("kept"))
