"""Document fingerprints by locally consistent parsing.

Symbols (first the code points) are cut into phrases by deterministic coin tossing: each symbol's label is the lowest bit in
which it differs from the one before, four rounds of this leave labels below six, and a phrase begins at each local maximum.
A phrase's name is a hash of its symbols, and the names are the symbols of the next level. All of this looks a few symbols
around, so equal substrings are parsed alike inside, wherever they stand. A fingerprint holds the least hashes of a text's
phrases of LEVELS (about a dozen and a few dozen characters long).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, staged, tidied
from .words import mix

#: Levels whose phrases count, and hashes that a fingerprint holds (8 hex digits each).
LEVELS, SIZE = (2, 3), 64
#: Bytes of texts that are sorted together, each text before its successor; above MOST groups they grow instead. Groups are
#: cut by percentiles of the ids, COARSE of all rows and then as many as are needed within each of these.
GROUP_BYTES, MOST, COARSE = 8 << 20, 50_000, 256
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(1 << 16, 2 * n), base, np.uint64))])
    return _powers[0], _powers[1]


def _lowest(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit; 0 for 0."""
    low = x & (~x + np.uint64(1))
    return np.bitwise_count(np.maximum(low, np.uint64(1)) - np.uint64(1)).astype(np.uint64)


def _starts(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """flag with every text's first symbol set."""
    flag[off[:-1][off[:-1] < off[1:]]] = True
    return flag


def parse(symbols: np.ndarray, off: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of consecutive texts, and where each text's phrases begin. Runs of one symbol become one first."""
    n = len(symbols)
    if not n:
        return symbols, off
    new = np.ones(n, bool)
    new[1:] = symbols[1:] != symbols[:-1]
    at = np.flatnonzero(_starts(new, off))
    length = np.diff(np.append(at, n)).astype(np.uint64)
    run = np.where(length > 1, mix(symbols[at] ^ (length << np.uint64(48))), symbols[at])
    off = np.searchsorted(at, off)
    n = len(run)
    first = _starts(np.zeros(n, bool), off)
    label = run
    for _ in range(4):
        before = np.empty_like(label)
        before[0], before[1:] = 0, label[:-1]
        low = _lowest(label ^ before)
        label = np.where(first, np.uint64(0), np.uint64(2) * low + ((label >> low) & np.uint64(1)))
    small = label.astype(np.int8)
    cut = np.zeros(n, bool)
    cut[1:-1] = (small[1:-1] > small[:-2]) & (small[1:-1] >= small[2:])
    cut[off[1:][off[1:] > off[:-1]] - 1] = False  # a text's last symbol has no next one
    starts = np.flatnonzero(_starts(cut, off))
    ends = np.append(starts[1:], n)
    power, inverse = _up_to(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(mix(run + np.uint64(level)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), np.searchsorted(starts, off)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: sorted 8-digit hex numbers; empty for an empty text. Equal texts have equal ones."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    held = []
    for level in range(1, max(LEVELS) + 1):
        symbols, off = parse(symbols, off, level)
        if level in LEVELS:
            held.append(((mix(symbols ^ np.uint64(level)) >> np.uint64(32)).astype(np.uint32), off))
    out = []
    for d in range(len(texts)):
        least = np.unique(np.concatenate([h[o[d] : o[d + 1]] for h, o in held]))[:SIZE]
        out.append(least.astype(">u4").tobytes().hex())
    return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two texts' phrases: the shared part of the least hashes of both together."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32) for s in (a, b))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)
    if len(x) == SIZE or len(y) == SIZE:
        both = both[:SIZE]
    shared = np.intersect1d(x, y, assume_unique=True)
    return float((shared <= both[-1]).sum() / len(both))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many of the first code points of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _rows(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[list[tuple]]:
    """(row, next row) in blocks of about so many characters; the last row of a bucket is a stand-in and only a next row."""
    last, out, total = None, [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and not last[1]:
                out.append((last, row))
                total += len(last[3])
                if total >= size:
                    yield out
                    out, total = [], 0
            last = row
    if out:
        yield out


def _cuts(n: int) -> list[float]:
    return [k / n for k in range(1, n)]


def with_successors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """bucket, last, id and text, sorted so that each row's successor in ascending id follows it within its bucket, which a
    stand-in (last = 1) with the first text of the next bucket ends; the last bucket's has the first text of all.

    Buckets hold about equally many rows: percentiles of the ids cut the table, and percentiles within each part cut it
    again. Each bucket is a partition. Null ids come first; rows of one id stay together, in order of their texts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(1, min(-(-size // GROUP_BYTES), MOST))
    coarse = min(wanted, COARSE)
    fine = -(-wanted // coarse)
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    place = lambda ends: F.size(F.filter(ends, lambda b: b <= key)).cast("long")
    rows = rows.withColumn("bucket", F.lit(0).cast("long"))
    if coarse > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx(key, _cuts(coarse), 100_000)).first()[0] or []))
        rows = rows.withColumn("bucket", place(F.array(*map(F.lit, bounds)).cast("array<long>")))
    if fine > 1:
        within = staged(rows.groupBy("bucket").agg(F.percentile_approx(key, _cuts(fine), 10_000).alias("ends")), "bounds")
        rows = rows.join(F.broadcast(within), "bucket").withColumn("bucket", F.col("bucket") * fine + place(F.array_distinct("ends"))).drop("ends")  # at most COARSE + 1 rows
    firsts = staged(rows.groupBy("bucket").agg(F.min(key).alias("key")), "firsts")
    order = Window.orderBy("bucket")  # a row per bucket
    start = F.first("key").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = staged(firsts.select("bucket", F.coalesce(F.lead("key").over(order), start).alias("key")), "after")
    texts = join_small(rows.select(key.alias("key"), "text"), after, "key").groupBy("bucket").agg(F.min("text").alias("text"))
    ends_ = texts.select("bucket", F.lit(1).alias("last"), F.lit(None).cast("long").alias("id"), "text")
    every = rows.select("bucket", F.lit(0).alias("last"), "id", "text").unionByName(ends_)
    numbers = staged(firsts.select("bucket", (F.row_number().over(order) - 1).alias("part")), "parts")
    parts = max(1, numbers.count())
    every = every.join(F.broadcast(numbers), "bucket")  # at most MOST + COARSE rows
    return every.repartitionById(parts, "part").select("bucket", "last", "id", "text").sortWithinPartitions("bucket", "last", F.col("id").asc_nulls_first(), "text")


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars (code points), fingerprint, the edited text (last quarter replaced from the next document's start) and
    its fingerprint, near_edited and near_next (likeness of the text's fingerprint to these two).

    A null text is empty. Empty texts have an empty fingerprint, which is like another empty one (1) and nothing else (0).
    A single row is its own successor. Other columns of docs play no part.
    """
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        for block in _rows(batches):
            texts, nexts = [a[3] for a, _ in block], [b[3] for _, b in block]
            changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
            own, new = fingerprints(texts), fingerprints(changed)
            follows = [own[i + 1] if i + 1 < len(block) and block[i + 1][0] is block[i][1] else fingerprints([nexts[i]])[0] for i in range(len(block))]
            columns = [[a[2] for a, _ in block], list(map(len, texts)), changed, own, new, list(map(likeness, own, new)), list(map(likeness, own, follows))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], strict=True)], names=names)

    types = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs, text, doc_id).mapInArrow(tidied(run), types)
