"""Packing with optimal length buckets.

One aggregation gives the histogram of lengths; dynamic programming over it picks the bucket boundaries of least padding,
and each bucket's documents are dealt into batches of at most `budget` tokens, padding included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: About so many documents of a bucket are numbered in one group.
GROUP_ROWS = 200_000


def words(text):
    """Number of runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_words of every row, written once: packing goes over the lengths three times, not over the texts."""
    return staged(docs.select(F.col(doc_id), words(F.col(text)).alias("n_words")), "lengths")


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most so many buckets with the least sum of (end - length), exactly; ties take the least index.

    cost(i, j) = length[j] * (documents from i to j), less a term that no choice changes. It meets the quadrangle
    inequality, so each layer is solved by divide and conquer over its monotone cuts, all ranges of a depth at once.
    """
    n = len(length)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    size = length.astype(np.int64)
    best = size * before[1:]
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo, hi, a, b = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            width = np.minimum(j, b) - a + 1
            start = np.cumsum(width) - width
            at = np.repeat(np.arange(len(j)), width)
            i = np.arange(len(at)) - (start - a)[at]
            value = np.where(i > 0, best[np.maximum(i - 1, 0)], 0) + size[j][at] * (before[j + 1][at] - before[i])
            new[j] = np.minimum.reduceat(value, start)
            least = np.flatnonzero(value == new[j][at])
            k = i[least[np.searchsorted(at[least], np.arange(len(j)))]]
            cut[j] = k
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        best = new
        cuts.append(cut)
    ends, j = [], n - 1
    for cut in reversed(cuts):
        ends.append(int(length[j]))
        j = int(cut[j]) - 1
        if j < 0:
            return ends[::-1]
    return [int(length[j]), *ends[::-1]]


def pack(docs: DataFrame, length, buckets: int = 16, budget: int = 16_384, order: str = "doc_id") -> DataFrame:
    """docs with pack_length, bucket (0 ..), bucket_length (what its documents are padded to), batch (0 .. in the bucket),
    slot (0 .. in the batch) and padding.

    length is a Column of tokens of a document, null as 0. Every row is placed once, repeated ones too; a document longer
    than the budget is a batch of its own; documents without tokens are packed with the shortest. Within a bucket, rows are
    numbered in groups of about GROUP_ROWS rows by a hash of `order` and length, in order of these two, and each group's
    numbers follow those of the groups before, so that only a bucket's last batch is left unfilled. Rows that tie in both
    are alike to the packing. Columns of docs with these names are replaced.
    """
    new = ["pack_length", "bucket", "bucket_length", "batch", "slot", "padding"]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in new]).withColumn("pack_length", F.greatest(F.coalesce(length, F.lit(0)).cast("long"), F.lit(0).cast("long")))
    found = rows.groupBy("pack_length").agg(F.count("*").alias("n")).toArrow().sort_by("pack_length")
    counts = found.column("n").to_numpy()
    ends = boundaries(found.column("pack_length").to_numpy(), counts, buckets) or [0]
    groups = max(1, -(-int(counts.sum()) // GROUP_ROWS))
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("pack_length") <= ends[k], F.lit(k)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_length", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1))
    rows = rows.withColumn("__group", F.pmod(F.xxhash64(F.col(order), "pack_length"), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("bucket", "__group").count()
    first = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("bucket", "__group", first.alias("__first"))
    place = F.col("__first") + F.row_number().over(Window.partitionBy("bucket", "__group").orderBy(F.col(order).asc_nulls_first(), "pack_length")) - 1
    each = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))), F.lit(1)).cast("long")
    return (
        rows.join(sizes, ["bucket", "__group"])
        .withColumn("__place", place)
        .withColumns({"batch": F.floor(F.col("__place") / each).cast("long"), "slot": F.pmod(F.col("__place"), each).cast("long"), "padding": F.col("bucket_length") - F.col("pack_length")})
        .drop("__group", "__first", "__place")
    )
