"""A stored inverted index: segments in buckets of their terms, tombstones, and compaction.

Postings are kept in blocks: a row holds a term's postings of many documents, those that were indexed together. Stored blocks are
packed (functions.packed) and not shuffled: each task sorts its own and writes them into the files of their buckets.

An append writes one segment, a deletion a list of tombstones that holds for all segments before it, and compaction one
segment of what is alive, in which blocks of a term that stand behind each other in a file are one. A manifest names the segments that count; each change writes a new one last, so that readers see a
change whole or not at all, and a change that broke off can be made again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed
from ..functions.staging import staged
from .ledger import _exists, bucket_of

#: Buckets of (namespace, lexeme); fixed when the index is first written.
BUCKETS = 64
POSTING = "namespace string, lexeme string, uuid string, positions array<int>"
BLOCK = "namespace string, lexeme string, ids array<string>, places array<array<int>>"
PACKED = f"namespace string, lexeme string, {packed.FIELDS}"
#: Bytes of packed tombstones up to which tasks are told them all; more are joined.
TOLD = 16 << 20
#: Tasks that write a segment, at most, for each that runs at once; a bucket gets a file of each.
TASKS = 2
#: Bytes of an index that a task of its compaction should read at least, if all cores have a task.
SHARE = 32 << 20
_MANIFEST, _TOMBSTONES, _BUCKET = "_manifest", "_tombstones", "bucket_no"


def segments(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The manifest's version and the segments that count; -1 and none for an index that isn't there."""
    if not _exists(spark, f"{path}/{_MANIFEST}"):
        return -1, []
    rows = spark.read.schema("segment int, version int").parquet(f"{path}/{_MANIFEST}")
    version = rows.agg(F.max("version")).first()[0]
    return version, sorted(r["segment"] for r in rows.filter(F.col("version") == version).filter("segment >= 0").collect())


def _publish(spark: SparkSession, path: str, version: int, live: list[int]) -> None:
    rows = spark.createDataFrame([(s,) for s in live] or [(-1,)], "segment int").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/{_MANIFEST}/version={version}")


def blocks(index: DataFrame) -> DataFrame:
    """Postings (namespace, lexeme, uuid, positions) as blocks of one document each."""
    return index.select("namespace", "lexeme", F.array("uuid").alias("ids"), F.array("positions").alias("places"))


def postings(found: DataFrame) -> DataFrame:
    """Blocks as a row for each posting: namespace, lexeme, uuid, positions."""
    return found.select("namespace", "lexeme", F.inline(F.arrays_zip("ids", "places"))).toDF("namespace", "lexeme", "uuid", "positions")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _merged(batch.column(0), batch.column(1), packed.postings_of(batch.column(2), batch.column(3)))


def _merged(namespace: pa.Array, lexeme: pa.Array, some: packed.Postings) -> pa.RecordBatch:
    """Packed blocks; those of a term that stand behind each other become one."""
    first = packed.runs(namespace, lexeme)
    n = np.diff(np.append(0, np.cumsum(some.n))[np.append(first, len(some.n))])
    keys = [x.take(pa.array(first)) for x in (namespace, lexeme)]
    return pa.RecordBatch.from_arrays([*keys, *packed.pack(some._replace(n=n))], names=["namespace", "lexeme", *packed.NAMES])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        namespace, lexeme, n, n_places, ids, names, places, *rest = batch.columns
        n, n_places = (x.to_numpy().astype(np.int64) for x in (n, n_places))
        counts, at = packed.unpack_places(n, n_places, places)
        lists = [packed.lists(n, packed.unpack_ids(n, ids, names).texts()), packed.lists(n, packed.lists(counts, pa.array(at.astype(np.int32))))]
        yield pa.RecordBatch.from_arrays([namespace, lexeme, *lists, *rest], names=["namespace", "lexeme", "ids", "places", *batch.schema.names[7:]])


def pack(found: DataFrame) -> DataFrame:
    """Blocks as they are stored: namespace, lexeme, n_ids, n_places and the packed ids and places."""
    texts = F.col("ids").cast("array<string>").alias("ids"), F.col("places").cast("array<array<int>>").alias("places")
    return found.select("namespace", "lexeme", *texts).mapInArrow(_packed, PACKED)


def unpack(stored: DataFrame) -> DataFrame:
    """Packed blocks with lists of ids and places; a segment's number stays."""
    return stored.mapInArrow(_unpacked, f"{BLOCK}, segment int" if "segment" in stored.columns else BLOCK)


def append_segment(index: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Adds postings (namespace, lexeme, uuid, positions; see search.build_index), or blocks of them (search.build_blocks), packed
    or not, as a segment, and gives its number."""
    spark = index.sparkSession
    version, live = segments(spark, path)
    if "n_ids" not in index.columns:
        index = pack(index if "ids" in index.columns else blocks(index))
    _write(index, path, version + 1, buckets, TASKS * spark.sparkContext.defaultParallelism)
    _publish(spark, path, version + 1, [*live, version + 1])
    return version + 1


def _write(stored: DataFrame, path: str, segment: int, buckets: int, tasks: int) -> None:
    rows = stored.withColumn(_BUCKET, bucket_of(["namespace", "lexeme"], buckets)).coalesce(tasks)
    rows.sortWithinPartitions(_BUCKET, "namespace", "lexeme").write.mode("overwrite").option("compression", "zstd").partitionBy(_BUCKET).parquet(f"{path}/segment={segment}")


def delete_documents(uuids: DataFrame, path: str) -> None:
    """From now on the documents (uuid) of all segments so far are gone; later segments may hold them anew."""
    spark = uuids.sparkSession
    version, live = segments(spark, path)
    uuids.select(F.col("uuid").cast("string").alias("uuid")).distinct().write.mode("overwrite").parquet(f"{path}/{_TOMBSTONES}/since={version + 1}")
    _publish(spark, path, version + 1, live)


def _tombstones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (uuid, since): since and the packed uuids, a row for each since and batch."""
    for batch in batches:
        uuid, since = batch.columns
        first = packed.runs(since)
        ids, names = packed.pack_ids(np.diff(first, append=len(since)), packed.ids_of(uuid))
        yield pa.RecordBatch.from_arrays([since.take(pa.array(first)), pa.array(np.diff(first, append=len(since)).astype(np.int32)), ids, names], names=["since", "n_ids", "ids", "names"])


def _living(told: list[tuple[int, int, bytes, bytes | None]]):
    """Of packed blocks with their segment: what no tombstone (of that segment or later ones) concerns. Blocks of a term that stand
    behind each other become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since, n, ids, names = (list(x) for x in zip(*told)) if told else ([], [], [], [])
        since, n = np.repeat(np.array(since, np.int32), n), np.array(n, np.int64)
        dead = packed.unpack_ids(n, pa.array(ids, pa.binary()), pa.array(names, pa.binary()))
        order = np.argsort(dead.numbers)
        numbers, until = dead.numbers[order], since[~dead.named][order]
        named_until = np.append(since[dead.named], -1)

        for batch in batches:
            namespace, lexeme, n_ids, n_places, ids, names, places, segment = batch.columns
            n, n_places = (x.to_numpy().astype(np.int64) for x in (n_ids, n_places))
            held = packed.unpack_ids(n, ids, names)
            last = np.full(len(held.named), -1, np.int32)
            if len(numbers):
                at = np.minimum(np.searchsorted(numbers, held.numbers), len(numbers) - 1)
                last[~held.named] = np.where(numbers[at] == held.numbers, until[at], -1)
            if len(held.names):
                last[held.named] = named_until[pc.fill_null(pc.index_in(held.names, dead.names), len(dead.names)).to_numpy(zero_copy_only=False)]
            of = np.repeat(np.arange(len(n)), n)
            keep = last < segment.to_numpy()[of]
            counts, at = packed.unpack_places(n, n_places, places)
            left = np.bincount(of[keep], minlength=len(n))
            rows = pa.array(np.flatnonzero(left))
            yield _merged(namespace.take(rows), lexeme.take(rows), packed.Postings(left[left > 0], held.take(keep), counts[keep], at[np.repeat(keep, counts)]))

    return run


def open_packed(spark: SparkSession, path: str, terms: DataFrame | None = None, spaces: DataFrame | None = None, buckets: int = BUCKETS, merge: bool = False) -> DataFrame:
    """open_index in packed blocks. merge: blocks of a term that stand behind each other become one even if nothing is dead."""
    version, live = segments(spark, path)
    if not live:
        return spark.createDataFrame([], PACKED)
    rows = spark.read.schema(f"{PACKED}, segment int, {_BUCKET} int").parquet(path).filter(F.col("segment").isin(live))
    if terms is not None and spaces is not None:
        wanted = terms.select("query_id", "lexeme").join(spaces.select("query_id", "namespace"), "query_id").select("namespace", "lexeme", bucket_of(["namespace", "lexeme"], buckets).alias(_BUCKET)).distinct()
        rows = rows.filter(F.col(_BUCKET).isin([r[0] for r in wanted.select(_BUCKET).distinct().collect()])).join(wanted.drop(_BUCKET), ["namespace", "lexeme"], "left_semi")
    rows = rows.select("namespace", "lexeme", *packed.NAMES, "segment")
    if _exists(spark, f"{path}/{_TOMBSTONES}"):
        # a tombstone that a broken-off deletion left behind has no manifest of its version yet, and one that is older than all
        # segments concerns none
        gone = spark.read.schema("uuid string, since int").parquet(f"{path}/{_TOMBSTONES}").filter(F.col("since").between(min(live), version)).groupBy("uuid").agg(F.max("since").alias("since"))
        lists = staged(gone.sortWithinPartitions("since", F.expr("try_cast(uuid AS bigint)")).mapInArrow(_tombstones, "since int, n_ids int, ids binary, names binary"), "tombstones")
        size = lists.agg(F.sum(F.octet_length("ids") + F.coalesce(F.octet_length("names"), F.lit(0)))).first()[0] or 0
        if 0 < size <= TOLD:
            return rows.mapInArrow(_living([tuple(r) for r in lists.collect()]), PACKED)
        if size:
            each = unpack(rows).select("segment", "namespace", "lexeme", F.inline(F.arrays_zip("ids", "places"))).withColumnsRenamed({"ids": "uuid", "places": "positions"})
            alive = each.join(gone.hint("shuffle_hash"), "uuid", "left").filter(F.col("since").isNull() | (F.col("segment") > F.col("since")))
            return pack(blocks(alive.sortWithinPartitions("namespace", "lexeme")))
    return rows.mapInArrow(_living([]), PACKED) if merge else rows.drop("segment")


def open_blocks(spark: SparkSession, path: str, terms: DataFrame | None = None, spaces: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """open_index in blocks."""
    return unpack(open_packed(spark, path, terms, spaces, buckets))


def open_index(spark: SparkSession, path: str, terms: DataFrame | None = None, spaces: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The living postings. With terms (query_id, lexeme) and spaces (query_id, namespace), only the buckets that these fall into
    are read (their numbers are looked up first, and are partitions of the files), and only these terms' blocks opened."""
    return postings(open_blocks(spark, path, terms, spaces, buckets))


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Merges all that lives to one segment, and gives its number; files of older segments are no longer read."""
    version, live = segments(spark, path)
    cores = spark.sparkContext.defaultParallelism
    tasks = min(TASKS * cores, max(cores, sum(_size(spark, f"{path}/segment={s}") for s in live) // SHARE))
    _write(open_packed(spark, path, merge=True), path, version + 1, buckets, tasks)
    _publish(spark, path, version + 1, [version + 1])
    return version + 1
