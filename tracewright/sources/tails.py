"""Growing transcript files: verified prefixes, tails that several tasks read, and a streaming source over byte ranges.

A checkpoint holds each file's verified length and records, and a digest of every block of its verified prefix. Blocks are
verified and tails are read by byte range, so that no file is one task. A prefix that changed stops its file alone, and so
does a file that can't be read.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a prefix that one digest stands for, and bytes of a file that one task reads.
BLOCK, RANGE = 1 << 20, 8 << 20
PREFIX_CHANGED, UNREADABLE = "verified_prefix_changed", "unreadable"
MARKS = "file string, verified_length long, verified_records long"
DIGESTS = "file string, block_no long, length long, sha256 string"
_RECORDS = pa.schema([("file", pa.string()), ("range_no", pa.int64()), ("n", pa.int64()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("record_sha256", pa.string()), ("value", pa.binary()), ("is_terminated", pa.bool_()), ("fault", pa.string())])
_RECORD_TYPES = "file string, range_no long, n long, byte_offset long, byte_length long, record_sha256 string, value binary, is_terminated boolean, fault string"


def _opened(file: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", urllib.parse.unquote(file)))
    return store.open_input_file(place)


def lines_from(f, begin: int, start: int, end: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, whether a line feed ends it) of the lines that begin in [start, end) of a file of which size bytes count;
    a line begins at begin. What lies behind end is read only to finish the last line."""
    at = start
    if start > begin:
        f.seek(start - 1)
        at = start - 1
    else:
        f.seek(start)
    skip = start > begin  # up to the first line feed, the text belongs to a line that begins before
    parts: list[bytes] = []
    first = at
    while at < size:
        data = f.read(min(1 << 20, size - at))
        if not data:
            break
        pos = 0
        while (cut := data.find(b"\n", pos)) >= 0:
            line = b"".join([*parts, data[pos:cut]])
            parts, pos = [], cut + 1
            if not skip:
                yield first, line, True
            skip = False
            first = at + pos
            if first >= end:
                return
        if pos < len(data):
            parts.append(data[pos:] if not skip else b"")
        at += len(data)
    if parts and not skip and first < end and (line := b"".join(parts)):
        yield first, line, False


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("file_size"))


def _dealt(parts: DataFrame, per_task: int = 1) -> DataFrame:
    """parts dealt to tasks by their number, as rows are tiny but what they name is not; a table counted first."""
    return parts.repartition(max(1, min(10_000, -(-parts.count() // per_task))))


def block_digests(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """DIGESTS of the first `length` bytes of files (file, length); a file that can't be read has null digests."""
    each = ranges.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block_no"))
    each = each.select("file", "block_no", F.least(F.lit(block).cast("long"), F.col("length") - F.col("block_no") * block).alias("length"))

    def run(batches):
        for batch in batches:
            out = []
            for file, k, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with _opened(file) as f:
                        f.seek(k * block)
                        data = f.read(length)
                    out.append(hashlib.sha256(data).hexdigest() if len(data) == length else None)
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["file", "block_no", "length", "sha256"])

    return _dealt(each, max(1, RANGE // block)).mapInArrow(run, DIGESTS)


def prefix_stops(spark: SparkSession, marks: DataFrame, digests: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, code of the files whose verified prefix no longer stands: a block of it differs, is missing, or can't be read."""
    now = block_digests(marks.select("file", F.col("verified_length").alias("length")), block).select("file", "block_no", F.col("sha256").alias("__now"))
    # the last block was partial when it was verified, and is taken to the same length again
    return digests.join(now, ["file", "block_no"], "left").filter(~F.col("sha256").eqNullSafe(F.col("__now"))).select("file", F.lit(PREFIX_CHANGED).alias("code")).distinct()


def _tail_rows(values: bool):
    def run(batches):
        rows: list[tuple] = []
        held = 0
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
        for batch in batches:
            for file, size, begin, k, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                try:
                    with _opened(file) as f:
                        for at, line, done in lines_from(f, begin, start, end, size):
                            if line.removesuffix(b"\r"):
                                rows.append((file, k, n, at, len(line) + done, hashlib.sha256(line + b"\n" * done).hexdigest() if values else None, line if values else None, done, None))
                                n += 1
                                held += len(line) if values else 8
                            if held >= 4 << 20:
                                yield pack(rows)
                                rows, held = [], 0
                except OSError as e:
                    rows.append((file, k, None, None, None, None, None, None, type(e).__name__))
        if rows:
            yield pack(rows)

    return run


def verified_tail(spark: SparkSession, path: str, marks: DataFrame, digests: DataFrame, glob: str = "*.jsonl", block: int = BLOCK, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(records, stops): what has come behind each file's verified prefix, and the files (file, code) that give nothing because
    their prefix changed or they can't be read.

    marks and digests are a checkpoint (MARKS, DIGESTS); files without a mark are read from their start. records: file,
    source_position, byte_offset, byte_length, record_sha256, value, is_terminated. Empty lines take up bytes but no position.
    A file is read by ranges: positions are counted by range first, then within it.
    """
    stops = prefix_stops(spark, marks, digests, block)
    grown = _listed(spark, path, glob).join(marks, "file", "left").select("file", "file_size", F.coalesce("verified_length", F.lit(0)).cast("long").alias("begin"), F.coalesce("verified_records", F.lit(0)).cast("long").alias("seen"))
    short = grown.filter("file_size < begin").select("file", F.lit(PREFIX_CHANGED).alias("code"))
    stops = stops.unionByName(short).distinct()
    grown = grown.filter("file_size > begin").join(stops.select("file"), "file", "left_anti")
    ranges = grown.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("file_size") - F.col("begin") - 1) / size))))
    ranges = ranges.select("file", "file_size", "begin", "range_no", (F.col("begin") + F.col("range_no") * size).alias("start"), F.least("file_size", F.col("begin") + (F.col("range_no") + 1) * size).alias("end"))
    ranges = _dealt(ranges)
    counted = ranges.mapInArrow(_tail_rows(False), _RECORD_TYPES).groupBy("file", "range_no").agg(F.count("byte_offset").alias("records"), F.max("fault").alias("fault"))
    before = F.coalesce(F.sum("records").over(Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    faults = counted.filter("fault is not null").select("file", F.lit(UNREADABLE).alias("code")).distinct()
    counted = counted.withColumn("__before", before).drop("records", "fault")
    rows = ranges.mapInArrow(_tail_rows(True), _RECORD_TYPES).filter("fault is null").join(counted, ["file", "range_no"]).join(grown.select("file", "seen"), "file").join(faults.select("file"), "file", "left_anti")
    records = rows.select("file", (F.col("seen") + F.col("__before") + F.col("n")).alias("source_position"), "byte_offset", "byte_length", "record_sha256", F.col("value").cast("string").alias("value"), "is_terminated")
    return records, stops.unionByName(faults)


def next_checkpoint(records: DataFrame, marks: DataFrame, digests: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(marks, digests) after the terminated records of a tail were taken in. Digests of whole blocks are kept, only blocks from
    the last partial one on are read."""
    ends = records.filter("is_terminated").groupBy("file").agg(F.max(F.col("byte_offset") + F.col("byte_length")).alias("__length"), F.max("source_position").alias("__last"))
    both = marks.join(ends, "file", "full").select("file", F.coalesce("__length", "verified_length").alias("verified_length"), F.coalesce(F.col("__last") + 1, "verified_records").alias("verified_records"), F.col("__length").isNotNull().alias("__grown"))
    grown = both.filter("__grown").select("file", F.col("verified_length").alias("length"))
    kept = digests.join(grown.select("file"), "file", "left_anti")
    whole = digests.join(grown.select("file"), "file", "left_semi").filter(F.col("length") == block)
    new = block_digests(grown, block).join(whole.select("file", "block_no"), ["file", "block_no"], "left_anti")
    return both.drop("__grown"), kept.unionByName(whole).unionByName(new)


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, start: int, end: int, size: int):
        self.file, self.begin, self.start, self.end, self.size = file, begin, start, end, size


class _TailReader(DataSourceStreamReader):
    """Offsets are the lengths of all files up to their last line feed; partitions are byte ranges between two offsets."""

    def __init__(self, options: dict):
        self.path, self.glob, self.range = options["path"], options.get("glob", "*.jsonl"), int(options.get("rangebytes", RANGE))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        import fnmatch

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", urllib.parse.unquote(self.path)) if ":" in self.path else f"file://{self.path}")
        scheme = self.path.split(root)[0] if root in self.path else "file://"
        out = {}
        for x in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob):
                out[f"{scheme or 'file://'}{x.path}"] = self._complete(store, x)
        return {k: v for k, v in out.items() if v}

    def _complete(self, store, x) -> int:
        """A file's length up to its last line feed; an unreadable one counts whole, so that its fault becomes a row."""
        before = self.known.get(x.path, (0, 0))
        if before[0] == x.size:
            return before[1]
        end = x.size
        try:
            with store.open_input_file(x.path) as f:
                at = x.size
                while at > before[1]:
                    step = min(1 << 16, at - before[1])
                    f.seek(at - step)
                    if (cut := f.read(step).rfind(b"\n")) >= 0:
                        end = at - step + cut + 1
                        break
                    at -= step
                else:
                    end = before[1]
        except OSError:
            pass
        self.known[x.path] = (x.size, end)
        return end

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(file, a, at, min(b, at + self.range), b) for file, b in sorted(end.items()) if b > (a := start.get(file, 0)) for at in range(a, b, self.range)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        p = partition
        try:
            with _opened(p.file) as f:
                for at, line, done in lines_from(f, p.begin, p.start, p.end, p.size):
                    if line.removesuffix(b"\r"):
                        yield p.file, at, len(line) + done, hashlib.sha256(line + b"\n" * done).hexdigest(), line.removesuffix(b"\r").decode("utf-8", "replace"), None
        except OSError as e:
            yield p.file, p.start, None, None, None, f"{UNREADABLE}: {type(e).__name__}"

    def commit(self, end: dict) -> None:
        pass


class TranscriptTails(DataSource):
    """The source `transcript_tails`: whole lines of growing files below `path` as they come, each once; options glob and
    rangeBytes. A file that can't be read gives a row with a fault and doesn't stop the others."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tails"

    def schema(self) -> str:
        return "file string, byte_offset long, byte_length long, record_sha256 string, value string, fault string"

    def streamReader(self, schema) -> _TailReader:
        return _TailReader({k.lower(): v for k, v in self.options.items()})


def stream_tails(spark: SparkSession, path: str, glob: str = "*.jsonl", range_bytes: int = RANGE) -> DataFrame:
    """A stream of the records of growing files (see TranscriptTails); rows with a fault are for the caller to set aside."""
    spark.dataSource.register(TranscriptTails)
    return spark.readStream.format("transcript_tails").option("glob", glob).option("rangeBytes", str(range_bytes)).option("path", path).load()
