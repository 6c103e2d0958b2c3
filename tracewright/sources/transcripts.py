"""Transcripts: directories of JSONL files, a record per line, each located by its bytes."""

from __future__ import annotations

import hashlib
import re
import urllib.parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(reader, path: str, glob: str) -> DataFrame:
    lines = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.col("_metadata.file_size").alias("file_size"))


def read_transcripts(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, split, seq, value, file_size of every line of every file below path; seq orders the lines of a split."""
    return _lines(spark.read, path, glob).withColumn("seq", F.monotonically_increasing_id())


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "\r$", "")


def locate_records(lines: DataFrame) -> DataFrame:
    """file, source_position, byte_offset, byte_length (separator included), record_sha256, value, is_terminated.

    lines: as read_transcripts gives them, or a batch of stream_transcripts. Empty lines take up bytes but no position. Offsets are summed in two steps, over the splits of a file and within a
    split, so that no window holds a whole file.
    """
    lines = lines if "seq" in lines.columns else lines.withColumn("seq", F.monotonically_increasing_id())
    rows = lines.withColumns({"__bytes": (F.octet_length("value") + 1).cast("long"), "__record": (_bare(F.col("value")) != "").cast("long")})
    totals = rows.groupBy("file", "split").agg(F.sum("__bytes").alias("b"), F.sum("__record").alias("r"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "split", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("__r"))
    within = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals, ["file", "split"])
    rows = rows.withColumns({"byte_offset": F.col("__b") + F.coalesce(F.sum("__bytes").over(within), F.lit(0)), "source_position": F.col("__r") + F.coalesce(F.sum("__record").over(within), F.lit(0))})
    ended = F.col("byte_offset") + F.col("__bytes") <= F.col("file_size")
    rows = rows.filter("__record = 1").withColumn("is_terminated", ended)
    whole = F.when(F.col("is_terminated"), F.concat(F.col("value").cast("binary"), F.lit(b"\n"))).otherwise(F.col("value").cast("binary"))
    return rows.select("file", "source_position", "byte_offset", (F.col("__bytes") - F.when(F.col("is_terminated"), 0).otherwise(1)).alias("byte_length"), F.sha2(whole, 256).alias("record_sha256"), "value", "is_terminated")


def terminality(records: DataFrame) -> DataFrame:
    """records with is_terminal: an unterminated last line is still being written, unless its file is archived."""
    return records.withColumn("is_terminal", F.col("is_terminated") | F.col("file").rlike(r"/archived_sessions/[^/]+$"))


def classify_record(value: Column) -> Column:
    """structured (JSON), malformed (readable text that isn't), or uninspectable (not UTF-8, whether or not it parses)."""
    return F.when(~F.is_valid_utf8(value), "uninspectable").when(F.try_parse_json(value).isNotNull(), "structured").otherwise("malformed")


def resolve_session_identity(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, external_session_id, child_id), rejects of (file, reason)) by each file's first session_meta record.

    A file is a child's iff its source names a spawning thread. Files without such a record or id, or whose later records
    contradict it, are rejected alone.
    """
    v = F.try_parse_json(F.when(F.is_valid_utf8("value"), F.col("value")))
    text = lambda path: F.try_variant_get(F.col("v"), path, "string")
    metas = records.withColumn("v", v).filter(F.try_variant_get(F.col("v"), "$.type", "string") == "session_meta")
    child = F.try_variant_get(F.col("v"), "$.payload.source.subagent.thread_spawn", "variant").isNotNull()
    metas = metas.select("file", "source_position", F.coalesce(text("$.payload.session_id"), text("$.payload.id")).alias("external_session_id"), F.when(child, text("$.payload.id")).alias("child_id"))
    who = F.struct("external_session_id", "child_id")
    found = metas.groupBy("file").agg(F.min_by(who, "source_position").alias("w"), F.count_distinct(F.to_json(who)).alias("n"))
    rows = records.select("file").distinct().join(found, "file", "left")
    reason = F.when(F.col("w").isNull(), "no_session_meta").when(F.col("w.external_session_id").isNull(), "no_session_id").when(F.col("n") > 1, "contradictory_session_meta")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select("file", "w.external_session_id", "w.child_id"), rows.filter("reason is not null").select("file", "reason")


def duplicate_transcripts(identities: DataFrame) -> DataFrame:
    """Identities that several files claim, with the files."""
    return identities.groupBy("external_session_id", "child_id").agg(F.sort_array(F.collect_list("file")).alias("files")).filter(F.size("files") > 1)


def stream_transcripts(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, split, value and file_size of finished files as they arrive: each micro-batch holds whole files, so that
    locate_records and what follows it can be applied in foreachBatch (growing files: incremental_file_tail)."""
    return _lines(spark.readStream, path, glob)


def incremental_file_tail(spark: SparkSession, path: str, checkpoints: DataFrame, glob: str = "*.jsonl") -> DataFrame:
    """Terminal records after each file's verified_length, as locate_records gives them.

    checkpoints: file, verified_length and, if positions are to go on from there, verified_records. Files are listed without
    being read; one that hasn't grown is not opened, and one that has is read from its verified length on.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), F.col("length").alias("file_size"))
    count = F.col("verified_records") if "verified_records" in checkpoints.columns else F.lit(0)
    known = checkpoints.select("file", "verified_length", count.cast("long").alias("verified_records"))
    grown = listed.join(known, "file", "left").select("file", "file_size", F.coalesce("verified_length", F.lit(0)).cast("long").alias("begin"), F.coalesce("verified_records", F.lit(0)).alias("n"))
    grown = grown.filter("file_size > begin").repartition("file")
    types = "file string, source_position long, byte_offset long, byte_length long, record_sha256 string, value binary, is_terminated boolean"
    rows = grown.mapInArrow(_tails, types).withColumn("value", F.col("value").cast("string"))
    return terminality(rows).filter("is_terminal")


def _tails(batches):
    """Records of files (file, file_size, begin, n) from byte `begin` on, in batches of a few MB."""
    from pyarrow import fs

    names = ["file", "source_position", "byte_offset", "byte_length", "record_sha256", "value", "is_terminated"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        for file, size, begin, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", urllib.parse.unquote(file)))
            rows, held, at, left = [], 0, begin, size - begin
            with store.open_input_file(place) as f:
                f.seek(begin)
                rest = b""
                while left or rest:
                    data = f.read(min(left, 1 << 20)) if left else b""
                    left -= len(data)
                    whole = rest + data
                    lines = whole.split(b"\n")
                    rest = lines.pop()
                    ended = [True] * len(lines)
                    if not left and rest:
                        lines.append(rest)
                        ended.append(False)
                        rest = b""
                    for line, done in zip(lines, ended, strict=True):
                        length = len(line) + done
                        if line.removesuffix(b"\r"):
                            rows.append((file, n, at, length, hashlib.sha256(line + b"\n" * done).hexdigest(), line, done))
                            n += 1
                            held += length
                        at += length
                    if held >= 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)
