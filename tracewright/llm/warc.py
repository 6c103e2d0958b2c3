"""WARC archives with one Zstandard dictionary each.

A task gathers records until it holds ARCHIVE_BYTES, trains a dictionary on a sample of them of bounded size, and writes an
archive: the dictionary in a leading skippable frame, then every record as a frame of its own. Archives go to the shared
folder under a name of their own for each attempt, and the manifest names those that count, so lost tasks are simply run
again. Any record can be read alone with the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged

#: Bytes of payloads in an archive; of records that a dictionary is trained on, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 64 << 10
LEVEL = 6
#: Stored bytes that a reading task is meant to take; there are at least READERS tasks for each core, if there are archives.
READ_BYTES, READERS = 64 << 20, 2
#: Fixed values of the format: the skippable frame's magic number, and the profile of a record that repeats a payload.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _urn(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def record(key: str, url: str | None, payload: bytes, sha1: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; one that refers to another holds only the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", _urn(key)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else urllib.parse.quote(c) for c in url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"),
        ("X-Page-ID", key),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page-ID", refers_to)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def dictionary(records: list[bytes]):
    """Trained on records up to SAMPLE_BYTES, taken evenly over all; where there are too few to train, their raw bytes."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [x[:SAMPLE_BYTES] for x in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, threads=0)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    import zstandard

    held = dictionary(records)
    raw = held.as_bytes()
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(compress.compress, records)])


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    data = b""
    while data or (data := stream.read(1 << 20)):
        one, parts = context.decompressobj(), []
        while not one.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(data))
            data = one.unused_data
        yield b"".join(parts)


def _located(spark: SparkSession, folder: str) -> str:
    """folder with the scheme that Spark reads it by: a bare name lies on its default file system."""
    if urllib.parse.urlparse(folder).scheme:
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/") + "/" + folder.lstrip("/") if not default.startswith("file:") else f"file://{folder}"


def _store(folder: str):
    """The file system of a located folder, and the folder's name in it."""
    from pyarrow import fs

    uri = "file://" + folder[5:] if folder.startswith("file:") and "://" not in folder else folder
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def _writer(folder: str):
    def run(batches):
        held, size = [], 0

        def close():
            store, root = _store(folder)
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(held)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:  # the name alone would have it compressed again
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([len(data)], pa.int64())], names=["archive", "n_records", "raw_bytes", "stored_bytes"])

        for batch in batches:
            for key, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(key, url, payload.encode(), bytes.fromhex(sha1), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def _reader(folder: str):
    schema = pa.schema([("page_key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_key", pa.string()), ("payload", pa.binary())])

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in read_archive(stream):
                        fields, http, payload = parse(data)
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        whole = fields["WARC-Type"] == "response"
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
                        if whole and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
                            raise ValueError(f"the payload of page {fields['X-Page-ID']} in {name} isn't what its record says")
                        rows.append((fields["X-Page-ID"], fields["WARC-Target-URI"], fields["WARC-Type"], length, digest, fields.get("X-Refers-To-Page-ID"), payload if whole else None))
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> tuple[str, DataFrame]:
    """Writes an archive record per row of pages and gives (folder, manifest of archive, n_records, raw_bytes, stored_bytes).

    Of rows with equal payloads of at least `least` bytes that with the largest page_id is a response and the others refer
    to it; all smaller ones are responses. A null html is an empty payload. Rows that repeat a page_id are each written; if
    the largest is repeated, all its rows are responses. A null page_id is written as an empty id. Other columns of pages
    play no part. folder defaults to a new one in the shared folder.
    """
    import uuid as _uuid

    spark = pages.sparkSession
    folder = _located(spark, folder or f"{shared_dir(spark)}/warc-{_uuid.uuid4().hex}")
    store, root = _store(folder)
    store.create_dir(root)
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= least
    keys = rows.filter(large).select("id", "sha1")
    last = staged(keys.groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha1", "last"), "payloads")
    repeats = staged(keys.join(last, "sha1").filter(~F.col("id").eqNullSafe(F.col("last"))).select("id", "sha1", "last").distinct(), "revisits")
    few = repeats.count() <= 1_000_000
    rows = rows.join(F.broadcast(repeats) if few else repeats, ["id", "sha1"], "left")
    written = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")), "url", "html", "sha1", F.col("last").cast("string")).mapInArrow(_writer(folder), "archive string, n_records long, raw_bytes long, stored_bytes long")
    return folder, staged(written, "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_key, url, record_type, payload_bytes, payload_digest (hex SHA-1 of the full payload), refers_to_key and payload
    (null for a revisit) of every record. A response's length and digest are taken from the payload that was read; one that differs
    from what its record says is a ValueError. Archives are dealt evenly to as many tasks as their stored bytes ask for. An empty
    manifest gives no rows."""
    spark = manifest.sparkSession
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("stored_bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(READERS * spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))))
    each = manifest.select("archive").repartition(tasks)
    return each.mapInArrow(_reader(_located(spark, folder)), "page_key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to_key string, payload binary")
