import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.sources import tails


def lines(data, begin=0):
    at, out, n = begin, [], 0
    for raw in data[begin:].split(b"\n"):
        done = at + len(raw) < len(data)
        if raw.removesuffix(b"\r"):
            out.append((n, at, len(raw) + done, raw, done))
            n += 1
        at += len(raw) + 1
    return out


def test_ranges_give_every_line_once():
    r = random.Random(0)
    for _ in range(300):
        data = b"".join(r.choice([b"", b"x", b"abc", b"long" * 5, b"\r"]) + r.choice([b"\n", b"\n", b""]) for _ in range(r.randrange(12)))
        begin = r.choice([0, *[i + 1 for i, c in enumerate(data) if c == 10]])
        size = r.randrange(1, 9)
        got = [x for a in range(begin, len(data), size) for x in tails.lines_from(io.BytesIO(data), begin, a, min(a + size, len(data)), len(data))]
        assert [(at, line, done) for at, line, done in got if line.removesuffix(b"\r")] == [(at, raw, done) for _, at, _, raw, done in lines(data, begin)]


def state(spark):
    return spark.createDataFrame([], tails.MARKS), spark.createDataFrame([], tails.DIGESTS)


def taken(spark, path, marks, digests):
    records, stops = tails.verified_tail(spark, str(path), marks, digests, block=16, size=16)
    new = [spark.createDataFrame(x.collect(), x.schema) for x in tails.next_checkpoint(records, marks, digests, 16)]
    rows = sorted((os.path.basename(r.file), r.source_position, r.byte_offset, r.byte_length, r.record_sha256, r.value, r.is_terminated) for r in records.collect())
    return rows, {os.path.basename(r.file): r.code for r in stops.collect()}, *new


def want(name, data, begin=0, before=0):
    return [(name, before + n, at, length, hashlib.sha256(raw + b"\n" * done).hexdigest(), raw.decode(), done) for n, at, length, raw, done in lines(data, begin)]


def test_verified_tails(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    first = {"a.jsonl": b'{"a":1}\n\n{"b":"' + b"x" * 60 + b'"}\n{"c":', "b.jsonl": b'{"k":1}\n{"k":2}\n{"k":3}\n'}
    a.write_bytes(first["a.jsonl"])
    b.write_bytes(first["b.jsonl"])
    rows, stops, marks, digests = taken(spark, tmp_path, *state(spark))
    assert rows == sorted(want("a.jsonl", first["a.jsonl"]) + want("b.jsonl", first["b.jsonl"])) and not stops
    assert {(os.path.basename(r.file), r.verified_records) for r in marks.collect()} == {("a.jsonl", 2), ("b.jsonl", 3)}
    # a grows, b doesn't
    grown = first["a.jsonl"] + b'2}\n{"d":3}\n'
    a.write_bytes(grown)
    rows, stops, marks, digests = taken(spark, tmp_path, marks, digests)
    begin = first["a.jsonl"].rindex(b"\n") + 1
    assert rows == want("a.jsonl", grown, begin, 2) and not stops
    # an edit of the same length within b's prefix, while a goes on; a new file comes
    b.write_bytes(first["b.jsonl"].replace(b"2", b"9") + b'{"k":4}\n')
    a.write_bytes(grown + b"more\n")
    (tmp_path / "c.jsonl").write_bytes(b"new\n")
    rows, stops, marks, digests = taken(spark, tmp_path, marks, digests)
    assert rows == sorted(want("a.jsonl", grown + b"more\n", len(grown), 4) + want("c.jsonl", b"new\n")) and stops == {"b.jsonl": tails.PREFIX_CHANGED}
    # a is cut
    a.write_bytes(grown[:10])
    rows, stops, *_ = taken(spark, tmp_path, marks, digests)
    assert rows == [] and stops == {"a.jsonl": tails.PREFIX_CHANGED, "b.jsonl": tails.PREFIX_CHANGED}


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    data = b"".join(b'{"n":%d}\n' % i for i in range(5000))
    (tmp_path / "big.jsonl").write_bytes(data)
    marks, digests = state(spark)
    records, _ = tails.verified_tail(spark, str(tmp_path), marks, digests, size=1024)
    got = records.orderBy("source_position").collect()
    assert [r.byte_offset for r in got] == [at for _, at, *_ in lines(data)] and [r.source_position for r in got] == list(range(5000))
    used = records.select(F.spark_partition_id()).count()
    ranges = tails._dealt(spark.range(40).select("id"))
    assert used == 5000 and ranges.rdd.getNumPartitions() == 40


@pytest.mark.skipif(os.geteuid() == 0 and not hasattr(os, "symlink"), reason="needs a file that can't be read")
def test_streams_of_growing_files(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    a = folder / "a.jsonl"

    def run():
        stream = tails.stream_tails(spark, str(folder), range_bytes=16)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(out)).awaitTermination()
        return sorted((os.path.basename(r.file), r.byte_offset, r.byte_length, r.value) for r in spark.read.parquet(str(out)).filter("fault is null").collect())

    first = b'{"a":1}\n{"b":"' + b"y" * 50 + b'"}\n{"unfinished'
    a.write_bytes(first)
    done = first.rindex(b"\n") + 1
    assert run() == [("a.jsonl", at, n, raw.decode()) for _, at, n, raw, _ in lines(first[:done])]
    os.symlink(tmp_path / "nowhere" / "gone.jsonl", folder / "dangling.jsonl")
    data = first + b' no more"}\r\n{"c":3}\n'
    a.write_bytes(data)
    (folder / "b.jsonl").write_bytes(b"b\n")
    want = [("a.jsonl", at, n, raw.removesuffix(b"\r").decode()) for _, at, n, raw, _ in lines(data)] + [("b.jsonl", 0, 2, "b")]
    assert run() == want
    assert run() == want


def test_a_file_that_cannot_be_read_is_a_row(tmp_path):
    reader = tails._TailReader({"path": str(tmp_path)})
    (tmp_path / "a.jsonl").write_bytes(b"x\n")
    parts = reader.partitions({}, {f"file://{tmp_path}/a.jsonl": 2, f"file://{tmp_path}/lost.jsonl": 5})
    rows = [row for p in parts for row in reader.read(p)]
    assert [(os.path.basename(r[0]), r[4], r[5]) for r in rows] == [("a.jsonl", "x", None), ("lost.jsonl", None, "unreadable: FileNotFoundError")]
