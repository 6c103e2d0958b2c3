import hashlib
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import chat, language_id, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_warc_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    r = random.Random(size)
    body = lambda n: "".join(r.choice("<p>é😀 xyz\r\n") for _ in range(n))
    big = [body(1500) for _ in range(4)]
    pages = [(k, f"http://x.example/{k}\n ü", r.choice(big + ["", "short", body(900)]), "x") for k in range(60)]
    pages += [(60, None, None, "x"), (61, "u", "x" * 1000, "x"), (62, "u", "x" * 1000, "x"), (63, "u", "y" * 999, "x"), (64, "u", "y" * 999, "x"), (64, "u", "z" * 1000, "x"), (64, "u", "z" * 1000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string").repartition(3)
    folder, manifest = warc.write_archives(df)
    got = warc.read_archives(manifest, folder).collect()
    reader = warc.read_archives(manifest, folder)
    assert reader.rdd.getNumPartitions() == min(manifest.count(), 2 * spark.sparkContext.defaultParallelism)
    assert {x.url for x in got if x.page_key in ("0", "1")} == {"http://x.example/0%0A%20ü", "http://x.example/1%0A%20ü"}
    assert len(got) == len(pages) == manifest.agg(F.sum("n_records")).first()[0]
    payload = lambda h: (h or "").encode()
    last = {}
    for k, _, h, _ in pages:
        if len(payload(h)) >= 1000:
            last[h] = max(last.get(h, -1), k)
    want = sorted((str(k), len(payload(h)), hashlib.sha1(payload(h)).hexdigest(), "revisit" if last.get(h, k) != k else "response", str(last[h]) if last.get(h, k) != k else "") for k, _, h, _ in pages)
    assert sorted((x.page_key, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to_key or "") for x in got) == want
    assert all((x.payload is None) == (x.record_type == "revisit") and (x.payload is None or hashlib.sha1(x.payload).hexdigest() == x.payload_digest) for x in got)
    store, root = warc._store(folder)
    for x in manifest.collect():
        data = store.open_input_stream(f"{root}/{x.archive}", compression=None).read()
        assert data[:4] == b"\x5d\x2a\x4d\x18" and len(list(warc.read_archive(io.BytesIO(data)))) == x.n_records


def test_a_page_larger_than_an_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 16)
    r = random.Random(1)
    huge = "".join(r.choice("abcdefgh é<>") for _ in range(1 << 20))
    pages = [(1, "u", huge), (2, "u", "small"), (3, "u", huge), (4, "u", huge[:-1]), (5, "u", "small" * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    folder, manifest = warc.write_archives(df)
    got = {x.page_key: x for x in warc.read_archives(manifest, folder).collect()}
    assert {k: x.payload_digest for k, x in got.items()} == {str(k): hashlib.sha1(h.encode()).hexdigest() for k, _, h in pages}
    assert {k: x.record_type for k, x in got.items() if x.record_type == "revisit"} == {"1": "revisit"} and got["1"].refers_to_key == "3"


def test_warc_folder_lies_where_spark_looks(spark, monkeypatch):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert warc._located(spark, "/a/b") == "file:///a/b" and warc._located(spark, "s3a://x/y") == "s3a://x/y"
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://name:8020/")
    try:
        assert warc._located(spark, "/a/b") == "hdfs://name:8020/a/b"
    finally:
        conf.set("fs.defaultFS", old)


def test_a_damaged_payload_is_told(spark, tmp_path, monkeypatch):
    plain = warc.record
    monkeypatch.setattr(warc, "record", lambda key, url, payload, sha1, refers_to: plain(key, url, payload.replace(b"good", b"evil"), sha1, refers_to))
    pages = [warc.record("1", "u", b"all is good", hashlib.sha1(b"all is good").digest(), None)]
    (tmp_path / "x.warc.zst").write_bytes(warc.archive(pages))
    read = warc._reader(f"file://{tmp_path}")
    with pytest.raises(ValueError, match="page 1"):
        list(read(iter([pa.RecordBatch.from_arrays([pa.array(["x.warc.zst"])], names=["archive"])])))


def test_files_begin_with_their_dictionary_and_hold_a_frame_a_record(tmp_path):
    pages = [(str(i), "u", f"page {i} " * 90, hashlib.sha1((f"page {i} " * 90).encode()).hexdigest(), None) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pages)], names=["id", "url", "html", "sha1", "last"])
    made = [b.to_pylist()[0] for b in warc._writer(f"file://{tmp_path}")(iter([batch]))]
    data = (tmp_path / made[0]["archive"]).read_bytes()
    assert len(data) == made[0]["stored_bytes"] and data[:4] == warc.SKIPPABLE.to_bytes(4, "little")
    assert len(list(warc.read_archive(io.BytesIO(data)))) == made[0]["n_records"] == 40


def test_warc_without_pages(spark):
    folder, manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(manifest, folder).collect() == []


def test_chat_equals_brute_force(spark):
    r = random.Random(4)
    talks = {}
    for c in range(60):
        base = [(r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None])) for _ in range(r.randrange(1, 7))]
        talks[c] = base if c < 20 else (talks[r.randrange(c)] + base)[: r.randrange(1, 9)]
    talks[60] = talks[61] = [("user", f"long {k}") for k in range(30)]
    talks[62] = talks[60][:-1]
    rows = [(c, t, *turn, "x") for c, ts in talks.items() for t, turn in enumerate(ts)] + [(None, 0, "user", "lost", "x"), (60, 0, "user", "long 0", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    plain = {c: [(a or "", b or "") for a, b in ts] for c, ts in talks.items()}
    want = {}
    for c, t in plain.items():
        if any(len(u) > len(t) and u[: len(t)] == t for u in plain.values()):
            continue
        same = [d for d, u in plain.items() if u == t]
        want[min(same)] = (len(t), len(same), "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in t))
    got = {x.conv_id: (x.n_turns, x.n_copies, x.rendered) for x in chat.render(df).collect()}
    assert got == want
    assert chat.render(df.limit(0)).collect() == []


def test_chat_of_long_and_tied_conversations_equals_its_sql(spark):
    """A conversation of 1,500 turns, several turns of one number, numbers that are null, repeated rows."""
    import duckdb
    import pandas as pd

    from tracewright.llm import queries

    rows = [(1, k, "user" if k % 2 else "assistant", f"said {k}") for k in range(1500)] + [(2, k, "user" if k % 2 else "assistant", f"said {k}") for k in range(700)]
    rows += [(3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "assistant", "z"), (3, 5, "user", "a"), (3, 9, "user", "é")]
    rows += [(4, 0, "assistant", "z"), (4, 1, "user", "a"), (4, 2, "user", "b")]  # the first turns of 3
    rows += [(5, None, "user", "y"), (5, None, "user", "x"), (5, 0, "user", "w"), (6, 7, "user", "x"), (6, 8, "user", "y"), (None, 1, "user", "lost")]
    want = duckdb.connect()
    want.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = want.sql(queries.ORACLE_SQL["op2_chat_formatting"] + " ORDER BY conv_id")
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [tuple(r[c] for c in want.columns) for r in got] == want.fetchall()
    assert [r.conv_id for r in got] == [1, 3, 5]


def test_chat_with_a_turn_of_many_megabytes(spark):
    long = "é word " * 1_000_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "ok"), (2, 0, "user", long), (3, 0, "user", long + "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render(df).select("conv_id", F.length("rendered").alias("n")).orderBy("conv_id").collect()
    turn = len("<|user|>\n<|end|>\n")
    assert [tuple(r) for r in got] == [(1, len(long) + turn + len("<|assistant|>\nok<|end|>\n")), (3, len(long) + 1 + turn)]


def test_pipeline_equals_its_stages_done_plainly(spark):
    from test_jaccard_join import brute
    from test_text_operators import brute_hits, words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(language_id.teaching(docs))
    kept = [x for x in language_id.identify(docs, model).collect() if not x.rejected]
    assert len(kept) >= 0.97 * docs.count()
    groups = brute([(x.doc_id, x.text) for x in kept])
    text = {x.doc_id: x.text for x in kept}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [i for i, _, root, _ in groups if i == root]
    hits = {i: brute_hits(text[i], items) if len(set(words(text[i]))) else (0, 0, []) for i in left}
    left = {i for i in left if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id for x in out} == left and len(out) == len(left)
    lengths = {x.doc_id: x.pack_length for x in out}
    assert lengths == {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i in left}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "packing"]


STAGE = "doc_id long, text string, lang string, score string, rejected string, n_words string, items string, matches string"


def test_stages_keep_clashing_columns_and_take_odd_rows(spark):
    """Columns that have the names of an operator's, rows without ids, repeated rows, texts that are null, empty or long."""
    said = "the quick brown fox jumps over the lazy dog and runs away from the loud hounds"
    rows = [(k, f"{said} {k} times or more on day {k * 7}", "en") for k in range(40)] + [(None, said + " at night", "en"), (None, said + " at night", "en"), (3, None, "en"), (4, "", None), (5, said, "en"), (5, said, "en"), (50, "hound " * 20_000, "en")]
    docs = spark.createDataFrame([(*r, "s", "r", "w", "i", "m") for r in rows], STAGE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(x.score, x.rejected, x.n_words, x["items"], x.matches) for x in out.collect()} == {("s", "r", "w", "i", "m")}, name
        assert stage(spark, docs.limit(0), SF).collect() == []
    kept = corpus_pipeline.identify_language(spark, docs, SF).collect()
    assert not any(not x.text for x in kept)
    once = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sum(x.text == said for x in once) <= 1 and sum(x.doc_id is None for x in once) <= 1
    packed = corpus_pipeline.pack_lengths(spark, docs, SF).collect()
    assert len(packed) == len(rows) and corpus_pipeline.pack_lengths(spark, docs.limit(0), SF).collect() == []
