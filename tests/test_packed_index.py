"""Stored blocks: packed without loss, written and compacted without a shuffle, tombstones told in little room."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.functions import packed
from tracewright.operators import search
from tracewright.plans import trace_queries
from tracewright.sources import index_store

ODD = ["007", "-0", "", "1\n", None, "9223372036854775808", "é", "+5", "a-1"]
WHOLE = ["0", "12", "-3", "999999999999999999", "-999999999999999999"]


def found(index):
    return sorted(((r.namespace, r.lexeme, str(r.uuid), list(r.positions)) for r in index.collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_packing_loses_nothing(seed):
    r = random.Random(seed)
    ids = [[r.choice(r.choice([WHOLE, WHOLE, ODD])) for _ in range(r.randrange(4))] for _ in range(r.randrange(9))]
    places = [[[r.choice([0, 1, 127, 128, 2**31 - 1]) for _ in range(r.randrange(4))] for _ in b] for b in ids]
    columns = packed.pack(packed.postings_of(pa.array(ids, pa.list_(pa.string())), pa.array(places, pa.list_(pa.list_(pa.int32())))))
    for part in (slice(None), slice(2, None)):
        n, n_places, some, names, at = (c[part] for c in columns)
        n, n_places = (np.asarray(x).astype(np.int64) for x in (n, n_places))
        held = packed.unpack_ids(n, some, names)
        assert packed.lists(n, held.texts()).to_pylist() == ids[part]
        counts, flat = packed.unpack_places(n, n_places, at)
        assert packed.lists(n, packed.lists(counts, pa.array(flat))).to_pylist() == places[part]
        assert n_places.tolist() == [sum(map(len, b)) for b in places[part]]
        keep = np.array([r.random() < 0.5 for _ in range(n.sum())], bool)
        assert held.take(keep).texts().to_pylist() == [x for x, k in zip(sum(ids[part], []), keep) if k]


def test_a_number_and_its_text_are_one_id():
    for values in ([5, -7, None, 10**18 - 1, 10**18, -(2**63)], []):
        a, b = packed.ids_of(pa.array(values, pa.int64())), packed.ids_of(pa.array([None if v is None else str(v) for v in values], pa.string()))
        assert a.named.tolist() == b.named.tolist() and a.numbers.tolist() == b.numbers.tolist() and a.names.equals(b.names)


def test_blocks_are_stored_without_a_shuffle(spark, tmp_path):
    table = spark.createDataFrame([(i, "en", f"fox {i % 5} den") for i in range(200)], "uuid long, namespace string, content string").repartition(3)
    rows = search.build_blocks(spark.createDataFrame(table.collect(), table.schema), packed=True)
    spark.sparkContext.setJobGroup("append", "append")
    index_store.append_segment(rows, str(tmp_path / "index"))
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("append")]
    assert jobs and all(len(j.stageIds) == 1 for j in jobs)


def test_many_tombstones_are_told_in_little_room(spark, tmp_path, monkeypatch):
    """Ids of a thousand documents, of which each but the tenth goes, in 2,500 bytes: as texts they take ten thousand."""
    monkeypatch.setattr(index_store, "TOLD", 2500)
    path = str(tmp_path / "index")
    table = spark.createDataFrame([(i, "en", f"fox fox w{i % 7}") for i in range(1000)], "uuid long, namespace string, content string").coalesce(2)
    index_store.append_segment(search.build_blocks(table), path)
    index_store.delete_documents(table.filter("uuid % 10 > 0"), path)
    want = found(search.build_index(table.filter("uuid % 10 = 0")))
    alive = index_store.open_blocks(spark, path)
    assert found(index_store.postings(alive)) == want
    assert "Exchange" not in alive._jdf.queryExecution().executedPlan().toString()
    index_store.compact(spark, path)
    assert found(index_store.open_index(spark, path)) == want


def test_compaction_merges_a_term_and_counts_it(spark, tmp_path):
    path = str(tmp_path / "index")
    for k in range(6):
        table = spark.createDataFrame([(10 * k + i, "en", "fox den fox") for i in range(3)] + [(10 * k + 5, None, "fox")], "uuid long, namespace string, content string")
        index_store.append_segment(search.build_blocks(table.coalesce(1), packed=k % 2 == 0), path)
    index_store.delete_documents(spark.createDataFrame([(0,), (51,)], "uuid int"), path)
    counts = lambda some: sorted(map(tuple, search.index_statistics(some).collect()), key=str)
    want = [("en", "den", 16, 16), ("en", "fox", 16, 32), (None, "fox", 6, 6)]
    assert counts(index_store.open_packed(spark, path)) == counts(index_store.open_blocks(spark, path)) == sorted(want, key=str)
    index_store.compact(spark, path)
    again = index_store.open_packed(spark, path)
    assert counts(again) == sorted(want, key=str)
    assert again.filter("lexeme = 'den'").count() < 6


@pytest.mark.parametrize("again", [[], [(2, 0, 1)]])
def test_indexed_texts_are_those_of_the_memories(spark, tmp_path, again):
    """A document with two labels is two memories."""
    spark.createDataFrame([(1, "a b", "en", "x", 3), (2, "b", None, "x", 1), (3, None, "fr", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), *again], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = trace_queries.view(spark, str(tmp_path), "memories").select("uuid", "namespace", "content")
    some = trace_queries._texts(spark, str(tmp_path))
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert ("Join" in some._jdf.queryExecution().executedPlan().toString()) == bool(again)
