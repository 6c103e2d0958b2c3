"""Indexes in blocks: what is grouped where it is read, merged where a memory repeats, and told apart from the dead."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import search
from tracewright.sources import index_store

ROWS = [(1, "en", "the cat the Dogs"), (2, "en", "the running of the dogs"), (3, None, "the cat"), (4, "fr", None), (5, "fr", "le chat le")]


def memories(spark, rows):
    return spark.createDataFrame(rows, "uuid long, namespace string, content string")


def found(index):
    return sorted(((r.namespace, r.lexeme, str(r.uuid), list(r.positions)) for r in index.collect()), key=str)


def plain(spark, rows, config="simple"):
    words = text.tokenize(memories(spark, rows), "content", config, ("namespace", "uuid"))
    return found(words.groupBy("namespace", "lexeme", "uuid").agg(F.sort_array(F.collect_list("pos")).alias("positions")))


@pytest.mark.parametrize("config", ["simple", "english"])
@pytest.mark.parametrize("rows", [ROWS, [*ROWS, (1, "en", "the mouse"), (1, "fr", "the mouse")]])
def test_index_is_what_grouping_every_word_gives(spark, config, rows):
    assert found(search.build_index(memories(spark, rows), config)) == plain(spark, rows, config)
    assert found(index_store.postings(search.build_blocks(memories(spark, rows), config))) == plain(spark, rows, config)


def test_words_are_not_shuffled(spark):
    plan = search.build_index(memories(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_texts_are_not_joined_by_namespace(spark):
    """All texts of a namespace would meet in one task."""
    asked = search.parse_websearch(spark.createDataFrame([(1, "the cat")], "query_id int, query string"))
    index = search.build_index(memories(spark, ROWS), terms=asked)
    assert {r.lexeme for r in index.collect()} == {"the", "cat"}
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_phrases_alternatives_and_negations(spark):
    index = search.build_index(memories(spark, ROWS))
    ask = lambda q: sorted((r.uuid, r.frequency, [tuple(p) for p in r.places]) for r in search.fts_match(search.parse_websearch(spark.createDataFrame([(1, q)], "query_id int, query string")), index).collect())
    assert ask('"of the dogs"') == [(2, 1, [(2, 1)])]
    assert ask('"the cat" -of') == [(1, 1, [(0, 1)]), (3, 1, [(0, 1)])]
    assert ask("cat or chat") == [(1, 1, [(1, 1)]), (3, 1, [(1, 1)]), (5, 1, [(1, 1)])]
    assert ask("-the") == []


@pytest.mark.parametrize("told", [index_store.TOLD, 1])
def test_the_dead_are_left_out_told_or_joined(spark, tmp_path, monkeypatch, told):
    monkeypatch.setattr(index_store, "TOLD", told)
    path = str(tmp_path / "index")
    index_store.append_segment(search.build_blocks(memories(spark, ROWS)), path)
    index_store.delete_documents(spark.createDataFrame([(1,), (5,)], "uuid long"), path)
    index_store.append_segment(search.build_index(memories(spark, [(5, "fr", "le chien")])), path)
    want = plain(spark, [*ROWS[1:4], (5, "fr", "le chien")])
    assert found(index_store.open_index(spark, path)) == want
    index_store.compact(spark, path)
    assert found(index_store.open_index(spark, path)) == want
