import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.functions.porter2 import stem
from tracewright.operators import search
from tracewright.sources import index_store

MEMORY = "uuid long, namespace string, type string, visibility string, status string, agent_id string, created_at long, content string"


def memories(r, n):
    return [(i, r.choice("xyz"), r.choice(["fact", "note", None]), r.choice(["shared", "shared", "private"]), r.choice(["approved", "proposed", "retired"]), r.choice(["a", "b", None]), r.randrange(60), r.choice(["red fox", "blue fox", "red sky"])) for i in range(n)]


def sees(q, m):
    _, space, kind, visibility, status, owner, *_ = m
    mine = visibility == "private" and status == "approved" and owner == q["agent_id"]
    shared = visibility == "shared" and (status == "approved" or q["include_proposed"] and status == "proposed")
    return space in q["namespaces"] and (mine or shared) and (not q["types"] or kind in q["types"])


def requests(r, n):
    return [{"query_id": k, "agent_id": r.choice("abc"), "namespaces": r.choice([["x"], ["x", "y"], ["z", "z"], [], ["nowhere", "y"]]), "types": r.choice([None, [], ["fact"], ["fact", "note", "fact"]]), "include_proposed": r.random() < 0.5, "lane_rows": r.choice([1, 4, 9]), "query": r.choice(["fox", "red", "fox -blue", ""]), "recency_half_life_h": 10.0} for k in range(n)]


def test_lanes_equal_a_look_at_all_memories(spark):
    r = random.Random(4)
    known, asked = memories(r, 300), requests(r, 1000)
    table = spark.createDataFrame(known, MEMORY).repartition(4)
    want = spark.createDataFrame([tuple(q.values()) for q in asked], "query_id int, agent_id string, namespaces array<string>, types array<string>, include_proposed boolean, lane_rows int, query string, recency_half_life_h double")
    lanes = {"recency": search.recency_lane(want, table, 100.0), "fts": search.fts_lane(want, table, search.build_index(table), rank="frequency")}
    for name, lane in lanes.items():
        got = sorted((x.query_id, x.rank, x.uuid) for x in lane.collect())
        plain = []
        for q in asked:
            fits = lambda m: name == "recency" or q["query"] and {"fox": "fox" in m[7], "red": "red" in m[7], "fox -blue": m[7] == "red fox"}[q["query"]]  # noqa: B023, E731
            seen = sorted((m for m in known if sees(q, m) and fits(m)), key=lambda m: (-m[6], m[0]))[: q["lane_rows"]]
            plain += [(q["query_id"], k + 1, m[0]) for k, m in enumerate(seen)]
        assert got == sorted(plain)


def test_lists_are_cut_to_their_depth(spark):
    table = spark.createDataFrame([(i, "x", "fact", "shared", "approved", "a", i, "t") for i in range(500)], MEMORY)
    lists = search.recency_lists(table, 5)
    assert sorted((x.type or "", x.uuid) for x in lists.collect()) == sorted((t, i) for t in ("", "fact") for i in range(495, 500))


def test_the_most_specific_configuration_holds(spark):
    config = spark.createDataFrame([("*", "*", 1), ("a", "*", 2), ("*", "x", 3), ("a", "x", 4)], "agent_id string, namespace string, max_results int").withColumns({"recency_half_life_h": F.lit(1.0), "preview_chars": F.lit(5), "include_proposed": F.lit(False)})
    asked = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["y"]), (3, "b", ["x"]), (4, "b", ["y", "x"]), (5, "b", [])], "query_id int, agent_id string, namespaces array<string>")
    assert {r.query_id: r.max_results for r in search.effective_config(asked, config).collect()} == {1: 4, 2: 2, 3: 3, 4: 1, 5: 1}
    assert {r.max_results for r in search.effective_config(asked, config.filter("namespace = 'none'")).collect()} == {10}


#: Words and stems that the Snowball project publishes as a sample of its English stemmer.
SAMPLES = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori
consolidating consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirator conspir constables constabl constance constanc constancy constanc constant constant
knackeries knackeri knaves knave knavish knavish kneaded knead kneeling kneel knees knee knightly knight knitted knit knives knive knocker knocker knockers knocker knopp knopp""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(SAMPLES[::2], SAMPLES[1::2])))
def test_published_samples(word, want):
    assert stem(word) == want


def test_rules_and_exceptions_of_the_stemmer():
    want = {"skies": "sky", "dying": "die", "news": "news", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "hopping": "hop", "hoping": "hope", "generate": "generat", "general": "general", "exceed": "exceed", "say": "say", "enjoyed": "enjoy", "relational": "relat", "national": "nation", "is": "is", "wholly": "wholli", "adjustment": "adjust", "adoption": "adopt"}
    assert {w: stem(w) for w in want} == want


def test_words_of_all_scripts(spark):
    df = spark.createDataFrame([(1, "Łódź СЛОВО Ελληνικά 日本語 हिन्दी x_1 Straße"), (2, None), (3, "The runners weren't running IN Kneading")], "uuid int, t string")
    assert sorted(r.lexeme for r in text.tokenize(df.filter("uuid = 1"), "t").collect()) == sorted(["łódź", "слово", "ελληνικά", "日本語", "हिन्दी", "x", "1", "straße"])
    got = sorted((r.pos, r.lexeme) for r in text.tokenize(df.filter("uuid > 1"), "t", "english").collect())
    assert got == [(1, "runner"), (2, "weren"), (4, "run"), (6, "knead")]


def test_a_stored_index_equals_one_made_anew(spark, tmp_path):
    path = str(tmp_path / "index")
    r = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    doc = lambda i: (i, r.choice("xyz"), " ".join(r.choice(words) for _ in range(r.randrange(1, 12))))
    table = lambda docs: spark.createDataFrame(docs, "uuid long, namespace string, content string")
    rows = lambda df: sorted((p.namespace, p.lexeme, str(p.uuid), tuple(p.positions)) for p in df.collect())
    alive = {}
    for step in range(3):
        fresh = [doc(i) for i in range(step * 10, step * 10 + 14)]  # some of which are there already, in another text
        index_store.delete_documents(table(fresh), path)
        index_store.append_segment(search.build_index(table(fresh)), path)
        alive |= {d[0]: d for d in fresh}
    gone = [doc(i) for i in (3, 12, 99)]
    index_store.delete_documents(table(gone), path)
    for d in gone:
        alive.pop(d[0], None)
    want = rows(search.build_index(table(list(alive.values()))))
    assert rows(index_store.open_index(spark, path)) == want
    before = index_store.segments(spark, path)
    index_store.compact(spark, path)
    assert rows(index_store.open_index(spark, path)) == want and len(before[1]) == 3 and len(index_store.segments(spark, path)[1]) == 1
    terms = spark.createDataFrame([(1, "w3"), (1, "w5")], "query_id int, lexeme string")
    spaces = spark.createDataFrame([(1, "x")], "query_id int, namespace string")
    some = index_store.open_index(spark, path, terms, spaces)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket_no" in plan.split("PartitionFilters: [")[1].split("]")[0] and "segment" in plan.split("PartitionFilters: [")[1].split("]")[0]
    met = some.join(terms.join(spaces, "query_id"), ["namespace", "lexeme"])
    assert rows(met) == [x for x in want if x[0] == "x" and x[1] in ("w3", "w5")]
    assert rows(index_store.open_index(spark, str(tmp_path / "none"))) == []
