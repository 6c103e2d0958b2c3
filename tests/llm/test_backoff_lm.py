import math
import re
import random
from collections import Counter

import pytest

from tracewright.llm import backoff_lm

SCHEMA = "doc_id long, text string, score string"


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows):
    docs = [words(t) for _, t in rows]
    total = sum(map(len, docs))
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip(d, d[1:]))
    context = Counter(v for d in docs for v in d[:-1])
    out = []
    for (i, _), d in zip(rows, docs):
        own = Counter(zip(d, d[1:]))
        s = math.log(one[d[0]] / total) if d else None
        for p, n in own.items():
            others = two[p] - n
            s += n * math.log(others / context[p[0]] if others else 0.4 * one[p[1]] / total)
        out.append((i, len(d), s / len(d) if d else None))
    return out


def rows(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "É"] * 15
    out = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 60])))) for i in range(60)]
    return [*out, (60, None), (61, ""), (62, "!!"), (63, out[3][1]), (3, out[3][1]), (64, "The the the THE")]


def test_equals_brute_force(spark):
    given = rows()
    df = spark.createDataFrame([(*r, "x") for r in given], SCHEMA).coalesce(3)
    got = backoff_lm.score(df, order=2).collect()
    key = lambda t: (t[0], t[1], round(t[2], 9) if t[2] is not None else None)
    assert sorted(map(key, map(tuple, got)), key=str) == sorted(map(key, brute(given)), key=str)


def test_empty_table(spark):
    assert backoff_lm.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_texts_and_null_ids(spark):
    r = random.Random(5)
    given = [(None, " ".join(r.choice(["a", "b", "c"]) for _ in range(30_000))), (None, "a b c"), (7, "the " * 20_000), (7, "the the end")]
    got = backoff_lm.score(spark.createDataFrame([(*r, "x") for r in given], SCHEMA)).collect()
    key = lambda t: (t[0], t[1], round(t[2], 9) if t[2] is not None else None)
    assert sorted((key(tuple(r)) for r in got), key=str) == sorted(map(key, brute_any(given, 3)), key=str)


def brute_any(rows, order):
    """By the definition, word for word."""
    docs = [words(t) for _, t in rows]
    total = sum(map(len, docs))
    every, own, context = Counter(), [], Counter()
    for d in docs:
        mine = Counter(tuple(d[i : i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1))
        own.append(mine)
        every += mine
        context += Counter(tuple(d[i : i + k]) for k in range(1, order) for i in range(len(d) - k))

    def s(i, g):
        if len(g) == 1:
            return every[g] / total
        others = every[g] - own[i][g]
        return others / context[g[:-1]] if others else 0.4 * s(i, g[1:])

    logs = [[math.log(s(i, tuple(d[max(0, p - order + 1) : p + 1]))) for p in range(len(d))] for i, d in enumerate(docs)]
    return [(name, len(x), sum(x) / len(x) if x else None) for (name, _), x in zip(rows, logs)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_longer_n_grams_equal_brute_force(spark, order):
    given = rows(order)
    given += [(100 + k, " ".join((given[k % 60][1] + " x " + given[7 * k % 60][1]).split()[k % 4 :])) for k in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in given], SCHEMA).coalesce(3)
    key = lambda t: (t[0], t[1], round(t[2], 9) if t[2] is not None else None)
    got = sorted((key(tuple(r)) for r in backoff_lm.score(df, order=order).collect()), key=str)
    assert got == sorted(map(key, brute_any(given, order)), key=str)
    if order > 2:
        assert got != sorted(map(key, brute_any(given, 2)), key=str)


def test_query_counts_trigrams(spark):
    from tracewright.llm import queries

    folder = "/root/testdata/sf0.001"
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: x for i, _, x in brute_any(given, 3)}
    for r in queries.op8_lm_scoring(spark, folder).collect():
        assert (r.score is None) == (want[r.doc_id] is None) and (r.score is None or abs(r.score - want[r.doc_id]) < 1e-9)


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(sc.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(False).size()))


def test_n_grams_cross_the_network_once_a_block(spark):
    """Before, each n-gram of each document did, twice: some twenty times the text."""
    r = random.Random(9)
    given = [(i, " ".join(f"w{int(r.paretovariate(0.4)) % 3000}" for _ in range(300)), "x") for i in range(400)]
    df = spark.createDataFrame(given, SCHEMA).coalesce(1)
    before = shuffled(spark)
    backoff_lm.score(df).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 5 * sum(len(t) for _, t, _ in given)


def test_many_blocks_and_ranges_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK", 900)
    monkeypatch.setattr(backoff_lm, "RANGE", 700)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    given = rows(4)
    try:
        out = backoff_lm.score(spark.createDataFrame([(*r, "x") for r in given], SCHEMA).coalesce(3))
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    key = lambda t: (t[0], t[1], round(t[2], 9) if t[2] is not None else None)
    assert sorted((key(tuple(r)) for r in got), key=str) == sorted(map(key, brute_any(given, 3)), key=str)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert moved and not any("texts#" in x for x in moved)
