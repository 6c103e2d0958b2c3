import random
import re
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import jaccard_join, minhash

SCHEMA = "doc_id long, text string, component_id string, kept string, node string"


def sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=2, percent=80):
    s = [sets(r[1], n) for r in rows]
    near = [[j for j in range(len(rows)) if i == j or s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])] for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((doc, len(s[i]), least, doc == least if doc is not None else not s[i]))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in minhash.near_duplicates(df.repartition(3), **options).collect()), key=str)


def texts(seed, groups=8):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(300))
    line = [word() for _ in range(25)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([4, 9, 30, 150]))]
        for _ in range(r.choice([1, 4, 40])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, len(base) // 12, len(base) // 10])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy + line if r.random() < 0.4 else copy))
    rows += ["", None, "  \t", "One", "one", "One two", "one  TWO", "é É", "é É", " ".join(f"w{i}" for i in range(30_000))]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("leaf", [1000, 6])
def test_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = texts(leaf)
    assert run(spark, rows) == brute(rows)


def test_other_shingles_and_similarities(spark):
    rows = texts(5)
    assert run(spark, rows, n=3, percent=65) == brute(rows, 3, 65)


def test_frequent_coordinates_go_last(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SAMPLE", 1)
    monkeypatch.setattr(minhash, "FREQUENT", 2)
    rows = texts(7)
    assert run(spark, rows) == brute(rows)


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f g"), (None, None), (None, "q r"), (9, None), (9, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_large_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 100)
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(1200):
        copy = list(base)
        for _ in range(1 + i % 2):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = run(spark, rows)
    assert {x[2] for x in got} == {0} and len(got) == 1200


def test_collisions_estimate_similarity_and_the_prefix_holds():
    r = np.random.default_rng(0)
    single, pairs = minhash.matches(0.8, 128), minhash.matches(0.64, 64)
    assert 70 <= single <= 80 and 15 <= pairs <= 22 and minhash.matches(1.0, 64) == 64
    most = []
    for _ in range(300):
        every = r.integers(0, 1 << 63, 450, dtype=np.uint64)
        a, b = np.sort(every[:425]), np.sort(every[25:])  # 400 of 450 shared: 0.89
        x, y = minhash.minima([a, b])
        most.append(int((x == y).sum()))
        t, u = minhash.tokens(np.stack([x, y]))
        assert most[-1] >= single and (t == u).sum() >= pairs
        assert set(np.sort(t)[: 65 - pairs].tolist()) & set(np.sort(u)[: 65 - pairs].tolist())
    assert abs(np.mean(most) / 128 - 400 / 450) < 0.01
    sizes, sketch = np.array([425, 425, 40]), [bytes(range(128)), bytes(range(74)) + bytes(54), bytes(range(128))]
    find = partial(minhash.partners, percent=80, needed=74)
    assert find(sizes, sketch, np.zeros((3, 3), bool)).tolist() == [True, True, False]
    assert not find(sizes, sketch, np.ones((3, 3), bool)).any()


def test_recall_of_pairs_at_the_very_threshold(spark):
    r = random.Random(11)
    rows = []
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(91)]
        rows.append((2 * g, " ".join(words)))
        cut = list(words)
        for i in r.sample(range(5, 85, 10), 5):  # ten shingles of ninety differ on either side: 80 of 100 shared
            cut[i] = f"g{g}x{i}"
        rows.append((2 * g + 1, " ".join(cut)))
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(x[3] for x in got) == 150
