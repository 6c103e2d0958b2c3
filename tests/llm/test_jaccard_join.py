import random
import re

import pytest

from tracewright.llm import jaccard_join

SCHEMA = "doc_id long, text string, component_id string"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(n_shingles, component_id, n_links) of every row, by comparing all pairs."""
    s = [sets(r[1]) for r in rows]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                links[i].append(j)
                links[j].append(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(s[i]), min(rows[j][0] for j in seen), len(links[i])))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in jaccard_join.similar(df.repartition(3)).select("doc_id", "n_shingles", "component_id", "n_links").collect())


def texts(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(400))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.choice([20, 60, 120]))]
        for _ in range(r.choice([1, 5, 40])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy += passage
            rows.append(" ".join(copy))
    rows += ["", None, "  \t", "One two", "one  TWO", "one two three four five", "é É", "é É"]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("leaf", [384, 7])
def test_equals_brute_force(spark, monkeypatch, leaf):
    """With tiny leaves every large group goes through cores, shells and pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = texts(leaf)
    assert run(spark, rows) == brute(rows)


def test_frequent_shingles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    rows = [*texts(3), (2, "same row"), (2, "same row")]
    assert run(spark, rows) == brute(rows)


def test_long_texts_of_different_shingles(spark, monkeypatch):
    """Texts of 20,000 different words, near copies of them at the threshold and beyond, joined with and without a broadcast."""
    base = [f"w{k}" for k in range(20_000)]
    changed = lambda n: [f"x{k}" if k % 5 == 0 and k < n else w for k, w in enumerate(base)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, changed(2800), changed(2900), base[:15_003], base[:15_002], base[10_000:], base[::-1], base + base[:30]])]
    for size in (16 << 20, 0):
        monkeypatch.setattr(jaccard_join, "WANTED_BYTES", size)
        assert run(spark, rows) == brute(rows)


def test_repeated_rows_of_large_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 7)
    r = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(30):
        copy = list(base)
        copy[r.randrange(60)] = "x"
        rows.append((i, " ".join(copy)))
    rows += [rows[3], rows[5], rows[5]]
    assert run(spark, rows) == brute(rows)


def test_names_that_clash(spark, monkeypatch):
    """With names of 4 bits every set shares its name with many others."""
    monkeypatch.setattr(jaccard_join, "NAME_BITS", 4)
    rows = texts(17)
    assert run(spark, rows) == brute(rows)


def test_stage_keeps_a_row_of_each_group(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text of words"), (2, "A B c d e f"), (None, "a b c d e f"), (4, "alone here"), (4, "alone here"), (6, None), (6, None), (None, "no id one two"), (None, "no id one two")]
    kept = jaccard_join.distinct_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted([(1, "a b c d e f"), (1, "quite another text of words"), (4, "alone here"), (6, None), (6, None), (None, "no id one two")], key=key)


def test_empty_table_and_stage(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.similar(none).collect() == []
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (7, "other words"), (None, "a b c d e f"), (9, None)]
    kept = jaccard_join.distinct_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {3, 7, 9}
