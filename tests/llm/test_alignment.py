import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracewright.llm import alignment, queries
from tracewright.llm.common import staged

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    to_byte = {c: b for c, b in alignment._byte_of().items()}
    name = {i: x for x, i in t.get_vocab().items()}
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    spell_a = lambda i: bytes(to_byte[c] for c in name[i])
    spell_b = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    return (lambda x: t.encode(x, add_special_tokens=False).ids), p.encode, spell_a, spell_b


def brute(rows):
    """The query's rows, one text after another."""
    encode_a, encode_b, spell_a, spell_b = libraries()
    each, count = [], Counter()
    for doc, text in rows:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        if b"".join(map(spell_a, a)) != b"".join(map(spell_b, b)) or text and b"".join(map(spell_a, a)) != b" " + text.encode():
            a, b = [], []
        ends = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at = 0
            ends.append([at := at + len(spell(i)) for i in ids])
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(i, j) for c in cuts for i, x in zip(a, ends[0]) if x == c for j, y in zip(b, ends[1]) if y == c] if len(cuts) < 300 else [(a[ends[0].index(c)], b[ends[1].index(c)]) for c in cuts]
        count.update(links)
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, x in zip(a, ends[0]) if low < x <= c) + "|" + ",".join(str(j) for j, y in zip(b, ends[1]) if low < y <= c)) if len(cuts) < 3000 else None
            low = c
        each.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return sorted([(d, n_a, n_b, g, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), sha) for d, n_a, n_b, g, ls, sha in each], key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, rows, head=None):
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, pairs string, n_a int").repartition(3)
    found = alignment.with_counts(staged(alignment.align(df, A, B).select("doc_id", *COLUMNS[1:5], "groups_sha256", "pairs", "times"), "aligned"), head)
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


def texts(seed):
    r = random.Random(seed)
    letters = ["ab", "cde", "straße", "naïve", "日本語", "слово", "😀", "👩‍👩‍👧", "can't", "it's", "42", "3.14", "\n", "  ", "\t", " \n ", "x" * 40, "...", " ", "é", "​", "\r\n", "ﬁ", "़"]
    return [r.choice(["", " ", "\n"]) + r.choice([" ", "", "  "]).join(r.choice(letters) for _ in range(r.choice([1, 3, 30, 200]))) for _ in range(60)]


EDGE = [None, "", " ", "a", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ a ▁b", "nul\x00byte", "﻿bom", "é É", "The same text twice.", "The same text twice.", "x" * 3000, " " * 2000, "\n" * 500]


@pytest.mark.parametrize("head", [None, 7])
def test_equals_the_libraries(spark, head):
    rows = list(enumerate(EDGE + texts(0))) + [(9, "The same text twice."), (None, "an id is missing")]
    assert run(spark, rows, head) == brute(rows)


def test_pieces_and_blocks_change_nothing(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([" ".join(texts(s))[:2500] for s in range(4)] + ["one two three " * 100])]
    want = brute(rows)
    encode_a, encode_b, *_ = libraries()
    for size, block in ((8, 50), (64, 1 << 20)):
        assert sum(len(list(alignment.pieces(t, size))) for _, t in rows) > 30
        for _, t in rows:
            cut = list(alignment.pieces(t, size))
            assert " ".join(cut) == t
            assert [i for x in cut for i in encode_a(" " + x)] == encode_a(" " + t) and [i for x in cut for i in encode_b(x)] == encode_b(t)
        monkeypatch.setattr(alignment, "PIECE", size)
        monkeypatch.setattr(alignment, "BLOCK", block)
        got = [alignment._Aligned([t for _, t in rows], A, B, True)]
        columns = got[0].columns()
        assert [(columns["n_a"][i].as_py(), columns["n_b"][i].as_py(), columns["n_groups"][i].as_py(), columns["groups_sha256"][i].as_py()) for i in range(len(rows))] == [(*w[1:4], w[7]) for w in sorted(want)]


def test_spans(spark):
    rows = [(0, "naïve Straße 日本"), (1, None), (2, "▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align(df, A, B, spans=True).collect()}
    encode_a, encode_b, spell_a, spell_b = libraries()
    r = got[0]
    assert r["a_ids"] == encode_a(" " + rows[0][1]) and r["b_ids"] == encode_b(rows[0][1]) and len(r["cuts"]) == r["n_groups"]
    for i, j in r["cuts"]:
        assert b"".join(map(spell_a, r["a_ids"][:i])) == b"".join(map(spell_b, r["b_ids"][:j]))
    assert [got[k]["a_ids"] + got[k]["cuts"] for k in (1, 2)] == [[], []]


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == brute([(1, None)])


def test_a_very_long_text_without_spaces(spark):
    r = random.Random(1)
    rows = [(0, "".join(r.choice("abcdefg") for _ in range(150_000))), (1, "word " * 120_000)]
    got = {x[0]: x for x in run(spark, rows)}
    encode_a, encode_b, *_ = libraries()
    for i, t in rows:
        assert got[i][1:3] == (len(encode_a(" " + t)), len(encode_b(t)))


def test_query_on_some_documents(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_cross_tokenizer_alignment(spark, SF).select(*COLUMNS).collect()), key=str)
    want = brute(table)
    assert [x[:5] + x[5:7] for x in got] == [x[:5] + x[5:7] for x in want]
    assert all(x == y for x, y in zip(got, want, strict=True) if y[3] < 3000)
