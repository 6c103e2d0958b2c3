import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, fingerprint, language_id, license_scan, packing, token_counts
from tracewright.llm.words import ALNUM, SPACED, word_shards

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, matches string"
EDGE = ["", None, "   ", "!!", "a", "É", "the " * 3000, "x" * 5000, "😀 ok", "tab\tand\nline\x0bfeed", "nul\x00byte"]


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def frame(spark, texts, ids=None):
    """Columns that clash with those the operators add."""
    return spark.createDataFrame([(i, t, "old", "old") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def test_words_are_told_apart_as_by_a_regex():
    for kind, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACED, r"[^\x20\x09-\x0D]+")):
        texts = [*EDGE, "The the THE", "a-b a b", "é É"]
        known = {}
        for limit in (1, 1 << 20):
            seen = []
            for i, j, h, off in word_shards(pa.array(texts, pa.string()), kind, limit):
                seen += [h[off[d] : off[d + 1]].tolist() for d in range(j - i)]
            plain = [re.findall(pattern, low(t)) for t in texts]
            assert [len(x) for x in seen] == [len(x) for x in plain]
            for a, b in zip(seen, plain):
                for x, y in zip(a, b):
                    assert known.setdefault(y, x) == x
        assert len(set(known.values())) == len(known)


def brute_hits(doc, items):
    w, hit, found = words(doc), set(), set()
    for name, text in items:
        x = words(text)
        for s in range(max(1, len(x) - 12) if x else 0):
            win = x[s : s + 13]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    r = random.Random(block)
    word = lambda: r.choice("abc") + str(r.randrange(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 13, 14, 5, 2, 1, 20])] + [(7, None), (8, ""), (9, "Zz zZ")]
    docs = [" ".join([*(word() for _ in range(40)), *items[k % 7][1].split()[: 3 + k], "zz ZZ"]) for k in range(30)] + EDGE
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, extra int")
    got = decontaminate.find_matches(frame(spark, docs), bench).orderBy("doc_id").collect()
    for row, doc in zip(got, docs):
        n, hit, found = brute_hits(doc, items)
        assert (row.n_words, row.n_hit, row["items"]) == (n, hit, found)
        for m in row.matches:
            assert words(doc)[m.doc_word : m.doc_word + m.n_words] == words(dict((str(a), b) for a, b in items)[m.item_id])[m.item_word : m.item_word + m.n_words]
    none = decontaminate.find_matches(frame(spark, docs), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    kept = decontaminate.decontaminate(frame(spark, docs), bench)
    assert kept.columns == frame(spark, []).columns and {(r.n_words, r.matches) for r in kept.collect()} == {("old", "old")}
    assert {r.doc_id for r in kept.collect()} == {k for k, d in enumerate(docs) if not (brute_hits(d, items)[1] and 20 * brute_hits(d, items)[1] >= len(words(d)))}


def test_decontamination_of_repetitive_texts(spark):
    items = [(1, "la " * 1000), (2, "la " * 1000 + "di"), (3, "la " * 12 + "da la"), (4, "la la")]
    docs = ["la " * 20_000, "la " * 20_000 + "di", "la da " * 50, "da " * 30 + "la la " + "da " * 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(frame(spark, docs), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(20_000, 20_000, ["1", "2", "4"]), (20_001, 20_001, ["1", "2", "4"]), (100, 0, []), (42, 2, ["4"])]
    few = ["la " * 40, "la " * 40 + "di la", "x la la da la"]
    for r, d in zip(decontaminate.find_matches(frame(spark, few), bench).orderBy("doc_id").collect(), few):
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(d, items)


def covering(spans):
    """Of (start, length): from left to right those that reach furthest, none within another."""
    left = sorted(set(spans), key=lambda x: (x[0], -x[1]))
    keep, end = [], -1
    for a, n in left:
        if a + n > end:
            keep.append((a, n))
            end = a + n
    out, i = [], 0
    while i < len(keep):
        out.append(keep[i])
        reach = [j for j in range(i + 1, len(keep)) if keep[j][0] <= sum(keep[i])]
        i = reach[-1] if reach else i + 1
    return set(out)


def brute_matches(doc, item):
    """(start, length) in the document and in the item of what matches have to cover."""
    d, x = words(doc), words(item)
    width = min(13, len(x))
    common = lambda a, b: next((k for k in range(min(len(d) - a, len(x) - b)) if d[a + k] != x[b + k]), min(len(d) - a, len(x) - b))
    met = [(a, b, n) for a in range(len(d)) for b in range(len(x)) if (n := common(a, b)) >= width > 0]
    best = lambda k: {p: max(m[2] for m in met if m[k] == p) for p in {m[k] for m in met}}.items()
    return covering(best(0)), covering(best(1)) if len(x) >= 13 else set()


@pytest.mark.parametrize("pairs", [1 << 20, 60])
def test_longest_matches_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    r = random.Random(pairs)
    text = lambda n, of="abcdefgh": [r.choice(of) + str(r.randrange(9)) for _ in range(n)]
    passage, other = text(40), text(25)
    items = [passage, passage[:30] + text(4) + passage[20:], other, passage + passage + other, ["la"] * 30, passage[5:18], passage[3:9], text(3) + passage[10:24] + text(3), passage, []]
    docs = [
        text(5) + passage + text(5) + passage + text(3),
        passage[:13] + passage[:14] + passage[1:],
        ["la"] * 100 + passage,
        passage[:12] + other + passage[12:] + other[:13],
        other + other + passage[15:] + passage[:15],
        passage[3:9] + ["x"] + passage[3:9] + passage[3:9],
        *(sum((r.choice([passage, other, ["la"] * 20])[(a := r.randrange(12)) : a + r.randrange(30)] for _ in range(6)), []) for _ in range(20)),
    ]
    items, docs = [" ".join(x) for x in items], [" ".join(x) for x in docs]
    found = decontaminate._match(pa.array(docs), decontaminate.Windows([str(k) for k in range(len(items))], items, 13), [])["matches"].to_pylist()
    for doc, rows in zip(docs, found):
        for k, item in enumerate(items):
            of = [m for m in rows if m["item_id"] == str(k)]
            in_doc, in_item = brute_matches(doc, item)
            at_doc, at_item = ({(m[c], m["n_words"]) for m in of} for c in ("doc_word", "item_word"))
            assert in_doc <= at_doc and in_item <= at_item
            for m in of:
                a, b, n = m["doc_word"], m["item_word"], m["n_words"]
                d, x = words(doc), words(item)
                assert d[a : a + n] == x[b : b + n] and ((a, n) in in_doc or (b, n) in in_item)
    assert {m["doc_word"] for m in found[0] if m["item_id"] == "0"} == {5, 50}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_license_scan_base_and_templates(spark):
    texts = [*EDGE, "The MIT License. mit-license; GNU General Public License v3, Apache  License", "cc by cc by sa", "mit mit license apache", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted free of charge to somebody else", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "gnu lesser general public license"]
    got = license_scan.scan(frame(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        w = words(text)
        places = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
        assert 0 <= row.score <= 1
    labels = [r.labels for r in got[-4:]]
    assert labels == ["mit", "", "bsd", "lgpl"]
    assert license_scan.scan(frame(spark, [])).collect() == []


def test_fingerprint_edits(spark, monkeypatch):
    r = random.Random(5)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    texts = [make(300) for _ in range(12)] + EDGE + [make(3)]
    plain = [t or "" for t in texts]
    assert fingerprint.fingerprints(plain) == [fingerprint.fingerprints([t])[0] for t in plain]
    shifted = fingerprint.fingerprints([texts[0], "some words before " + texts[0]])
    assert fingerprint.likeness(*shifted) > 0.7
    ids = [3 * k for k in range(len(texts))]
    for size, coarse in ((8 << 20, 256), (4000, 256), (900, 3)):
        monkeypatch.setattr(fingerprint, "GROUP_BYTES", size)
        monkeypatch.setattr(fingerprint, "COARSE", coarse)
        got = {x.doc_id: x for x in fingerprint.fingerprint_edits(frame(spark, texts, ids).repartition(3)).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(plain):
            n = len(t)
            assert got[3 * k].n_chars == n
            assert got[3 * k].edited == t[: n - n // 4] + plain[(k + 1) % len(plain)][: n // 4]
            if k < 11:
                assert got[3 * k].near_edited > 0.35 > 0.2 > got[3 * k].near_next
    assert fingerprint.fingerprint_edits(frame(spark, [])).collect() == []
    assert fingerprint.fingerprint_edits(frame(spark, ["same", "same"], [1, 1])).count() == 2


def plain_mix(x):
    m = (1 << 64) - 1
    x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 29) * 0x94D049BB133111EB) & m
    return x ^ x >> 32


def plain_fingerprint(text):
    """Symbol by symbol, as the method says."""
    m, held = (1 << 64) - 1, set()
    symbols = [ord(c) for c in text]
    for level in (1, 2, 3):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        runs = [plain_mix(x ^ (n << 48) & m) if n > 1 else x for x, n in runs]
        label = runs
        for _ in range(4):
            new = [0] * len(label)
            for i in range(1, len(label)):
                apart = label[i] ^ label[i - 1]
                low = (apart & -apart).bit_length() - 1 if apart else 0
                new[i] = 2 * low + (label[i] >> low & 1)
            label = new
        starts = [i for i in range(len(runs)) if i == 0 or i < len(runs) - 1 and label[i - 1] < label[i] >= label[i + 1]]
        symbols = []
        for a, b in zip(starts, [*starts[1:], len(runs)]):
            symbols.append(plain_mix(sum(plain_mix((x + level) & m) * pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k, x in enumerate(runs[a:b])) & m))
        if level > 1:
            held |= {plain_mix(x ^ level) >> 32 for x in symbols}
    return "".join(f"{x:08x}" for x in sorted(held)[:64])


def test_fingerprints_equal_a_plain_parser():
    r = random.Random(11)
    texts = ["".join(r.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "abc é😀", "".join(map(chr, range(97, 123)))) for n in (1, 2, 3, 7, 50, 900)]
    texts += ["a" * 500, "ab" * 300, "", "x" * 300 + "y", "".join(r.choice("abcdefgh ") for _ in range(60_000))]
    assert fingerprint.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_fingerprint_edits_of_a_very_long_text_and_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(fingerprint, "COARSE", 4)
    r = random.Random(12)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in [400] * 300 + [400_000]]
    ids = [*range(299), 10**15, 10**15 + 1]
    got = {x.doc_id: x for x in fingerprint.fingerprint_edits(frame(spark, texts, ids)).collect()}
    for k, i in enumerate(ids):
        n = len(texts[k])
        assert got[i].edited == texts[k][: n - n // 4] + texts[(k + 1) % len(ids)][: n // 4]
        assert got[i].fingerprint == fingerprint.fingerprints([texts[k]])[0]
    sizes = [len(x) for x in fingerprint.with_successors(frame(spark, texts, ids)).select("id").rdd.glom().collect()]
    assert max(sizes) < 60


def brute_padding(lengths, buckets):
    values = sorted(set(lengths))
    best = {(0, 0): 0}
    for k in range(1, buckets + 1):
        for j in range(1, len(values) + 1):
            options = [best[k - 1, i] + sum(values[j - 1] - x for x in lengths if (values[i - 1] if i else -1) < x <= values[j - 1]) for i in range(j) if (k - 1, i) in best]
            if options:
                best[k, j] = min(options)
    return min(best[k, len(values)] for k in range(1, buckets + 1) if (k, len(values)) in best)


def test_packing_is_optimal_and_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    r = random.Random(2)
    lengths = [r.choice([0, 1, 2, 3, 10, 11, 12, 40, 41, 90, r.randrange(200)]) for _ in range(120)] + [10_000]
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)] + [(500, None, "x"), (500, None, "x")], "doc_id long, n long, bucket string")
    got = packing.pack(df, F.col("n"), buckets=5, budget=300).collect()
    assert len(got) == len(lengths) + 2
    assert sum(x.padding for x in got) == brute_padding([*lengths, 0, 0], 5)
    batches = {}
    for x in got:
        assert x.pack_length <= x.bucket_length
        batches.setdefault((x.bucket, x.batch), []).append(x)
    for (bucket, _), rows in batches.items():
        assert sorted(x.slot for x in rows) == list(range(len(rows)))
        assert len(rows) == 1 or sum(x.bucket_length for x in rows) <= 300
    for bucket in {b for b, _ in batches}:
        full = max(1, 300 // max(1, batches[bucket, 0][0].bucket_length))
        sizes = [len(rows) for (b, k), rows in sorted(batches.items()) if b == bucket]
        assert all(s == full for s in sizes[:-1])
    assert packing.pack(df.limit(0), F.col("n")).collect() == []


def test_packing_is_optimal_for_many_long_lengths(spark):
    r = random.Random(3)
    lengths = [100_000 + 16 * k for k in range(32) for _ in range(r.randrange(1, 5))] + [r.randrange(2048, 30_000) for _ in range(30)] + [5, 7]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    for buckets in (4, 9):
        got = packing.pack(df, F.col("n"), buckets=buckets).collect()
        assert len(got) == len(lengths)
        assert sum(x.padding for x in got) == brute_padding(lengths, buckets)


def test_packing_of_ties_null_ids_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 5)
    rows = [(7, 3)] * 6 + [(7, 4)] * 5 + [(None, k % 4) for k in range(40)] + [(8, 3_000_000), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    seen = []
    for parts in (1, 5):
        got = packing.pack(df.repartition(parts), F.col("n"), buckets=3, budget=12).collect()
        assert len(got) == len(rows) and len({(x.bucket, x.batch, x.slot) for x in got}) == len(rows)
        seen.append(sorted(((x.doc_id, x.pack_length, x.bucket, x.batch, x.slot) for x in got), key=str))
    assert seen[0] == seen[1]


def test_packing_boundaries_are_optimal():
    r = random.Random(4)
    for n in (1, 2, 3, 8, 30):
        for buckets in (1, 2, 5, 40):
            lengths = [r.choice([r.randrange(5), r.randrange(10**6)]) for _ in range(n)]
            values, count = np.unique(lengths, return_counts=True)
            ends = packing.boundaries(values, count, buckets)
            assert len(ends) <= buckets
            assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths, buckets)


def test_packing_words(spark):
    got = frame(spark, EDGE).select(packing.words(F.col("text")).alias("n")).collect()
    assert [x.n for x in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in EDGE]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    texts = [*EDGE, "</s><s> ▁x", "aaaa" * 900, " " * 700, "".join(r.choice("ab \n▁é→😀") for _ in range(3000)), " ".join(r.choice(["the", "Wörter", "x→y", "  ", "\n"]) for _ in range(2500))]
    texts += [texts[-1], texts[-1]]
    for chunk, overlap in ((32_768, 512), (200, 3), (50, 20)):
        got = token_counts.count_tokens(frame(spark, texts, [*range(len(texts) - 1), 0]), path, chunk=chunk, overlap=overlap, limit=700)
        assert got.columns == ["doc_id", "text", "n_words", "matches", "n_bytes", "n_tokens", "over_limit"]
        want = sorted((len((t or "").encode()), len(p.encode(t or "")), len(p.encode(t or "")) > 700) for t in texts)
        assert sorted((x.n_bytes, x.n_tokens, x.over_limit) for x in got.collect()) == want
    assert token_counts.count_tokens(frame(spark, []), path).collect() == []


def test_token_counts_of_a_model_that_normalises(spark, tmp_path):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.provable(path)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(model.SerializeToString())
    assert not token_counts.provable(str(other))
    p = sentencepiece.SentencePieceProcessor(model_file=str(other))
    texts = ["a   b " * 500, "  x  ", None, "", "word " * 3000]
    got = token_counts.count_tokens(frame(spark, texts), str(other), chunk=100, overlap=5).orderBy("doc_id").collect()
    assert [x.n_tokens for x in got] == [len(p.encode(t or "")) for t in texts]


def test_token_counts_of_a_very_long_text(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    r = random.Random(4)
    text = " ".join(r.choice(["the", "Wörter", "x→y", "fingerprint", "\n", "aaaa" * 20]) for _ in range(200_000))
    got = token_counts.count_tokens(frame(spark, [text, "short"]), path).orderBy("doc_id").collect()
    assert got[0].n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.teaching(docs), sample_docs=40)
    got = language_id.identify(docs, model).collect()
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert sum(x.lang_pred == x.lang for x in held) >= 0.97 * len(held)
    assert sum(x.rejected for x in got) <= 0.02 * len(got)
    odd = language_id.identify(frame(spark, [*EDGE, "zq" * 40, "ΩΩΩ ЖЖЖ"]), model).orderBy("doc_id").collect()
    for x, t in zip(odd, EDGE):
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= x.score <= 1
    assert odd[-1].rejected
    assert language_id.identify(frame(spark, ["text"]), language_id.fit(docs.limit(0))).first().lang_pred == "und"


def test_language_id_learns_every_language(spark, monkeypatch):
    r = random.Random(8)
    names, rows = [f"l{k:03}" for k in range(140)], []
    for k, name in enumerate(names):
        letters = [chr(0x4E00 + 40 * k + x) for x in range(12)]
        vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(8)]
        rows += [(len(rows) + x, " ".join(r.choice(vocabulary) for _ in range(20)), name) for x in range(2 if k % 7 == 3 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    models = language_id.fit(docs)
    assert models.languages == names
    got = language_id.identify(docs, models).orderBy("doc_id").collect()
    assert [x.lang_pred for x in got] == [x.lang for x in got]
    assert not any(x.rejected for x in got)
    monkeypatch.setattr(language_id, "SLICE", 1000)
    whole = language_id.fit(docs)
    a, b = (m.cross_entropies([t for _, t, _ in rows[:50]])[0] for m in (models, whole))
    assert len(models.parts) > len(whole.parts) == 1
    assert np.allclose(a, b, atol=1e-4)
    assert np.allclose(models.limits, whole.limits, atol=1e-4)


def plain_letters(text):
    out, spaced = "", True
    for c in text or "":
        if c.isalpha():
            out, spaced = out + (c.lower() if len(c.lower()) == 1 else c), False
        elif not spaced:
            out, spaced = out + " ", True
    return "   " + out


def plain_kneser_ney(texts):
    """The probability of a character after others, from dictionaries."""
    from collections import Counter

    four = Counter(t[i - 3 : i + 1] for t in map(plain_letters, texts) for i in range(3, len(t)))
    n = {4: four}
    for k in (3, 2, 1):
        n[k] = Counter(g[1:] for g in n[k + 1])
    mass, kinds, discount = {}, {}, {}
    for k in n:
        mass[k], kinds[k] = Counter(), Counter()
        for g, x in n[k].items():
            mass[k][g[:-1]] += x
            kinds[k][g[:-1]] += 1
        once, twice = (sum(x == y for x in n[k].values()) for y in (1, 2))
        discount[k] = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))

    def p(g, alphabet):
        k = len(g)
        if not k:
            return 1 / (alphabet + 1)
        if not mass[k][g[:-1]]:
            return p(g[1:], alphabet)
        d, m = discount[k], mass[k][g[:-1]]
        return max(n[k][g] - d, 0) / m + d * kinds[k][g[:-1]] / m * p(g[1:], alphabet) if n[k][g] else d * kinds[k][g[:-1]] / m * p(g[1:], alphabet)

    return p, {g[-1] for g in four}


def test_language_id_equals_plain_kneser_ney(spark):
    r = random.Random(21)
    letters = {"aa": "abcde ", "bb": "abxyz ", "cc": "éàbcd ", "dd": "abxyz "}
    taught = {x: ["".join(r.choice(y) for _ in range(r.randrange(5, 200))) for _ in range(15)] for x, y in letters.items()}
    taught["dd"] = taught["bb"]  # a tie, which the first language wins
    rows = [(k, t, x) for k, (x, t) in enumerate((x, t) for x, ts in taught.items() for t in ts)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_docs=10**6)
    assert model.languages == sorted(letters)
    asked = ["".join(r.choice("abcdexyzéà  Q!") for _ in range(r.randrange(1, 80))) for _ in range(40)] + ["ababab", "xyz", "ÉÀ", "q", "x" * 3000]
    plain = {x: plain_kneser_ney(ts) for x, ts in taught.items()}
    alphabet = len(set().union(*(c for _, c in plain.values())))
    got = language_id.identify(spark.createDataFrame([(k, t, "old") for k, t in enumerate(asked)], "doc_id long, text string, lang_pred string").coalesce(1), model).orderBy("doc_id").collect()
    for x, t in zip(got, asked):
        if not any(c.isalpha() for c in t):
            assert x.lang_pred == "und"
            continue
        seen = plain_letters(t)
        ce = {name: -sum(np.log(p(seen[i - 3 : i + 1], alphabet)) for i in range(3, len(seen))) / (len(seen) - 3) for name, (p, _) in plain.items()}
        least = min(ce.values())
        assert abs(x.cross_entropy - least) < 1e-4
        assert ce[x.lang_pred] < least + 1e-4 and x.lang_pred != "dd"
        assert abs(x.score - 1 / sum(np.exp(least - y) for y in ce.values())) < 1e-3


def test_language_model_sums_to_one():
    grams = ["   a", "  ab", " ab ", "   b", "  ba", " ba ", "   a"]
    lang = np.array([0, 0, 0, 0, 0, 0, 1])
    model = language_id.smooth(["x", "y"], lang, grams, np.array([3, 2, 2, 1, 1, 1, 2]))
    total = np.zeros(2)
    for c in "ab ":
        text = "   " + c
        chars = np.array([ord(x) for x in text], np.uint64)
        from tracewright.llm.language_id import _find, _hashes

        hs = _hashes(chars)
        logp = np.zeros(2)
        for k in range(4, 0, -1):
            keys, lp, index = model.grams[k]
            at = _find(keys, index, hs[k][3:4])[0]
            if at >= 0:
                logp += lp[at]
                break
            if k > 1:
                keys, left, index = model.contexts[k - 1]
                at = _find(keys, index, hs[k - 1][2:3])[0]
                logp += left[at] if at >= 0 else 0
            else:
                logp += model.unknown
        total += np.exp(logp)
    total += np.exp(model.contexts[3][1][_find(model.contexts[3][0], model.contexts[3][2], hs[3][2:3])[0]] + model.contexts[2][1][_find(model.contexts[2][0], model.contexts[2][2], hs[2][2:3])[0]] + model.contexts[1][1][_find(model.contexts[1][0], model.contexts[1][2], hs[1][2:3])[0]] + model.unknown)
    assert np.allclose(total, 1, atol=1e-4)


def test_hash_is_sha256_of_joined_items(spark):
    from tracewright.llm import queries

    row = queries.op3_benchmark_decontamination(spark, SF).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_license_scan_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    from tracewright.llm import queries

    texts = [*EDGE[:-1], "The MIT License. GNU General Public License, Apache  License", "cc by cc by sa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "gnu lesser general public license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "this program is free software you can redistribute it under terms of gnu general public license"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.sql(queries.ORACLE_SQL["op4_license_scan"] + " ORDER BY doc_id")
    got = license_scan.scan(frame(spark, texts).select("doc_id", "text")).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in want.columns) for r in got] == want.fetchall()
    # repeated rows are each reported, with what each says alone
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    once = license_scan.scan(frame(spark, texts)).collect()
    twice = license_scan.scan(frame(spark, texts + texts, [*range(len(texts))] * 2)).collect()
    assert sorted(map(key, twice)) == sorted(map(key, once + once))


def test_license_without_its_rarest_words_is_found(spark):
    """Everything but the mandatory phrase of a notice may be what other files lack, as long as enough of its IDF stands."""
    import duckdb
    import pandas as pd

    from tracewright.llm import queries

    notice = next(t for t in license_scan.TEMPLATES if t.label == "bsd" and "modification" in t.words)
    own = notice.words.split()
    common = [w for w in own if w not in ("modification", "permitted", "conditions", "met")]
    texts = [" ".join(own[:k]) for k in range(2, 15)] * 8 + [" ".join(reversed(common))] * 4
    changed = ["changed" if w in ("modification", "permitted", "conditions", "met") else w for w in own]
    texts += ["some words " + " ".join(changed) + " and more", " ".join(own)]
    texts += [" ".join(x if r.random() > 0.1 else "other" for x in t.words.split()) for r in [random.Random(9)] for t in license_scan.TEMPLATES for _ in range(3)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.sql(queries.ORACLE_SQL["op4_license_scan"] + " ORDER BY doc_id")
    got = license_scan.scan(frame(spark, texts).select("doc_id", "text")).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in want.columns) for r in got] == want.fetchall()
    assert sum(x.labels != "" for x in got[-64:]) > 20
