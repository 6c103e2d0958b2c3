"""Licence scan with a positional rare-token index, in DataFrame functions only.

One aggregation counts in how many files each licence word occurs. The postings name, for a word, the templates it leads to
and its place in them: a template is posted under the word of highest IDF of its mandatory phrases. As these must stand in
full, no notice lacks that word. A file that holds such a phrase looks its rare words up, the postings are intersected by
where a template would begin, and a place counts if its mandatory phrases stand there and the words found carry enough of
the template's IDF. All this happens within a row: nothing is shuffled but the word counts.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's IDF that must stand at a place.
SHARE = 0.75


class Template(NamedTuple):
    label: str
    words: str
    mandatory: tuple[str, ...]
    base: bool = False


#: Phrases, notices and texts of well-known licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", ("gnu general public license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("cc-by", "cc by", ("cc by",), True),
    Template("mit", "mit license", ("mit license",), True),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl", "mozilla public license", ("mozilla public license",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("without even the implied warranty", "gnu general public license")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("licensed under the apache license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("free of charge to any person", "substantial portions of the software")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("is hereby granted",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("boost", "boost software license", ("boost software license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form is subject to the terms",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _low(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text after lower-casing A-Z; none for null."""
    return F.regexp_extract_all(_low(text), F.lit(WORD), F.lit(0))


def idf(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """ln((files + 1) / (files with the word + 1)) of every word of the templates; at most one row a word leaves Spark."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    rows = docs.select(F.explode(F.array_append(F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col(text))), F.lit(""))).alias("word"))
    found = {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}
    return {w: math.log((found.get("", 0) + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


class _Index(NamedTuple):
    """The templates as constant columns, by number: words, their shares of the IDF, which of them are mandatory, whether
    nothing else counts, and the postings of their rare words."""

    words: Column
    shares: Column
    mandatory: Column
    whole: Column
    rare: list[str]
    postings: Column
    gate: str


def _index(templates: tuple[Template, ...], weight: dict[str, float]) -> _Index:
    own = [t.words.split() for t in templates]
    must, post, shares = [], {}, []
    for k, t in enumerate(templates):
        phrases = [p.split() for p in t.mandatory]
        at = {i + j for p in phrases for i in range(len(own[k])) if own[k][i : i + len(p)] == p for j in range(len(p))}
        total = sum(weight[w] for w in own[k])
        at = at if total else set(range(len(own[k])))
        must.append([i in at for i in range(len(own[k]))])
        shares.append([weight[w] / total if total else 0.0 for w in own[k]])
        probe = max(sorted(at), key=lambda i: weight[own[k][i]])
        post.setdefault(own[k][probe], []).append((k, probe))
    literal = lambda rows: F.array(*(F.array(*map(F.lit, x)) for x in rows))
    pairs = lambda xs: F.array(*(F.struct(F.lit(k).alias("tid"), F.lit(i).alias("pos")) for k, i in xs))
    gate = "|".join(sorted({_GAP.join(t.mandatory[0].split()) for t in templates}))
    return _Index(literal(own), literal(shares), literal(must), F.array(*(F.lit(all(m)) for m in must)), sorted(post), F.create_map(*(x for w in sorted(post) for x in (F.lit(w), pairs(post[w])))), gate)


def _found(w: str, index: _Index) -> Column:
    """tid, at and share of every place in a file's words where a template stands."""
    looked_up = F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(index.rare), F.struct(i.alias("i"), x.alias("x")))), lambda o: o.isNotNull())
    begins = F.flatten(F.transform(looked_up, lambda o: F.transform(index.postings[o["x"]], lambda p: F.struct(p["tid"].alias("tid"), (o["i"] - p["pos"]).alias("at")))))
    begins = F.array_distinct(F.filter(begins, lambda p: p["at"] >= 0))  # a place before the file's start can hold no whole template

    def judged(p: Column) -> Column:
        of = lambda table: F.element_at(table, p["tid"] + 1)
        here = F.slice(F.col(w), p["at"] + 1, F.size(of(index.words)))
        same = F.zip_with(here, of(index.words), lambda a, b: F.coalesce(a == b, F.lit(False)))
        stand = F.forall(F.zip_with(same, of(index.mandatory), lambda s, m: s | ~m), lambda x: x)
        share = F.aggregate(F.zip_with(same, of(index.shares), lambda s, x: F.when(s, x).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        share = F.when(~stand, 0.0).when(F.element_at(index.whole, p["tid"] + 1), 1.0).otherwise(F.least(F.round(share, 9), F.lit(1.0)))
        return F.struct(p["tid"].alias("tid"), p["at"].alias("at"), share.alias("share"))

    return F.filter(F.transform(begins, judged), lambda p: p["share"] >= SHARE)


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word (places of the base phrases, words from 0), base_labels, labels (of
    all templates found; sorted, comma-joined) and score (the largest share of a template's IDF found, 0 to 1).

    A null text is empty; a text without words or licences has no places and empty labels. Repeated rows are each scanned;
    columns of docs with these names are replaced, all others pass. Every template needs a mandatory phrase.
    """
    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = without(docs, out)
    index = _index(templates, idf(docs, text, templates))
    low = _low(F.col(text))
    rows = docs.withColumn("n_words", F.regexp_count(low, F.lit(WORD)).cast("long"))
    rows = rows.withColumn("__w", F.when(low.rlike(index.gate), F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__found", _found("__w", index))
    base = F.array(*(F.lit(t.base) for t in templates))
    label = F.array(*(F.lit(t.label) for t in templates))
    rows = rows.withColumn("__base", F.filter("__found", lambda p: F.element_at(base, p["tid"] + 1)))
    places = F.transform("__base", lambda p: p["at"].cast("long"))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: F.element_at(label, p["tid"] + 1)))), ",")
    score = F.coalesce(F.array_max(F.transform("__found", lambda p: p["share"])), F.lit(0.0))
    return rows.select(*docs.columns, "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), named("__base").alias("base_labels"), named("__found").alias("labels"), score.alias("score"))
