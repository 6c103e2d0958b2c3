"""The registered queries of this folder's operators, one each over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, backoff_lm, chat, decontaminate, fingerprint, jaccard_join, language_id, license_scan, minhash, packing, token_counts, warc, whitening
from .common import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).drop("edited")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(manifest, folder)
    key = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    return records.select(key("page_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to_key").alias("refers_to"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, sf_dir, "documents")), F.col("n_words")).drop("n_words")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"), order=backoff_lm.ORDER).withColumn("score", F.round("score", 9))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.teaching(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.with_counts(staged(found.drop("text"), "aligned"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.points(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_benchmark_decontamination, op4_license_scan, op5_document_fingerprints, op6_warc, op7_packing, op8_lm_scoring, op9_token_counts, op10_language_id, op11_cross_tokenizer_alignment, op12_minhash_near_dedup, op13_embedding_whitening)}
ORACLE_SQL = {
    "op2_chat_formatting": r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn NULLS FIRST, role, text) AS s,
                 string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM turns GROUP BY conv_id),
heads AS (SELECT DISTINCT array_to_string(s[1:k], chr(2)) AS p FROM (SELECT s, unnest(range(1, len(s))) AS k FROM whole)),
one AS (SELECT array_to_string(s, chr(2)) AS p, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY 1)
SELECT o.conv_id, CAST(len(w.s) AS BIGINT) AS n_turns, CAST(o.n_copies AS BIGINT) AS n_copies, w.rendered
FROM one AS o JOIN whole AS w USING (conv_id) WHERE o.p NOT IN (SELECT p FROM heads)
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN m.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top <> p.page_id THEN m.top END AS refers_to
FROM p LEFT JOIN m ON m.d = p.d AND p.n >= 1000
""",
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles AS x JOIN shingles AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links
FROM documents AS d LEFT JOIN sizes AS s USING (doc_id) LEFT JOIN least AS l ON l.a = d.doc_id LEFT JOIN degree AS g ON g.a = d.doc_id
""",
    "op3_benchmark_decontamination": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 13) AS k, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM words),
hits AS (SELECT DISTINCT p.doc_id, p.s, n.k, n.item_id
         FROM (SELECT DISTINCT k FROM windows) AS z, places AS p, windows AS n
         WHERE p.s + z.k - 1 <= len(p.w) AND n.k = z.k AND n.g = array_to_string(p.w[p.s:p.s + z.k - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT c) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS c FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w.w) AS contaminated
FROM words AS w LEFT JOIN covered AS c USING (doc_id) LEFT JOIN named AS m USING (doc_id)
"""
}


def _license_sql() -> str:
    """The scan over exploded words: matches of a template's words are gathered by the place where it would begin."""
    rows = []
    for k, t in enumerate(license_scan.TEMPLATES):
        own = t.words.split()
        must = {i + j for p in t.mandatory for i in range(len(own)) if own[i : i + len(p.split())] == p.split() for j in range(len(p.split()))}
        rows += [f"({k}, '{t.label}', {t.base}, {len(must) == len(own)}, {i}, '{w}', {i in must})" for i, w in enumerate(own)]
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM words),
template AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(tid, label, base, whole, pos, word, must)),
idf AS (SELECT v.word, ln((SELECT count(*) + 1 FROM documents) / (count(DISTINCT p.doc_id) + 1)) AS x FROM (SELECT DISTINCT word FROM template) AS v LEFT JOIN place AS p USING (word) GROUP BY 1),
total AS (SELECT tid, any_value(label) AS label, any_value(base) AS base, any_value(whole) AS whole, sum(x) AS x, count_if(must) AS n FROM template JOIN idf USING (word) GROUP BY tid),
met AS (SELECT p.doc_id, t.tid, p.i - t.pos AS spot, sum(x) AS x, count_if(t.must) AS n FROM place AS p JOIN template AS t USING (word) JOIN idf USING (word) GROUP BY ALL),
found AS (SELECT m.doc_id, t.label, t.base, m.spot, CASE WHEN t.whole THEN 1.0 ELSE least(round(m.x / t.x, 9), 1.0) END AS share FROM met AS m JOIN total AS t USING (tid) WHERE m.spot >= 0 AND m.n = t.n AND (t.whole OR m.x / t.x >= 0.75)),
each AS (SELECT doc_id, count_if(base) AS n, min(spot) FILTER (WHERE base) AS a, max(spot) FILTER (WHERE base) AS b, max(share) AS score,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(e.n, 0) AS BIGINT) AS n_base, CAST(e.a AS BIGINT) AS first_word, CAST(e.b AS BIGINT) AS last_word,
       coalesce(e.base_labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CAST(coalesce(e.score, 0.0) AS DOUBLE) AS score
FROM words AS w LEFT JOIN each AS e USING (doc_id)
"""


ORACLE_SQL["op4_license_scan"] = _license_sql()
ORACLE_SQL["op12_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 1], ' ') AS g
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles AS x JOIN shingles AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents AS d LEFT JOIN sizes AS s USING (doc_id) LEFT JOIN least AS l ON l.a = d.doc_id
"""
ORACLE_SQL["op8_lm_scoring"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
g AS (SELECT r, i, n, c, lag(c) OVER s AS b, lag(c, 2) OVER s AS a FROM p WINDOW s AS (PARTITION BY r ORDER BY i)),
one AS (SELECT c, count(*) AS n, count_if(i < n) AS followed FROM g GROUP BY c),
two AS (SELECT b, c, count(*) AS n, count_if(i < n) AS followed FROM g WHERE b IS NOT NULL GROUP BY ALL),
three AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL),
own2 AS (SELECT r, b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
own3 AS (SELECT r, a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT g.r, CASE WHEN three.n > own3.n THEN ln((three.n - own3.n) / x2.followed)
                       ELSE CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN two.n > own2.n THEN ln((two.n - own2.n) / x1.followed) ELSE CASE WHEN g.b IS NULL THEN 0 ELSE ln(0.4) END + ln(one.n / (SELECT count(*) FROM p)) END END AS v
      FROM g JOIN one ON one.c = g.c LEFT JOIN two ON two.b = g.b AND two.c = g.c LEFT JOIN own2 ON own2.r = g.r AND own2.b = g.b AND own2.c = g.c LEFT JOIN one AS x1 ON x1.c = g.b
      LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c LEFT JOIN own3 ON own3.r = g.r AND own3.a = g.a AND own3.b = g.b AND own3.c = g.c LEFT JOIN two AS x2 ON x2.b = g.a AND x2.c = g.b)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, round(avg(v), 9) AS score FROM d LEFT JOIN s USING (r) GROUP BY r, d.doc_id
"""
