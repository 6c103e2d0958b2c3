"""Ledger tables derived from the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "labels", "events", "conversations", "pages", "benchmark")

#: Each view over {tables} and earlier views. Times are seconds.
VIEWS = {
    "memories": """
SELECT d.doc_id AS uuid, d.lang AS namespace,
       CASE d.doc_id % 5 WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' WHEN 3 THEN 'runbook' WHEN 4 THEN 'note' ELSE 'fact' END AS type,
       CASE WHEN d.doc_id % 5 = 0 THEN 'private' ELSE 'shared' END AS visibility,
       CASE WHEN l.quality = 1 THEN 'approved' WHEN l.quality = 0 THEN 'rejected' ELSE 'proposed' END AS status,
       'warm' AS tier, d.text AS content, 'trace' AS source_type, d.source AS source_id, concat('agent', CAST(d.doc_id % 7 AS STRING)) AS agent_id,
       CAST(d.doc_id % 4 + 1 AS INT) AS version, CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id - 1 END AS supersedes,
       1704067200 + d.doc_id * 60 AS created_at
FROM {documents} AS d LEFT JOIN {labels} AS l ON l.doc_id = d.doc_id""",
    "traces": """
SELECT event_id AS trace_uuid, concat('u', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
       concat('agent', CAST(user_id % 7 AS STRING)) AS agent_id, CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS namespace,
       CASE event_type WHEN 'view' THEN 'memory_consumed' WHEN 'click' THEN 'trace_consumed' ELSE event_type END AS event_type, props AS content,
       CASE event_type WHEN 'view' THEN (event_id * 7919) % 1000 WHEN 'click' THEN event_id - event_id % 97 END AS ref, ts
FROM {events}""",
    "observations": """
SELECT conv_id AS stream, turn AS source_position, concat('n', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS native_id, role AS actor, text AS payload,
       concat('ns', CAST(conv_id % 5 AS STRING)) AS namespace
FROM {conversations} WHERE (conv_id * 31 + turn) % 11 <> 0""",
    "batch": """
SELECT conv_id AS stream, turn AS source_position, concat('n', CAST(conv_id AS STRING), '-', CAST(CASE WHEN (conv_id + turn) % 13 = 5 THEN turn + 1000 ELSE turn END AS STRING)) AS native_id,
       CASE WHEN (conv_id + turn) % 17 = 3 THEN concat(coalesce(text, ''), ' changed') ELSE text END AS payload, conv_id * 100 + turn AS ingest
FROM {conversations}""",
    "edges": """
SELECT DISTINCT conv_id AS source, CAST(floor(conv_id / 2) AS BIGINT) + CASE WHEN conv_id % 9 = 4 THEN 1000000 ELSE 0 END AS target, CASE conv_id % 3 WHEN 0 THEN 'parent_session' WHEN 1 THEN 'forked_from' ELSE 'spawned_by' END AS relationship
FROM {conversations} WHERE conv_id > 0""",
    "evidence": "SELECT page_id AS stream, url FROM {pages}",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in _needs(VIEWS[name])})


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views it names in braces."""
    used: list[str] = []

    def add(text: str) -> None:
        for x in _needs(text):
            if x in VIEWS and x not in used:
                add(VIEWS[x])
                used.append(x)

    add(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = [f"{x} AS ({plain(VIEWS[x])})" for x in used]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    return f"WITH {', '.join(ctes)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(ctes)} {body}"
