"""Provenance questions, for any number of sessions, memories or claims at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.staging import staged
from ..functions.text import lexemes
from .search import superseders


def consumed(traces: DataFrame, memories: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, ts, trace_uuid, kind, item, source and agent_id of every memory and trace that a session read.

    traces have refs array<...>; a ref that a row repeats counts once. sessions: session_id, or all.
    """
    rows = traces.filter(F.col("event_type").isin("memory_consumed", "trace_consumed"))
    if sessions is not None:
        rows = rows.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    rows = rows.select("session_id", "ts", "trace_uuid", "agent_id", "event_type", F.explode(F.array_distinct("refs")).alias("item"))
    read = lambda kind: rows.filter(F.col("event_type") == f"{kind}_consumed").drop("event_type")
    m = read("memory").join(memories.select(F.col("uuid").alias("item"), F.col("source_id").alias("source")), "item").withColumn("kind", F.lit("memory"))
    t = read("trace").join(traces.select(F.col("trace_uuid").alias("item"), F.col("event_type").alias("source")), "item").withColumn("kind", F.lit("trace"))
    return m.unionByName(t)


def why(memories: DataFrame, roots: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """root, depth, uuid, version, status, source_id (and source_event, given traces) of each memory on the chain of
    predecessors of each root (uuid).

    Chains are walked for all roots together by pointer doubling: after round r every row knows its 2^r-th predecessor, so
    a chain of length n takes log2(n) joins, however long it is. A memory that a chain meets twice ends it.
    """
    kept = lambda df: staged(df, "why")
    start = roots.select("uuid").distinct()
    jump = kept(memories.filter("supersedes is not null").select(F.col("uuid").alias("at"), F.col("supersedes").alias("to")).distinct())
    known = memories.select("uuid")
    reach = kept(start.join(known, "uuid").select(F.col("uuid").alias("root"), F.lit(0).alias("depth"), "uuid"))
    step = 1
    while True:
        more = reach.join(jump, F.col("uuid") == F.col("at")).select("root", (F.col("depth") + step).alias("depth"), F.col("to").alias("uuid")).join(known, "uuid")
        grown = kept(reach.unionByName(more).groupBy("root", "uuid").agg(F.min("depth").alias("depth")).select("root", "depth", "uuid"))
        if grown.count() == reach.count():
            break
        reach = grown
        jump = kept(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.at")).select(F.col("a.at"), F.col("b.to")).distinct())
        step *= 2
    rows = reach.join(memories.select("uuid", "version", "status", "source_type", "source_id"), "uuid")
    if traces is None:
        return rows.drop("source_type")
    named = traces.select(F.col("trace_uuid").cast("string").alias("__t"), F.col("event_type").alias("source_event"))
    return rows.join(named, (F.col("source_type") == "trace") & (F.col("source_id") == F.col("__t")), "left").drop("__t", "source_type")


def derived_from(memories: DataFrame, sources: DataFrame) -> DataFrame:
    """Every memory of each source_id."""
    return memories.join(sources.select("source_id").distinct(), "source_id", "left_semi")


def claim_in_consumed(traces: DataFrame, memories: DataFrame, claims: DataFrame) -> DataFrame:
    """session_id, claim and supported: whether anything that the session read holds all of the claim's words."""
    asked = claims.select("session_id", "claim").distinct().withColumn("__words", F.array_distinct(lexemes(F.col("claim"))))
    wanted = asked.select("session_id", "claim", F.size("__words").alias("n"), F.explode("__words").alias("word"))
    read = consumed(traces, memories, asked).select("session_id", "kind", "item").distinct()
    texts = memories.select(F.lit("memory").alias("kind"), F.col("uuid").alias("item"), "content").unionByName(traces.select(F.lit("trace").alias("kind"), F.col("trace_uuid").alias("item"), "content"))
    texts = texts.join(read.select("kind", "item").distinct(), ["kind", "item"], "left_semi")
    # each text that any session read is cut into words once, and only words that some claim has go on
    held = texts.select("kind", "item", F.explode(F.array_distinct(lexemes(F.col("content")))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    met = read.join(held, ["kind", "item"]).join(wanted, ["session_id", "word"])
    hits = met.groupBy("session_id", "claim", "n", "kind", "item").count().filter("count = n")
    found = hits.select("session_id", "claim").distinct().withColumn("__yes", F.lit(True))
    return asked.drop("__words").join(found, ["session_id", "claim"], "left").select("session_id", "claim", F.coalesce("__yes", F.lit(False)).alias("supported"))


def adjudicate(memories: DataFrame, pairs: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Two memories (a, b) side by side: time, source, version, status, newer one, and whether one supersedes the other; with
    traces, who decided on each (the agent of its review events)."""
    columns = ["created_at", "source_id", "version", "status", "supersedes", "agent_id"]
    rows = pairs
    for x in ("a", "b"):
        side = memories.select(F.col("uuid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        rows = rows.join(side, x)
        if traces is not None:
            review = traces.filter(F.col("session_id").startswith("review:")).groupBy(F.substring_index("session_id", ":", -1).alias("__r")).agg(F.max_by("agent_id", "ts").alias(f"decided_by_{x}"))
            rows = rows.join(review, F.col(x).cast("string") == F.col("__r"), "left").drop("__r")
    newer = F.when(F.col("created_at_a") >= F.col("created_at_b"), F.col("a")).otherwise(F.col("b"))
    direct = F.coalesce((F.col("supersedes_a") == F.col("b")) | (F.col("supersedes_b") == F.col("a")), F.lit(False))
    return rows.withColumns({"newer": newer, "supersession": direct})


def show(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole records by uuid, with their newest superseder."""
    return memories.join(ids.select("uuid").distinct(), "uuid", "left_semi").join(superseders(memories), "uuid", "left")


def pending(memories: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """Shared proposals, oldest first by `place` within their namespace."""
    rows = memories.filter("visibility = 'shared' and status = 'proposed'")
    rows = rows.filter(F.col("namespace").isin(namespaces)) if namespaces else rows
    return numbered(rows, ["namespace"], F.col("created_at").cast("double"), ["uuid"])


def duplicate_content(memories: DataFrame) -> DataFrame:
    """namespace, content_hash, n and first uuid of contents that a namespace holds more than once."""
    return memories.groupBy("namespace", F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("uuid").alias("first_uuid")).filter("n > 1")
