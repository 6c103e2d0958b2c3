"""Reads of a ledger: envelopes, replays, and navigation between sessions along stated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered

SESSION_EDGES = ("parent_session", "spawned_by", "forked_from")


def event_envelopes(observations: DataFrame, events: DataFrame, relationships: DataFrame) -> DataFrame:
    """An envelope per event: its observation, the event, and its relationships sorted by type and target, in one pass."""
    edges = relationships.groupBy(F.col("source_trace_uuid").alias("trace_uuid")).agg(F.sort_array(F.collect_list(F.struct("relationship_type", "target_native_id"))).alias("relationships"))
    rows = events.join(observations, "observation_uuid").join(edges, "trace_uuid", "left")
    return rows.withColumn("relationships", F.coalesce("relationships", F.array().cast("array<struct<relationship_type:string,target_native_id:string>>")))


def replay_stream(rows: DataFrame, streams: DataFrame | None = None, order: tuple[str, ...] = ("source_position", "part_order")) -> DataFrame:
    """Rows of one or many streams with `ordinal` (from 1) in the order of their positions (a number first); streams: stream, or
    all. Large streams are numbered in ranges."""
    if streams is not None:
        rows = rows.join(streams.select("stream").distinct(), "stream", "left_semi")
    return numbered(rows, ["stream"], F.col(order[0]).cast("double"), list(order), "ordinal")


def replay_session(traces: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Traces of one or many sessions with `ordinal` in the order of time and id; large sessions are numbered in ranges."""
    if sessions is not None:
        traces = traces.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return numbered(traces, ["session_id"], F.col("ts").cast("timestamp").cast("double"), ["ts", "trace_uuid"], "ordinal")


def _candidates(streams: DataFrame) -> DataFrame:
    """What a native id names under a binding, and how many streams claim it, permitted or not."""
    return streams.groupBy("binding", F.coalesce("child_id", "external_session_id").alias("native_id")).agg(F.count("*").alias("claims"), F.first("stream").alias("target"), F.first("namespace").alias("target_namespace"))


def outgoing_edges(relationships: DataFrame, streams: DataFrame, allowed: list[str]) -> DataFrame:
    """session, related, availability, relationship, native_id of the stated edges of every stream.

    relationships: stream, relationship_type, target_stream (or null), native_id. A stated stream is the target; else the one
    stream of the same binding with that native id. A target that is missing, claimed by several or of a namespace that isn't
    allowed is unavailable and isn't named.
    """
    edges = relationships.filter(F.col("relationship_type").isin(*SESSION_EDGES)).join(streams.select("stream", "binding"), "stream")
    stated = streams.select(F.col("stream").alias("target_stream"), F.col("namespace").alias("__ns"))
    rows = edges.join(stated, "target_stream", "left").join(_candidates(streams), ["binding", "native_id"], "left")
    explicit = F.col("target_stream").isNotNull()
    ns = F.when(explicit, F.col("__ns")).otherwise(F.when(F.col("claims") == 1, F.col("target_namespace")))
    target = F.when(explicit, F.col("target_stream")).otherwise(F.col("target"))
    ok = F.coalesce(ns.isin(*allowed), F.lit(False))
    return rows.select(F.col("stream").alias("session"), F.lit("outgoing").alias("direction"), F.when(ok, "available").otherwise("unavailable").alias("availability"), F.col("relationship_type").alias("relationship"), "native_id", F.when(ok, target).alias("related"))


def incoming_edges(relationships: DataFrame, streams: DataFrame, allowed: list[str]) -> DataFrame:
    """The same edges seen from their targets, as far as their sources are allowed."""
    out = outgoing_edges(relationships, streams, [r for r in allowed]).filter("availability = 'available'")
    source = streams.select(F.col("stream").alias("session"), F.col("namespace").alias("__ns"))
    rows = out.join(source, "session").filter(F.col("__ns").isin(*allowed))
    return rows.select(F.col("related").alias("session"), F.lit("incoming").alias("direction"), "availability", "relationship", "native_id", F.col("session").alias("related"))


def navigate_sessions(relationships: DataFrame, streams: DataFrame, sessions: DataFrame, allowed: list[str]) -> DataFrame:
    """Outgoing and incoming edges of the given sessions; one that is missing or not allowed is a row with an error."""
    known = sessions.select("session").distinct().join(streams.select(F.col("stream").alias("session"), "namespace"), "session", "left")
    ok = known.filter(F.col("namespace").isin(*allowed)).select("session")
    edges = outgoing_edges(relationships, streams, allowed).unionByName(incoming_edges(relationships, streams, allowed)).join(ok, "session", "left_semi")
    bad = known.filter(~F.coalesce(F.col("namespace").isin(*allowed), F.lit(False))).select("session", F.lit("not_permitted").alias("error"))
    return edges.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def dangling_edges(relationships: DataFrame, streams: DataFrame) -> DataFrame:
    """Session edges whose target was never captured."""
    edges = relationships.filter(F.col("relationship_type").isin(*SESSION_EDGES)).join(streams.select("stream", "binding"), "stream")
    by_id = edges.filter("target_stream is null").join(_candidates(streams).select("binding", "native_id"), ["binding", "native_id"], "left_anti")
    by_stream = edges.filter("target_stream is not null").join(streams.select(F.col("stream").alias("target_stream")), "target_stream", "left_anti")
    columns = ["stream", "relationship_type", "target_stream", "native_id"]
    return by_id.select(*columns).unionByName(by_stream.select(*columns))


def pair_tool_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """stream, call_id, tool, outcome: calls with the results that name them, wherever these stand; a call without one is
    incomplete, which is no failure. calls: stream, call_id, tool; results: stream, call_id, outcome."""
    return calls.join(results.select("stream", "call_id", "outcome"), ["stream", "call_id"], "left").select("stream", "call_id", "tool", F.coalesce("outcome", F.lit("incomplete")).alias("outcome"))
