"""Trace events that jobs leave behind: columns with a deterministic id, and the names of those who act."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ids import deterministic_id

TRACE = "trace_uuid string, session_id string, agent_id string, namespace string, event_type string, content string, refs array<string>, ts timestamp"


def actor_name(actor: Column) -> Column:
    """People are `human:<name>`, unless their name has a prefix."""
    return F.when(actor.contains(":"), actor).otherwise(F.concat(F.lit("human:"), actor))


def trace_columns(session: Column, agent: Column, namespace: Column, event: Column, content: Column, refs: Column, ts: Column) -> list[Column]:
    """The columns of TRACE; null references are left out."""
    refs = F.filter(refs, lambda r: r.isNotNull())
    ident = deterministic_id("trace", session, event, agent, ts, F.array_join(refs, ","), content)
    return [ident.alias("trace_uuid"), session.alias("session_id"), agent.alias("agent_id"), namespace.alias("namespace"), event.alias("event_type"), content.alias("content"), refs.alias("refs"), ts.alias("ts")]
