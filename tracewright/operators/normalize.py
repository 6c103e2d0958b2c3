"""Transcript records into typed events and edges, as column expressions over parsed JSON.

records: stream, source_position, value. Every record gives at least one event; what isn't known stays whole as `opaque`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import deterministic_id

#: Names of record kinds, roles and outcomes in transcripts.
CALLS = ("function_call", "custom_tool_call", "local_shell_call", "tool_search_call", "web_search_call", "image_generation_call")
SPECIALIZED = ("local_shell_call", "web_search_call", "image_generation_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "local_shell_call_output", "tool_search_output")
VIEWS = ("turn_started", "agent_reasoning", "context_compacted", "user_message", "agent_message", "exec_command_begin", "exec_command_end", "patch_apply_begin", "patch_apply_end")
ROLES = ("user", "assistant", "system", "developer", "tool")
OUTCOMES = ("succeeded", "failed", "declined", "interrupted", "unknown")

_EDGE = "struct<type:string,native_id:string,kind:string>"
_EVENT = f"struct<part_key:string,part_order:int,kind:string,actor:string,payload:string,edges:array<{_EDGE}>>"


class Normalized(NamedTuple):
    observations: DataFrame
    events: DataFrame
    relationships: DataFrame


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def shape(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, BIGINT, … of a variant; null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def string_at(v: Column, path: str) -> Column:
    """A field that is a string, else null (a number isn't one)."""
    found = get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.trim(get(found, "$")), F.lit("")))


def string_or_name(v: Column, path: str) -> Column:
    """A field that is a string, or an object's `name`."""
    return F.coalesce(string_at(v, path), F.when(shape(get(v, path, "variant")) == "OBJECT", string_at(v, f"{path}.name")))


def source_timestamp(v: Column) -> Column:
    """struct<raw, parsed>; parsed is null where raw can't be read."""
    raw = string_at(v, "$.timestamp")
    return F.struct(raw.alias("raw"), F.try_to_timestamp(raw).alias("parsed"))


def actor_role(role: Column) -> Column:
    """A role of the closed set, else unknown; it is never guessed from the kind of event."""
    return F.when(role.isin(*ROLES), role).otherwise("unknown")


def tool_outcome(v: Column) -> Column:
    """outcome if it is of the closed set, else by status, else by the truth value of success, else unknown."""
    status = F.lower(string_at(v, "$.status"))
    by_status = F.when(status.isin("completed", "succeeded"), "succeeded").when(status == "failed", "failed").when(status.isin("declined", "denied"), "declined").when(status.isin("interrupted", "cancelled", "canceled"), "interrupted")
    success = get(v, "$.success", "boolean")
    given = string_at(v, "$.outcome")
    return F.coalesce(F.when(given.isin(*OUTCOMES), given), by_status, F.when(success, "succeeded").when(~success, "failed"), F.lit("unknown"))


def _nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text are nested."""
    marks = F.regexp_extract_all(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])


def flatten_text(v: Column) -> Column:
    """Text of a string, of an array joined by newlines, of {text} or {content}, one in the other to any depth; JSON of all
    else. What isn't text yet is opened in place, as often as the value is deep."""
    nothing = F.try_parse_json(F.lit(None).cast("string"))
    item = lambda text, rest: F.struct(text.cast("string").alias("text"), rest.alias("rest"))

    def opened(x: Column) -> Column:
        r = x["rest"]
        kind, content, parts = shape(r), get(r, "$.content", "variant"), get(r, "$", "array<variant>")
        leaf = F.when(kind == "STRING", get(r, "$")).when(kind == "OBJECT", F.coalesce(string_at(r, "$.text"), F.when(content.isNull(), F.to_json(r)))).when(kind != "ARRAY", F.to_json(r)).when(F.size(parts) == 0, "")
        return F.when(r.isNull(), F.array(x)).when(leaf.isNotNull(), F.array(item(leaf, nothing))).when(kind == "OBJECT", F.array(item(F.lit(None), content))).otherwise(F.transform(parts, lambda y: item(F.lit(None), y)))

    rounds = F.sequence(F.lit(0), _nesting(F.to_json(v)))
    found = F.aggregate(rounds, F.array(item(F.lit(None), v)), lambda a, _: F.flatten(F.transform(a, opened)))
    return F.when(shape(v) == "STRING", get(v, "$")).when(v.isNotNull(), F.array_join(F.transform(found, lambda x: x["text"]), "\n"))


def _event(key, order, kind: str, actor: Column | None, payload: Column, edges: Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast(f"array<{_EDGE}>")
    return F.struct(as_col(key).alias("part_key"), as_col(order).cast("int").alias("part_order"), F.lit(kind).alias("kind"), (actor if actor is not None else F.lit("unknown")).alias("actor"), payload.alias("payload"), (edges if edges is not None else none).alias("edges"))


def _edges(*pairs: tuple[str, Column, str]) -> Column:
    """Edges whose target is stated; none is dropped as a repeat."""
    given = F.array(*(F.when(target.isNotNull(), F.struct(F.lit(t).alias("type"), target.alias("native_id"), F.lit(kind).alias("kind"))) for t, target, kind in pairs))
    return F.filter(given, lambda e: e.isNotNull())


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _whole(p: Column) -> Column:
    return _json(source=p)


def _messages(p: Column, content_path: str = "$.content") -> Column:
    """A message for each text part of a content array, opaque for other parts and shapes; a plain text is one message."""
    content = get(p, content_path, "variant")
    actor = F.col("__actor")

    def part(x: Column, i: Column) -> Column:
        text = F.when(shape(x) == "STRING", get(x, "$")).when(string_at(x, "$.type").isin("input_text", "output_text", "text"), get(x, "$.text"))
        key = F.concat(F.lit("content/"), i.cast("string"))
        return F.when(text.isNotNull(), _event(F.concat(key, F.lit(":message")), i, "message", actor, _json(text=text))).otherwise(_event(F.concat(key, F.lit(":opaque")), i, "opaque", actor, _whole(x)))

    parts = get(p, content_path, "array<variant>")
    one = F.array(_event("content:message", 0, "message", actor, _json(text=get(p, content_path))))
    opaque = F.array(_event("content:opaque", 0, "opaque", actor, F.col("__part")))
    return F.when(shape(content) == "STRING", one).when((shape(content) == "ARRAY") & (F.size(parts) > 0), F.transform(parts, part)).otherwise(opaque)


def _reasoning(p: Column) -> Column:
    actor = F.col("__actor")

    def section(name: str, kind: str, before: Column) -> Column:
        parts = get(p, f"$.{name}", "array<variant>")

        def part(x: Column, i: Column) -> Column:
            key = F.concat(F.lit(f"{name}/"), i.cast("string"))
            return F.when(string_at(x, "$.type") == kind, _event(F.concat(key, F.lit(":reasoning")), before + i, "reasoning", actor, _json(text=get(x, "$.text"), section=F.lit(name)))).otherwise(_event(F.concat(key, F.lit(":opaque")), before + i, "opaque", actor, _whole(x)))

        field = get(p, f"$.{name}", "variant")
        none = F.array().cast(f"array<{_EVENT}>")
        return F.when(field.isNull() | shape(field).isin("VOID"), none).when(shape(field) == "ARRAY", F.transform(parts, part)).otherwise(F.array(_event(f"{name}:opaque", before, "opaque", actor, _whole(field))))

    first = section("summary", "summary_text", F.lit(0))
    count = F.when(shape(get(p, "$.summary", "variant")) == "ARRAY", F.size(get(p, "$.summary", "array<variant>"))).otherwise(F.when(get(p, "$.summary", "variant").isNotNull(), 1).otherwise(0))
    both = F.concat(first, section("content", "reasoning_text", count))
    return F.when(F.size(both) > 0, both).otherwise(F.array(_event("reasoning:opaque", 0, "opaque", actor, F.col("__part"))))


def _prepared(rows: DataFrame) -> DataFrame:
    """Fields that several branches read, each found once."""
    v, p = F.col("v"), F.col("p")
    given = F.coalesce(get(p, "$.arguments", "variant"), get(p, "$.input", "variant"), get(p, "$.action", "variant"))
    rows = rows.withColumns({"__record": string_at(v, "$.type"), "__hook": string_at(v, "$.hook_event_name"), "__kind": string_at(p, "$.type"), "__actor": actor_role(string_at(p, "$.role")), "__call": string_at(p, "$.call_id"), "__given": given, "__outcome": tool_outcome(p), "__whole": _whole(v), "__part": _whole(p), "__object": F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False))})
    arguments = F.coalesce(F.when(F.schema_of_variant("__given") == "STRING", F.try_parse_json(get(F.col("__given"), "$"))), F.col("__given"))
    return rows.withColumns({"__ident": F.coalesce("__call", string_at(p, "$.id")), "__given": arguments})


def _call(p: Column, position: Column) -> Column:
    ident, arguments = F.col("__ident"), F.col("__given")
    key = F.coalesce(F.concat(F.lit("tool_call:"), ident), F.concat(F.lit("tool_call/"), position.cast("string")))
    name = F.coalesce(string_at(p, "$.name"), F.regexp_replace("__kind", "_call$", ""))
    call = _event(key, 0, "tool_call", None, _json(call_id=ident, tool=name, arguments=arguments))
    ended = F.col("__kind").isin(*SPECIALIZED) & (F.col("__outcome") != "unknown")
    result = F.when(ended, _event(F.concat(F.lit("tool_result:"), F.coalesce(ident, position.cast("string"))), 1, "tool_result", None, _json(call_id=ident, outcome=F.col("__outcome")), _edges(("result_for", ident, "tool_call"))))
    return F.filter(F.array(call, result), lambda e: e.isNotNull())


def _result(p: Column, position: Column) -> Column:
    ident = F.col("__call")
    output = F.coalesce(get(p, "$.output", "variant"), get(p, "$.tools", "variant"), get(p, "$.result", "variant"))
    return F.array(_event(F.concat(F.lit("tool_result:"), F.coalesce(ident, position.cast("string"))), 0, "tool_result", None, _json(call_id=ident, outcome=F.col("__outcome"), output=output), _edges(("result_for", ident, "tool_call"))))


def _context(p: Column, scope: str) -> Column:
    spawn = "$.source.subagent.thread_spawn"
    edges = _edges(
        ("parent_session", F.coalesce(string_at(p, "$.parent_thread_id"), string_at(p, f"{spawn}.parent_thread_id")), "session"),
        ("forked_from", string_at(p, "$.forked_from_id"), "session"),
        ("spawned_by", string_at(p, f"{spawn}.parent_thread_id"), "session"),
        ("source_classification", F.coalesce(string_at(p, "$.source"), F.when(get(p, "$.source.subagent", "variant").isNotNull(), "subagent")), "classification"),
        ("thread_source_classification", string_at(p, "$.thread_source"), "classification"),
    )
    ident = F.coalesce(string_at(p, "$.session_id"), string_at(p, "$.id"), string_at(p, "$.turn_id"))
    return F.array(_event(f"context:{scope}", 0, "context", None, _json(scope=F.lit(scope), scope_id=ident, values=p, instructions=get(p, "$.base_instructions", "variant")), edges if scope == "session" else None))


def _compaction(p: Column, phase: str) -> Column:
    summary = F.coalesce(get(p, "$.message", "variant"), get(p, "$.summary", "variant"))
    return F.array(_event(f"compaction:{phase}", 0, "compaction", None, _json(phase=F.lit(phase), trigger=string_at(p, "$.trigger"), outcome=string_at(p, "$.outcome"), summary=summary, replacement_history=get(p, "$.replacement_history", "variant"), metrics=get(p, "$.metrics", "variant"), window_id=get(p, "$.window_id", "variant"), first_window_id=get(p, "$.first_window_id", "variant"), previous_window_id=get(p, "$.previous_window_id", "variant"), window_number=get(p, "$.window_number", "variant"))))


def _items(v: Column, p: Column, position: Column) -> Column:
    """Dialect of items with a payload."""
    record, kind, hook = F.col("__record"), F.col("__kind"), F.col("__hook")
    item, view = record == "response_item", record == "event_msg"
    error = F.array(_event("error", 0, "error", None, _json(text=F.coalesce(string_at(p, "$.message"), string_at(p, "$.reason")), error=kind)))
    agent = F.array(_event("lifecycle:subagent_start", 0, "lifecycle", None, F.col("__part"), _edges(("spawned_by", string_at(p, "$.call_id"), "tool_call"), ("parent_session", string_at(p, "$.parent_thread_id"), "session"))))
    return (
        F.when(~F.col("__object"), F.array(_event("opaque", 0, "opaque", None, F.col("__whole"))))
        .when(item & (kind == "message"), _messages(p))
        .when(item & (kind == "reasoning"), _reasoning(p))
        .when(item & kind.isin(*CALLS), _call(p, position))
        .when(item & kind.isin(*OUTPUTS), _result(p, position))
        .when(record == "session_meta", _context(p, "session"))
        .when(record == "turn_context", _context(p, "turn"))
        .when(record == "compacted", _compaction(p, "completion"))
        .when(hook == "PreCompact", _compaction(v, "request"))
        .when(hook == "PostCompact", _compaction(v, "completion"))
        .when(view & kind.isin("error", "turn_aborted"), error)
        .when(view & (kind == "subagent_start"), agent)
        .when(view & kind.isin(*VIEWS), F.array(_event(F.concat(F.lit("annotation:"), kind), 0, "annotation", None, F.col("__part"))))
        .otherwise(F.array(_event("opaque", 0, "opaque", None, F.col("__whole"))))
    )


def _blocks(v: Column, position: Column) -> Column:
    """Dialect of user and assistant messages made of blocks."""
    record, sub = string_at(v, "$.type"), string_at(v, "$.subtype")
    role = F.coalesce(string_at(v, "$.message.role"), record)

    def block(x: Column, i: Column) -> Column:
        kind = string_at(x, "$.type")
        at = i.cast("string")
        ident = F.coalesce(string_at(x, "$.tool_use_id"), string_at(x, "$.id"))
        bad = get(x, "$.is_error", "boolean")
        return (
            F.when((shape(x) == "STRING") | (kind == "text"), _event(F.concat(F.lit("content/"), at, F.lit(":message")), i, "message", actor_role(role), _json(text=F.coalesce(F.when(shape(x) == "STRING", get(x, "$")), get(x, "$.text")))))
            .when(kind == "tool_use", _event(F.concat(F.lit("tool_call:"), F.coalesce(ident, at)), i, "tool_call", actor_role(role), _json(call_id=ident, tool=string_at(x, "$.name"), arguments=get(x, "$.input", "variant"))))
            .when(kind == "tool_result", _event(F.concat(F.lit("tool_result:"), F.coalesce(ident, at)), i, "tool_result", actor_role(role), _json(call_id=ident, outcome=F.when(bad, "failed").when(~bad, "succeeded").otherwise("unknown"), output=get(x, "$.content", "variant")), _edges(("result_for", ident, "tool_call"))))
            .otherwise(_event(F.concat(F.lit("content/"), at, F.lit(":opaque")), i, "opaque", actor_role(role), _whole(x)))
        )

    content = get(v, "$.message.content", "variant")
    parts = get(v, "$.message.content", "array<variant>")
    one = F.array(_event("content:message", 0, "message", actor_role(role), _json(text=get(v, "$.message.content"))))
    talk = F.when(shape(content) == "STRING", one).when((shape(content) == "ARRAY") & (F.size(parts) > 0), F.transform(parts, block)).otherwise(F.array(_event("content:opaque", 0, "opaque", actor_role(role), _whole(v))))
    error = F.array(_event("error", 0, "error", None, _json(text=flatten_text(get(v, "$.error", "variant")), error=sub)))
    agent = F.array(_event("lifecycle:subagent_start", 0, "lifecycle", None, _whole(v), _edges(("spawned_by", string_at(v, "$.spawnedBy"), "tool_call"), ("parent_session", string_at(v, "$.parentSessionId"), "session"))))
    compact = F.array(_event("compaction:completion", 0, "compaction", None, _json(phase=F.lit("completion"), metrics=get(v, "$.compactMetadata", "variant"))))
    return (
        F.when(record.isin("user", "assistant"), talk)
        .when((record == "system") & (sub == "api_error"), error)
        .when((record == "system") & (sub == "compact_boundary"), compact)
        .when((record == "system") & (sub == "subagent_start"), agent)
        .otherwise(F.array(_event("opaque", 0, "opaque", None, _whole(v))))
    )


def normalize(records: DataFrame, dialect: str = "items") -> Normalized:
    """Observations, events and edges of records (stream, source_position, value) of one dialect: `items` or `blocks`.

    Text that isn't JSON becomes an opaque event with the text; bytes that aren't UTF-8 become an omission with their number.
    Occurrence time is the payload's own timestamp of a session's first context, and null otherwise.
    """
    valid = F.is_valid_utf8("value")
    rows = records.select("stream", "source_position", "value", F.try_parse_json(F.when(valid, F.col("value"))).alias("v"), valid.alias("__utf8"))
    payload = F.coalesce(get(F.col("v"), "$.payload", "variant"), F.col("v"))
    rows = _prepared(rows.withColumn("p", payload))
    v, p, at = F.col("v"), F.col("p"), F.col("source_position")
    malformed = F.array(_event("malformed", 0, "opaque", None, _json(opaque_text=F.col("value"), parse_error=F.lit("malformed_json"))))
    unreadable = F.array(_event("omission", 0, "opaque", None, _json(omission=F.lit("source_record_omission"), original_bytes=F.octet_length("value"))))
    events = F.when(~F.col("__utf8"), unreadable).when(v.isNull(), malformed).otherwise(_items(v, p, at) if dialect == "items" else _blocks(v, at))
    kind = F.when(~F.col("__utf8"), "source_record_omission").when(v.isNull(), "malformed_json").otherwise(F.coalesce("__record", "__hook"))
    meta = kind == "session_meta"
    pick = lambda path: F.coalesce(string_or_name(v, path), string_or_name(p, path))
    rows = rows.withColumns(
        {
            "observation_uuid": deterministic_id("observation", F.col("stream"), at),
            "record_type": kind,
            "harness_version": F.coalesce(string_or_name(v, "$.cli_version"), string_or_name(v, "$.version"), F.when(meta, string_or_name(p, "$.cli_version"))),
            "model": F.coalesce(pick("$.model"), string_or_name(v, "$.message.model")),
            "provider": F.coalesce(pick("$.model_provider"), pick("$.provider")),
            "source_timestamp": source_timestamp(v),
            "occurred_at": F.when(meta, source_timestamp(p)["parsed"]),
            "events": events,
        }
    )
    # every record has an event; the outer form keeps the optimizer from testing the large expression for emptiness first
    flat = rows.select("stream", "source_position", "observation_uuid", "occurred_at", F.inline_outer("events"))
    flat = flat.withColumn("trace_uuid", deterministic_id("event", F.col("observation_uuid"), F.col("part_key")))
    edges = flat.select("stream", F.col("trace_uuid").alias("source_trace_uuid"), F.explode("edges").alias("r")).select("stream", "source_trace_uuid", F.col("r.type").alias("relationship_type"), F.col("r.native_id").alias("target_native_id"), F.col("r.kind").alias("target_kind"))
    return Normalized(rows.select("observation_uuid", "stream", "source_position", "record_type", "harness_version", "model", "provider", "source_timestamp"), flat.drop("edges"), edges)
