"""Lifecycles as folds over command logs: reviews and retirements of memories, and coordination of workstreams.

Current tables are never edited: they are rebuilt from what was proposed and the ordered commands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redact
from ..functions.ids import deterministic_id
from ..functions.numbering import numbered
from ..functions.rules import DEFAULT, RuleSet
from ..functions.staging import staged
from . import memory_log
from .tracing import actor_name, trace_columns

MEMORY = "uuid string, namespace string, type string, visibility string, status string, tier string, content string, content_hash string, source_type string, source_id string, agent_id string, session_id string, version int, supersedes string, created_at timestamp"


def _write(batch: DataFrame, memories: DataFrame, rules: RuleSet, visibility: str, status: str, event: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    accepted, rejected = redact.reject_unsafe(batch, ["content"], rules)
    parents = memories.select(F.col("uuid").alias("supersedes"), F.col("version").alias("__v"))
    rows = accepted.join(parents, "supersedes", "left")
    uuid = deterministic_id("memory", F.col("agent_id"), F.col("session_id"), F.col("ts"), F.col("content"))
    rows = rows.select(uuid.alias("uuid"), "namespace", "type", F.lit(visibility).alias("visibility"), F.lit(status).alias("status"), F.lit("warm").alias("tier"), "content", F.sha2("content", 256).alias("content_hash"), "source_type", "source_id", "agent_id", "session_id", (F.coalesce("__v", F.lit(0)) + 1).cast("int").alias("version"), "supersedes", F.col("ts").alias("created_at"))
    content = F.to_json(F.struct("type", "version"))
    traces = rows.select(*trace_columns(F.col("session_id"), F.col("agent_id"), F.col("namespace"), F.lit(event), content, F.array("uuid", "supersedes"), F.col("created_at")))
    return rows, traces, redact.blocked_write_notes(rejected)


def propose(batch: DataFrame, memories: DataFrame, rules: RuleSet = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, traces, notes of rejected writes) of a batch (namespace, type, content, source_type, source_id, agent_id,
    session_id, supersedes, ts): shared proposals, a version above the one they supersede."""
    return _write(batch, memories, rules, "shared", "proposed", "memory_proposed")


def save_notes(batch: DataFrame, memories: DataFrame, rules: RuleSet = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for an agent's private notes, which need no review."""
    return _write(batch, memories, rules, "private", "approved", "memory_written")


def apply_reviews(commands: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, traces, errors) after commands (seq, uuid, action, actor, reason, ts) in their order.

    approve and reject take a shared proposal, reject a reason; approving one supersedes its predecessor, whatever that was.
    retire takes an approved memory, with reason and actor. A command that doesn't fit is an error and changes nothing. The
    columns approved_by, approved_at and retired_at are added to memories that lack them.
    """
    kept = ["status", "approved_by", "approved_at", "retired_at"]
    kind = memories.schema["uuid"].dataType
    now, outcomes, errors, _ = memory_log.fold(commands, memory_log.with_columns(memories, memory_log._STATE))
    touched = now.select(F.col("uuid").cast(kind).alias("uuid"), F.struct(*kept).alias("__m"))
    types = {"status": "string", "approved_by": "string", "approved_at": "timestamp", "retired_at": "timestamp"}
    old = lambda c: F.col(c) if c in memories.columns else F.lit(None).cast(types[c])
    new = memories.join(touched, "uuid", "left").withColumns({c: F.when(F.col("__m").isNotNull(), F.col(f"__m.{c}")).otherwise(old(c)) for c in kept})
    new = new.select(*memories.columns, *(c for c in kept if c not in memories.columns))
    good = outcomes.filter("error is null").select("memory.uuid", "memory.namespace", "memory.source_type", "memory.source_id", "command.action", "command.actor", "command.reason", "command.ts")
    return new, review_traces(good), errors


def review_traces(decisions: DataFrame) -> DataFrame:
    """A trace per decision (uuid, namespace, action, actor, reason, source_type, source_id, ts): reviews under `review:<uuid>`,
    retirements under `retirement:<uuid>`; people are `human:<name>` unless their name has a prefix."""
    retire = F.col("action") == "retire"
    session = F.concat(F.when(retire, "retirement:").otherwise("review:"), F.col("uuid").cast("string"))
    actor = actor_name(F.col("actor"))
    event = F.when(retire, "retirement").when(F.col("action") == "approve", "approval").otherwise("rejection")
    uuid = F.col("uuid").cast("string")
    source = F.when((F.col("source_type") == "trace") & F.col("source_id").rlike("^[0-9a-fA-F-]{36}$"), F.col("source_id"))
    return decisions.select(*trace_columns(session, actor, F.col("namespace"), event, F.to_json(F.struct("reason")), F.array(uuid, source, F.when(F.col("action") == "approve", uuid)), F.col("ts")))


def apply_amendments(amendments: DataFrame, memories: DataFrame, rules: RuleSet = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, traces, errors) after reviewers' edits (uuid, content, actor, ts, and optionally seq) of proposals, in order of
    time and content unless they are numbered.

    The proposal and its predecessor are superseded by a new approved row of the next version, so that of several edits of one
    proposal the first wins and the others are errors (wrong_status). Blank texts are errors, and so are unsafe ones, named by
    their rule; these leave a redacted note.
    """
    log = amendments.withColumn("action", F.lit("amend"))
    if "seq" not in amendments.columns:  # a proposal's edits only meet each other
        log = log.withColumn("seq", F.row_number().over(Window.partitionBy("uuid").orderBy("ts", "content")).cast("long"))
    state, outcomes, errors = memory_log.apply_log(log, memories, rules)
    added = [c for c in ("approved_by", "approved_at") if c not in memories.columns]
    return state.select(*memories.columns, *added), memory_log.log_outcome_traces(outcomes), errors.select("uuid", "error")


def log_traces(batch: DataFrame, default: str = "default", rules: RuleSet = DEFAULT) -> DataFrame:
    """Events to append, their content redacted, in the default namespace unless they name one."""
    rows = redact.redact_text(batch, "content", rules).withColumn("content", F.col("redacted")).withColumn("namespace", F.coalesce("namespace", F.lit(default)))
    return rows.select(*trace_columns(F.col("session_id"), F.col("agent_id"), F.col("namespace"), F.col("event_type"), F.col("content"), F.coalesce("refs", F.array().cast("array<string>")), F.col("ts")))


def list_workstreams(workstreams: DataFrame, namespace: str, status: str | None = None) -> DataFrame:
    """Live workstreams of a namespace (of one live status, or open and checked-out ones together) with `place`, newest first."""
    if status not in (None, "open", "checked_out"):
        raise ValueError("only open and checked_out workstreams are listed")
    live = F.col("status").isin("open", "checked_out") if status is None else F.col("status") == status
    rows = workstreams.filter((F.col("namespace") == namespace) & live)
    return numbered(rows, ["namespace"], -F.col("updated_at").cast("double"), ["uuid"])


def handoff_rows(batch: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """Open workstreams of handoffs (namespace, agent_id, session_id, summary, refs, ts): titled by the first line of the
    redacted summary, at most 80 characters."""
    rows = redact.redact_text(batch, "summary", rules)
    title = F.substring(F.trim(F.get(F.split("redacted", "\n"), F.lit(0))), 1, 80)
    return rows.select(deterministic_id("workstream", F.col("namespace"), F.col("agent_id"), F.col("session_id"), F.col("ts")).alias("uuid"), "namespace", title.alias("title"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("owner_agent"), "session_id", F.col("redacted").alias("notes"), "refs", F.col("ts").alias("updated_at"))


WORKSTREAM = "uuid string, namespace string, title string, status string, owner_agent string, session_id string, notes string, refs string, updated_at timestamp"
_WORKSTREAM = f"struct<{', '.join(':'.join(x.split()) for x in WORKSTREAM.split(', '))}>"
_OUTCOME = f"struct<seq:bigint,event:string,by_agent:string,by_session:string,created:boolean,error:string,workstream:{_WORKSTREAM}>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that the plan holds once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _on_workstreams(a: Column, c: Column) -> Column:
    """State and outcomes after one more command on the workstreams of a title."""
    newest = lambda status: F.array_max(F.transform(F.filter(a["now"], lambda w: w["status"] == status), lambda w: F.struct(w["updated_at"].alias("at"), w["uuid"].alias("u"), w.alias("w"))))["w"]
    out = c["action"] == "checkout"
    by_uuid = F.get(F.filter(a["now"], lambda w: w["uuid"] == c["uuid"]), F.lit(0))
    met = F.when(c["uuid"].isNotNull(), by_uuid).when(out, newest("open")).otherwise(newest("checked_out"))

    def told(w: Column) -> Column:
        target = F.when(out, "checked_out").when(c["action"] == "check_in", c["status"]).otherwise("open")
        refused = F.when(w["status"] == "checked_out", "conflict").when(w["status"] != "open", "terminal")
        held = (
            F.when(w.isNull(), "unknown_workstream")
            .when(w["status"].isin("done", "abandoned"), "terminal")
            .when(w["status"] != "checked_out", "not_checked_out")
            .when((c["action"] != "release") & ~w["owner_agent"].eqNullSafe(c["agent_id"]), "not_owner")
            .when(~F.coalesce(target.isin("open", "done", "abandoned"), F.lit(False)), "unknown_status")
        )
        error = F.when(~F.coalesce(c["action"].isin("checkout", "check_in", "handoff", "release"), F.lit(False)), "unknown_action").when(~out, held).when(w.isNotNull(), refused).when(c["uuid"].isNotNull(), "unknown_workstream").when(newest("checked_out").isNotNull(), "conflict")
        free = target == "open"
        fields = {
            "uuid": F.coalesce(w["uuid"], c["uuid"], F.concat(F.lit("ws:"), c["namespace"], F.lit(":"), c["title"], F.lit(":"), c["seq"].cast("string"))),
            "namespace": c["namespace"],
            "title": F.coalesce(w["title"], c["title"]),
            "status": target,
            "owner_agent": F.when(out, c["agent_id"]).when(~free, w["owner_agent"]),
            "session_id": F.when(out, c["session_id"]).when(~free, w["session_id"]),
            "notes": F.when(out, w["notes"]).otherwise(F.coalesce(c["notes"], w["notes"])),
            "refs": F.when(out, w["refs"]).otherwise(F.coalesce(c["refs"], w["refs"])),
            "updated_at": c["ts"],
        }
        event = F.when(out, "workstream_checkout").when(c["action"] == "check_in", "workstream_checkin").when(c["action"] == "handoff", "workstream_handoff")
        after = F.struct(*(v.alias(k) for k, v in fields.items()))
        return F.struct(c["seq"].alias("seq"), event.alias("event"), c["agent_id"].alias("by_agent"), c["session_id"].alias("by_session"), (out & w.isNull()).alias("created"), error.alias("error"), after.alias("workstream")).cast(_OUTCOME)

    def moved(d: Column) -> Column:
        others = F.filter(a["now"], lambda w: w["uuid"] != d["workstream"]["uuid"])
        return F.struct(F.when(d["error"].isNotNull(), a["now"]).otherwise(F.array_append(others, d["workstream"])).alias("now"), F.array_append(a["done"], d).alias("done")).cast(f"struct<now:array<{_WORKSTREAM}>,done:array<{_OUTCOME}>>")

    return _let(_let(met, told), moved)


def apply_workstream_commands(commands: DataFrame, workstreams: DataFrame, rules: RuleSet = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(workstreams, accepted commands with their taxonomy event, errors) after commands (seq, action, namespace, title or uuid,
    agent_id, session_id, status, notes, refs, ts) in their order.

    checkout takes an open workstream, by title the newest one, and creates it if there is none and none is checked out;
    check_in by its owner opens it again or ends it; release opens it; handoff is a check-in with notes. done and abandoned
    are final; an open workstream has no owner and no session. Titles and notes are redacted before anything is compared or
    kept. Each namespace and title is folded by itself, in one row; commands by uuid are sent to their title first, and those
    that name neither a title nor a known uuid are errors. Titles without commands pass as they are.
    """
    columns = [x.split()[0] for x in WORKSTREAM.split(", ")]
    held = redact.in_place(workstreams.select(*columns), ["title", "notes"], rules)
    asked = redact.in_place(commands, ["title", "notes"], rules)
    by = held.select(F.col("uuid").alias("__u"), F.col("title").alias("__t"), F.col("namespace").alias("__n"))
    asked = asked.join(by, F.col("uuid") == F.col("__u"), "left").withColumns({"title": F.coalesce("__t", "title"), "namespace": F.coalesce("__n", "namespace")}).drop("__u", "__t", "__n")
    placed = F.trim(F.coalesce("title", F.lit(""))) != ""
    names = ("seq", "action", "namespace", "title", "uuid", "agent_id", "session_id", "status", "notes", "refs", "ts")
    c = F.struct(F.col("seq").cast("long").alias("seq"), *(F.col(n).cast("timestamp" if n == "ts" else "string").alias(n) for n in names[1:]))
    logs = asked.filter(placed).groupBy("namespace", "title").agg(F.array_sort(F.collect_list(c)).alias("log"))
    key = [F.col("namespace").eqNullSafe(F.col("__n")), F.col("title") == F.col("__t")]
    touched = held.join(logs.select(F.col("namespace").alias("__n"), F.col("title").alias("__t")), key, "left_semi")
    rest = held.join(logs.select(F.col("namespace").alias("__n"), F.col("title").alias("__t")), key, "left_anti")
    before = touched.groupBy(F.col("namespace").alias("__n"), F.col("title").alias("__t")).agg(F.collect_list(F.struct(*columns).cast(_WORKSTREAM)).alias("held"))
    start = F.struct(F.coalesce("held", F.array().cast(f"array<{_WORKSTREAM}>")).alias("now"), F.array().cast(f"array<{_OUTCOME}>").alias("done"))
    folded = staged(logs.join(before, key, "left").select(F.aggregate("log", start, _on_workstreams).alias("s")), "workstreams")
    state = folded.select(F.inline("s.now")).select(*columns)
    done = folded.select(F.inline("s.done"))
    lost = asked.filter(~placed).select(F.col("seq").cast("long").alias("seq"), "uuid", F.lit("unknown_workstream").alias("error"))
    errors = done.filter("error is not null").select("seq", F.col("workstream.uuid").alias("uuid"), "error").unionByName(lost)
    accepted = done.filter("error is null and event is not null").select("seq", "event", "by_agent", "by_session", "created", "workstream.*")
    return state.unionByName(rest.select(*columns)), accepted, errors


def workstream_traces(accepted: DataFrame) -> DataFrame:
    """A trace per accepted command (release has none), under the agent and session that gave it."""
    content = F.when(F.col("event") == "workstream_checkout", F.to_json(F.struct("uuid", "title", "created"))).otherwise(F.to_json(F.struct("uuid", "title", "status")))
    return accepted.select(*trace_columns(F.col("by_session"), F.coalesce("by_agent", F.lit("unknown")), F.col("namespace"), F.col("event"), content, F.array("uuid"), F.col("updated_at")))
