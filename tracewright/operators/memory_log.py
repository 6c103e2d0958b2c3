"""The state of all memories as a fold over one ordered log of proposals, notes, reviews, amendments and retirements.

Commands may name memories that earlier commands of the log make. Every memory that a command makes has a name that can be
told without folding, so that commands which can affect each other are grouped first: a command touches its memory and that
memory's predecessor, and only these pairs are chained. Each group is one row and one fold. A state that was written is a
snapshot: later states fold the log's tail onto it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact
from ..functions.ids import deterministic_id
from ..functions.rules import DEFAULT, RuleSet
from ..functions.staging import staged
from .tracing import actor_name, trace_columns

#: A memory of the log: the ledger's columns, and who approved it and when it was approved and retired.
STATE = "uuid string, namespace string, type string, visibility string, status string, tier string, content string, content_hash string, source_type string, source_id string, agent_id string, session_id string, version int, supersedes string, created_at timestamp, approved_by string, approved_at timestamp, retired_at timestamp"
LOG = "seq long, action string, uuid string, makes string, namespace string, type string, content string, source_type string, source_id string, agent_id string, session_id string, supersedes string, actor string, reason string, ts timestamp"
MAKING, REVIEWS = ("propose", "save_note", "amend"), ("approve", "reject", "amend", "retire")
_STATE = [x.split() for x in STATE.split(", ")]
_SMALL = [(n, t) for n, t in _STATE if n not in ("content", "content_hash")]
_MEMBER = f"struct<{','.join(f'{n}:{t}' for n, t in _SMALL)}>"
_LOG = [x.split() for x in LOG.split(", ")]
_COMMAND = f"struct<{','.join(f'{n}:{t}' for n, t in _LOG if n != 'content')},blank:boolean,fault:string,row:bigint>"
_DONE = f"struct<command:{_COMMAND},error:string,memory:{_MEMBER}>"
_FOLD = f"struct<now:array<{_MEMBER}>,done:array<{_DONE}>>"


def made_name(action: Column, uuid: Column, seq: Column, agent: Column, session: Column, ts: Column, content: Column) -> Column:
    """The uuid of what a command makes, if it doesn't say: an amendment's from its proposal and its place in the log, a
    proposal's or note's from who wrote what and when."""
    return F.when(action == "amend", deterministic_id("amendment", uuid, seq)).when(action.isin(*MAKING), deterministic_id("memory", agent, session, ts, content))


def with_columns(df: DataFrame, columns: list[list[str]]) -> DataFrame:
    """df's columns of these names and types; those that it lacks are null."""
    have = {c.lower() for c in df.columns}
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns))


def touched_groups(pairs: DataFrame) -> DataFrame:
    """node, grp of pairs (node, other) in which a node has one other at most: nodes that are joined by pairs share a group.

    Pointers are doubled until they rest, in log2 of the longest chain's length rounds, each a written table of the touched
    nodes alone. Nodes of, or before, a loop share its least node.
    """
    nodes = pairs.select("node").union(pairs.filter("other is not null").select("other")).distinct()
    now = staged(nodes.join(pairs.filter("other is not null").dropDuplicates(["node"]), "node", "left").select("node", F.coalesce("other", "node").alias("far"), F.least("node", F.coalesce("other", "node")).alias("least")), "pointers")
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        step = now.select(F.col("node").alias("__n"), F.col("far").alias("__far"), F.col("least").alias("__least"))
        then = staged(now.join(step, F.col("far") == F.col("__n")).select("node", F.col("__far").alias("far"), F.least("least", "__least").alias("least"), (F.col("far") != F.col("__far")).alias("moved")), "pointers")
        now = then.drop("moved")
        if then.filter("moved").isEmpty():
            break
    end = now.select(F.col("node").alias("__n"), (F.col("far") == F.col("node")).alias("__root"), F.col("least").alias("__least"))
    return now.join(end, F.col("far") == F.col("__n")).select("node", F.when(F.col("__root"), F.col("far")).otherwise(F.col("__least")).alias("grp"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _changed(m: Column, **new: Column) -> Column:
    return F.struct(*((new[n] if n in new else m[n]).cast(t).alias(n) for n, t in _SMALL)).cast(_MEMBER)


def _step(a: Column, c: Column) -> Column:
    """State and outcomes after one more command."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    named = lambda uuid: F.get(F.filter(a["now"], lambda m: m["uuid"] == uuid), F.lit(0))
    none = F.lit(None)
    writes, amends = c["action"].isin("propose", "save_note"), c["action"] == "amend"

    def told(known: Column) -> Column:
        m, parent, made = known["target"], known["parent"], known["made"]
        fits = F.when(c["action"] == "retire", m["status"] == "approved").otherwise((m["status"] == "proposed") & (m["visibility"] == "shared"))
        review = (
            F.when(~F.coalesce(c["action"].isin(*REVIEWS), F.lit(False)), "unknown_action")
            .when(m.isNull(), "unknown_memory")
            .when(~F.coalesce(fits, F.lit(False)), "wrong_status")
            .when(c["action"].isin("reject", "retire") & blank(c["reason"]), "reason_required")
            .when(blank(c["actor"]), "actor_required")
            .when(amends & c["blank"], "content_required")
            .when(amends & made.isNotNull(), "already_made")
            .when(amends, c["fault"])
        )
        write = F.when(made.isNotNull(), "already_made").when(c["blank"], "content_required").otherwise(c["fault"])
        error = F.when(writes, write).otherwise(review)
        who = actor_name(c["actor"])
        written = F.struct(
            *(
                v.cast(dict(map(tuple, _SMALL))[n]).alias(n)
                for n, v in {
                    "uuid": c["makes"], "namespace": c["namespace"], "type": c["type"], "visibility": F.when(c["action"] == "propose", "shared").otherwise("private"), "status": F.when(c["action"] == "propose", "proposed").otherwise("approved"), "tier": F.lit("warm"),
                    "source_type": c["source_type"], "source_id": c["source_id"], "agent_id": c["agent_id"], "session_id": c["session_id"], "version": F.coalesce(parent["version"], F.lit(0)) + 1, "supersedes": c["supersedes"], "created_at": c["ts"], "approved_by": none, "approved_at": none, "retired_at": none,
                }.items()
            )
        ).cast(_MEMBER)
        amended = _changed(m, uuid=c["makes"], status=F.lit("approved"), version=m["version"] + 1, supersedes=m["uuid"], created_at=c["ts"], approved_by=who, approved_at=c["ts"])
        approve, retire = c["action"] == "approve", c["action"] == "retire"
        reviewed = _changed(m, status=F.when(approve, "approved").when(c["action"] == "reject", "rejected").when(retire, "retired").otherwise("superseded"), approved_by=F.when(approve, who).otherwise(m["approved_by"]), approved_at=F.when(approve, c["ts"]).otherwise(m["approved_at"]), retired_at=F.when(retire, c["ts"]).otherwise(m["retired_at"]))
        gone = F.when(approve | amends, _changed(known["prior"], status=F.lit("superseded")))
        new = F.filter(F.array(F.when(~writes, reviewed), F.when(known["prior"].isNotNull() & (known["prior"]["uuid"] != m["uuid"]), gone), F.when(writes, written), F.when(amends, amended)), lambda x: x.isNotNull())
        after = F.concat(F.filter(a["now"], lambda x: ~F.exists(new, lambda y: y["uuid"] == x["uuid"])), new)
        done = F.struct(c.alias("command"), error.alias("error"), F.when(writes, written).when(amends, amended).otherwise(m).alias("memory")).cast(_DONE)
        return F.struct(F.when(error.isNotNull(), a["now"]).otherwise(after).alias("now"), F.array_append(a["done"], done).alias("done")).cast(_FOLD)

    target = named(F.when(writes, none.cast("string")).otherwise(c["uuid"]))
    return _let(_let(target, lambda m: F.struct(m.alias("target"), named(m["supersedes"]).alias("prior"), named(c["supersedes"]).alias("parent"), named(c["makes"]).alias("made"))), told)


def fold(log: DataFrame, memories: DataFrame, rules: RuleSet = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories that commands touch or make, without content; outcomes; errors; what was made, with content) of apply_log.
    memories are those of STATE; content isn't read. The row of what made a memory is told by the fold, so that texts are
    shuffled once."""
    asked = with_columns(log, _LOG)
    asked = asked.withColumn("makes", F.when(F.col("action").isin(*MAKING), F.coalesce("makes", made_name(*(F.col(n) for n in ("action", "uuid", "seq", "agent_id", "session_id", "ts", "content"))))))
    if "content" in {c.lower() for c in log.columns}:
        asked = redact.scanned(asked, ["content"], rules)
        f = F.col("__found_0")
        first = F.get(F.array_sort(F.transform(f["spans"], lambda s: F.struct((-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("l"), s["rule_id"].alias("rule_id")))), F.lit(0))
        fault = F.when(f["omission"].isNotNull(), "required_inspection_incomplete").otherwise(F.coalesce(f["failure"], first["rule_id"]))
        asked = asked.withColumns({"fault": fault, "redacted": f["redacted"]}).drop("__found_0")
    else:
        asked = asked.withColumns({"fault": F.lit(None).cast("string"), "redacted": F.lit(None).cast("string")})
    asked = staged(asked.withColumns({"blank": F.trim(F.coalesce("content", F.lit(""))) == "", "row": F.monotonically_increasing_id()}), "log")

    made = asked.filter("makes is not null").select(F.col("makes").alias("node"), F.when(F.col("action") == "amend", F.col("uuid")).otherwise(F.col("supersedes")).alias("other"))
    wanted = asked.filter("uuid is not null").select(F.col("uuid").alias("node")).distinct()
    stored = memories.select(F.col("uuid").alias("node"), F.col("supersedes").alias("other")).join(wanted, "node", "left_semi")
    bare = wanted.select("node", F.lit(None).cast("string").alias("other"))
    groups = staged(touched_groups(made.unionByName(stored).unionByName(bare)), "groups")

    key = F.when(F.col("action").isin("propose", "save_note"), F.col("makes")).otherwise(F.col("uuid"))
    command = F.struct(*(F.col(n) for n, _ in _LOG if n != "content"), "blank", "fault", "row").cast(_COMMAND)
    logs = asked.withColumn("node", key).join(groups, "node").groupBy("grp").agg(F.array_sort(F.collect_list(command)).alias("log"))
    held = memories.select(*(n for n, _ in _SMALL)).join(groups, F.col("uuid") == F.col("node")).groupBy("grp").agg(F.collect_list(F.struct(*(n for n, _ in _SMALL)).cast(_MEMBER)).alias("held"))
    start = F.struct(F.coalesce("held", F.array().cast(f"array<{_MEMBER}>")).alias("now"), F.array().cast(f"array<{_DONE}>").alias("done")).cast(_FOLD)
    folded = staged(logs.join(held, "grp", "left").select(F.aggregate("log", start, _step).alias("s")), "folded")
    done = folded.select(F.inline("s.done"))
    blocked = asked.filter("fault is not null").select(F.col("row").alias("__row"), "redacted")
    outcomes = done.join(blocked, F.col("command.row") == F.col("__row"), "left").select("command", "error", "memory", "redacted")
    lost = asked.filter(key.isNull()).select("seq", "uuid", "action", F.lit("unknown_memory").alias("error"))
    errors = outcomes.filter("error is not null").select("command.seq", "command.uuid", "command.action", "error").unionByName(lost)
    now = folded.select(F.inline("s.now"))
    made = done.filter("error is null and command.makes is not null").select(F.col("command.makes").alias("uuid"), F.col("command.row").alias("row"))
    fresh = now.join(made, "uuid").join(asked.filter("makes is not null").select("row", "content"), "row").drop("row")
    return now, outcomes, errors, fresh


def apply_log(log: DataFrame, memories: DataFrame, rules: RuleSet = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, outcomes, errors) after the commands of log (see LOG; columns that it lacks are null) in order of seq.

    propose makes a shared proposal and save_note a private approved note, both a version above what they supersede. approve
    and amend take a shared proposal and supersede its predecessor, whatever that was; amend supersedes the proposal too and
    makes an approved memory of the next version. reject takes a shared proposal, retire an approved memory; both need a
    reason, and all reviews an actor. Content must not be blank and is scanned by the rules: an unsafe one is an error named by
    its rule. A command that doesn't fit is an error and changes nothing.

    memories has the columns of STATE (those that it lacks are added; others stay). outcomes: command, error, memory (what was
    made or met) and redacted (the text of a blocked write) of every command. Commands that can affect each other have to fit
    a row, without their content.
    """
    own = with_columns(memories, _STATE)
    now, outcomes, errors, fresh = fold(log, own, rules)
    small = [n for n, _ in _SMALL if n != "uuid"]
    kept = own.join(now.select("uuid", F.struct(*small).alias("__m")), "uuid", "left").withColumns({n: F.when(F.col("__m").isNotNull(), F.col(f"__m.{n}")).otherwise(F.col(n)) for n in small}).select(*(n for n, _ in _STATE))
    fresh = fresh.withColumn("content_hash", F.sha2("content", 256)).select(*(n for n, _ in _STATE))
    state = kept.unionByName(fresh)
    if extra := [c for c in memories.columns if c.lower() not in {n for n, _ in _STATE}]:
        state = state.join(memories.select(F.col("uuid").cast("string").alias("uuid"), *extra), "uuid", "left")
    return state, outcomes, errors


def log_outcome_traces(outcomes: DataFrame) -> DataFrame:
    """A trace per outcome: what was proposed or written, every decision, and a redacted note of each blocked write."""
    blocked = F.col("error").isNotNull()
    rows = outcomes.filter(~blocked | (F.col("error") == F.col("command.fault")))
    c, m = (lambda n: F.col(f"command.{n}")), (lambda n: F.col(f"memory.{n}"))
    writes = c("action").isin("propose", "save_note")
    session = F.when(writes, c("session_id")).when(c("action") == "retire", F.concat(F.lit("retirement:"), c("uuid"))).otherwise(F.concat(F.lit("review:"), c("uuid")))
    agent = F.when(writes, c("agent_id")).otherwise(actor_name(c("actor")))
    event = F.when(blocked, "note").when(c("action") == "propose", "memory_proposed").when(c("action") == "save_note", "memory_written").when(c("action").isin("approve", "amend"), "approval").when(c("action") == "reject", "rejection").otherwise("retirement")
    about = F.to_json(F.struct(m("type").alias("type"), m("version").alias("version")))
    decided = F.to_json(F.struct((c("action") == "amend").alias("amended"), c("reason").alias("reason")))
    note = F.to_json(F.struct(F.lit("blocked_write").alias("kind"), F.col("error").alias("rule"), F.lit("content").alias("path"), F.col("redacted").alias("content")))
    source = F.when((m("source_type") == "trace") & m("source_id").rlike("^[0-9a-fA-F-]{36}$"), m("source_id"))
    refs = F.when(blocked, F.array(c("uuid"))).when(writes, F.array(c("makes"), c("supersedes"))).when(c("action") == "retire", F.array(c("uuid"))).otherwise(F.array(c("uuid"), source, F.when(c("action") == "approve", c("uuid")).when(c("action") == "amend", c("makes"))))
    return rows.select(*trace_columns(session, agent, F.coalesce(m("namespace"), c("namespace")), event, F.when(blocked, note).when(writes, about).otherwise(decided), refs, c("ts")))


def write_snapshot(spark: SparkSession, path: str, memories: DataFrame, seq: int) -> None:
    """Keeps the state after all commands up to seq; written once, and again only to the same effect."""
    with_columns(memories, _STATE).write.mode("overwrite").parquet(f"{path}/seq={seq}")


def memory_state(log: DataFrame, snapshots: str | None = None, rules: RuleSet = DEFAULT) -> DataFrame:
    """Current memories from the log alone, or from the newest snapshot and the commands behind it."""
    spark = log.sparkSession
    held, start = with_columns(spark.range(1).filter(F.lit(False)), _STATE), None
    if snapshots:
        kept = spark.read.schema(f"{STATE}, seq long").parquet(snapshots)
        start = kept.agg(F.max("seq")).first()[0]
    if start is not None:
        held, log = kept.filter(F.col("seq") == start).drop("seq"), log.filter(F.col("seq") > start)
    return apply_log(log, held, rules)[0]
