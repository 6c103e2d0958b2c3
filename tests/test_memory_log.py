import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import ids
from tracewright.operators import lifecycle, memory_log

NAMES = [x.split()[0] for x in memory_log.LOG.split(", ")]
SECRET = "password = hunter22hunter22"


def row(seq, action, **given):
    return tuple(({"seq": seq, "action": action} | given).get(n) for n in NAMES)


def replay(log):
    """The memories and errors after a log, one command after another."""
    state, errors = {}, []
    for r in sorted(log):
        c = dict(zip(NAMES, r))
        blank = lambda v: not (v or "").strip()
        error, m = None, state.get(c["uuid"])
        made = c["makes"]
        if c["action"] in ("propose", "save_note"):
            error = "already_made" if made in state else "content_required" if blank(c["content"]) else "sensitive-assignment" if c["content"] == SECRET else None
            if not error:
                parent = state.get(c["supersedes"])
                state[made] = {"status": "proposed" if c["action"] == "propose" else "approved", "shared": c["action"] == "propose", "supersedes": c["supersedes"], "version": (parent["version"] if parent else 0) + 1, "content": c["content"], "by": None, "retired": False}
        elif m is None:
            error = "unknown_memory"
        else:
            fits = m["status"] == "approved" if c["action"] == "retire" else m["status"] == "proposed" and m["shared"]
            if not fits:
                error = "wrong_status"
            elif c["action"] in ("reject", "retire") and blank(c["reason"]):
                error = "reason_required"
            elif blank(c["actor"]):
                error = "actor_required"
            elif c["action"] == "amend":
                error = "content_required" if blank(c["content"]) else "already_made" if made in state else "sensitive-assignment" if c["content"] == SECRET else None
            if not error:
                if c["action"] in ("approve", "amend") and m["supersedes"] in state:
                    state[m["supersedes"]]["status"] = "superseded"
                if c["action"] == "amend":
                    m["status"] = "superseded"
                    state[made] = {**m, "status": "approved", "supersedes": c["uuid"], "version": m["version"] + 1, "content": c["content"], "by": "human:" + c["actor"]}
                else:
                    m["status"] = {"approve": "approved", "reject": "rejected", "retire": "retired"}[c["action"]]
                    m["by"] = "human:" + c["actor"] if c["action"] == "approve" else m["by"]
                    m["retired"] = m["retired"] or c["action"] == "retire"
        if error:
            errors.append((c["seq"], error))
    return {(u, m["status"], m["supersedes"], m["version"], m["content"], m["by"], m["retired"]) for u, m in state.items()}, sorted(errors)


def logs(seed, n=160):
    r = random.Random(seed)
    known, out = [], []
    for seq in range(n):
        action = r.choice(["propose", "propose", "save_note", "approve", "approve", "reject", "amend", "amend", "retire"])
        target = r.choice(known[-12:]) if known and r.random() < 0.95 else "nowhere"
        text = r.choice([f"text {seq}"] * 8 + [" ", SECRET])
        if action in ("propose", "save_note"):
            made = f"m{seq}" if r.random() < 0.95 or not known else r.choice(known)
            out.append(row(seq, action, makes=made, content=text, supersedes=target if r.random() < 0.6 else None, namespace="n", type="fact", source_type="trace", source_id="x", agent_id="a", session_id="s"))
        else:
            made = f"a{seq}" if action == "amend" else None
            out.append(row(seq, action, uuid=target, makes=made, content=text if action == "amend" else None, actor=r.choice(["ann"] * 9 + [" "]), reason=r.choice(["why"] * 9 + [None])))
        if made:
            known.append(made)
    return out


def told(df):
    return {(r.uuid, r.status, r.supersedes, r.version, r.content, r.approved_by, r.retired_at is not None) for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_a_log_equals_its_replay_and_snapshots_change_nothing(spark, tmp_path, seed):
    rows = logs(seed)
    log = spark.createDataFrame(rows, memory_log.LOG).withColumn("ts", F.timestamp_seconds("seq")).repartition(3)
    want, errors = replay(rows)
    state, outcomes, wrong = memory_log.apply_log(log, spark.createDataFrame([], memory_log.STATE))
    assert told(state) == want and sorted((r.seq, r.error) for r in wrong.collect()) == errors
    traces = memory_log.log_outcome_traces(outcomes).collect()
    assert len(traces) == len(rows) - len(errors) + sum(e == "sensitive-assignment" for _, e in errors)
    assert not any("hunter" in r.content for r in traces)
    for k in (50, 110):
        memory_log.write_snapshot(spark, str(tmp_path), memory_log.memory_state(log.filter(F.col("seq") <= k), str(tmp_path) if k > 50 else None), k)
    assert told(memory_log.memory_state(log, str(tmp_path))) == want


def test_a_second_edit_of_a_proposal_meets_the_first(spark):
    ts = F.lit("2024-01-01").cast("timestamp")
    memories = spark.createDataFrame([("p", "n", "shared", "proposed", "old", "o", 3, "kept"), ("o", "n", "shared", "approved", "older", None, 2, "too")], "uuid string, namespace string, visibility string, status string, content string, supersedes string, version int, more string")
    edits = spark.createDataFrame([("p", "better", "ann"), ("p", "best", "bob"), ("p", " ", "ann"), ("o", "x", "ann")], "uuid string, content string, actor string").withColumn("ts", ts)
    state, traces, errors = lifecycle.apply_amendments(edits, memories)
    made = [r for r in state.collect() if r.uuid not in ("p", "o")]
    assert [(r.status, r.content, r.version, r.supersedes, r.approved_by) for r in made] == [("approved", "best", 4, "p", "human:bob")]
    assert {(r.uuid, r.status, r.more) for r in state.collect() if r.uuid in ("p", "o")} == {("p", "superseded", "kept"), ("o", "superseded", "too")}
    assert sorted((r.uuid, r.error) for r in errors.collect()) == [("o", "wrong_status"), ("p", "content_required"), ("p", "wrong_status")]
    blocked = lifecycle.apply_amendments(spark.createDataFrame([("p", SECRET, "ann")], "uuid string, content string, actor string").withColumn("ts", ts), memories)
    note = blocked[1].first()
    assert note.event_type == "note" and "hunter" not in note.content and "[REDACTED:sensitive-assignment]" in note.content and blocked[0].count() == 2


def test_chains_and_loops_of_pointers(spark):
    pairs = [(f"c{i}", f"c{i - 1}") for i in range(1, 40)] + [("c0", None), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("alone", None), ("s", "gone")]
    got = {r.node: r.grp for r in memory_log.touched_groups(spark.createDataFrame(pairs, "node string, other string")).collect()}
    assert {got[f"c{i}"] for i in range(40)} == {"c0"} and got["alone"] == "alone" and got["s"] == got["gone"] == "gone"
    assert got["x"] == got["y"] == got["z"] == got["w"]


def test_retirement_and_approval_are_dated(spark):
    ts = F.lit("2024-01-01").cast("timestamp")
    memories = spark.createDataFrame([(1, "shared", "proposed", None)], "uuid long, visibility string, status string, supersedes long")
    orders = spark.createDataFrame([(1, 1, "approve", "ann", None), (2, 1, "retire", "bot:x", "old")], "seq int, uuid long, action string, actor string, reason string").withColumn("ts", ts)
    state, _, errors = lifecycle.apply_reviews(orders, memories)
    got = state.first()
    assert (got.uuid, got.status, got.approved_by) == (1, "retired", "human:ann") and got.approved_at == got.retired_at is not None and errors.count() == 0


def test_made_names_are_told_without_folding(spark):
    log = spark.createDataFrame([row(1, "propose", content="x", agent_id="a", session_id="s"), row(2, "amend", uuid="?", content="y", actor="a")], memory_log.LOG)
    name = log.filter("seq = 1").select(memory_log.made_name(*(F.col(n) for n in ("action", "uuid", "seq", "agent_id", "session_id", "ts", "content")))).first()[0]
    both = log.withColumn("uuid", F.when(F.col("seq") == 2, name))
    state, _, errors = memory_log.apply_log(both, spark.createDataFrame([], memory_log.STATE))
    want = both.filter("seq = 2").select(ids.deterministic_id("amendment", F.col("uuid"), F.col("seq"))).first()[0]
    assert {(r.uuid, r.status) for r in state.collect()} == {(name, "superseded"), (want, "approved")} and errors.count() == 0


def test_texts_are_shuffled_once(spark, tmp_path):
    """what a log makes, and what a snapshot holds, meets its state in one shuffle of the texts."""
    import re

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = spark.createDataFrame(logs(2, 60), memory_log.LOG)
        state = memory_log.memory_state(log)
        text = spark._jvm.PythonSQLUtils.explainString(state._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = [x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", text) if "content#" in x]
    assert len(moved) == 1
