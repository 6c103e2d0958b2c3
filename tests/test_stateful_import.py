import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ingest
from tracewright.streaming import stateful


def replay(batches, halt=False):
    """Receipts, checkpoints, routes and stop codes, one record at a time; what waits is tried again with every batch."""
    state, final = {}, {}

    def judge(s, r):
        if r["locator"] in s["held"]:
            return ingest.ACCEPTED if s["held"][r["locator"]] == r["content_signature"] else ingest.CONFLICT
        if r["source_position"] <= s["at"]:
            return ingest.CONFLICT
        if s["code"] == stateful.PREFIX_CHANGED or halt and s["code"] == ingest.CONFLICT or r["source_position"] > s["at"] + 1:
            return ingest.BLOCKED
        return ingest.NEW

    for batch in batches:
        for r in batch:
            s = state.setdefault(r["stream"], {"at": -1, "held": {}, "route": None, "code": None, "where": None, "wait": []})
            s["wait"].append(r)
        for s in state.values():
            moved = True
            while moved:
                moved = False
                for r in sorted(s["wait"], key=lambda r: (r["source_position"], r["ingest"], r["locator"])):
                    if r["prefix_changed"]:
                        s["code"], s["where"] = stateful.PREFIX_CHANGED, None
                        s["wait"].remove(r)
                        moved = True
                        break
                    status = judge(s, r)
                    final[r["ingest"]] = status
                    if status == ingest.BLOCKED:
                        continue
                    s["wait"].remove(r)
                    if status == ingest.NEW:
                        s["at"], s["held"][r["locator"]] = r["source_position"], r["content_signature"]
                        s["route"] = s["route"] or (r["namespace"], r["basis"])
                    elif status == ingest.CONFLICT and s["code"] != stateful.PREFIX_CHANGED:
                        s["where"] = min(r["source_position"], s["where"]) if s["code"] == ingest.CONFLICT else r["source_position"]
                        s["code"] = ingest.CONFLICT
                    moved = True
                    break
            stopped = s["code"] == stateful.PREFIX_CHANGED or halt and s["code"] == ingest.CONFLICT
            if s["code"] in (None, ingest.BLOCKED):
                first = min((r["source_position"] for r in s["wait"]), default=None)
                s["code"], s["where"] = (ingest.BLOCKED if first is not None else None), first
            if stopped:
                s["wait"] = []
    return final, state


def record(stream, position, locator=None, signature="s", ingest_=0, changed=False):
    return {"stream": stream, "source_position": position, "locator": locator or f"l{position}", "content_signature": signature, "payload": f"p{position}", "ingest": ingest_, "namespace": f"n{position % 3}", "basis": "origin", "prefix_changed": changed}


def run(spark, batches, folder, halt=False):
    source = f"{folder}/source"
    for rows in batches:  # every batch is a run of its own, which starts from the checkpoint
        spark.createDataFrame([tuple(r.values()) for r in rows], stateful.RECORD).repartition(2).write.mode("append").parquet(source)
        stateful.stateful_import(spark.readStream.schema(stateful.RECORD).parquet(source), f"{folder}/out", f"{folder}/checkpoint", halt).awaitTermination()
    log = stateful.import_log(spark, f"{folder}/out")
    receipts = {r["ingest"]: r["status"] for r in stateful.latest_receipts(log).collect()}
    routes = {r["stream"]: (r["namespace"], r["basis"]) for r in log.filter("kind = 'new' and source_position = 0").collect()}
    codes = {r["stream"]: (r["code"], r["source_position"]) for r in stateful.stop_codes(log).collect()}
    return receipts, routes, codes, log


def rows_of(r):
    rows = []
    for k in range(6):
        own = [record(f"s{k}", p) for p in range(9) if not (k == 2 and p == 4)]
        own += [record(f"s{k}", p) for p in r.sample(range(9), 2)] if k != 2 else []
        if k in (1, 3):
            own.append(record(f"s{k}", 2, signature="other"))
        if k == 4:
            own.append(record("s4", 5, locator="elsewhere"))
        r.shuffle(own)
        rows += own
    r.shuffle(rows)
    for i, x in enumerate(rows):
        x["ingest"] = i
    return rows


def held(found, state):
    receipts, routes, codes, log = found
    want, streams = state
    assert receipts == want
    assert routes == {k: s["route"] for k, s in streams.items() if s["route"]}
    assert {k: c for k, c in codes.items() if c[0]} == {k: (s["code"], s["where"]) for k, s in streams.items() if s["code"]}
    new = log.filter("kind = 'new'")
    assert {(r["stream"], r["n"], r["d"]) for r in new.groupBy("stream").agg(F.count("*").alias("n"), F.countDistinct("source_position").alias("d")).collect()} == {(k, s["at"] + 1, s["at"] + 1) for k, s in streams.items() if s["at"] >= 0}


@pytest.mark.parametrize("seed", [1])
def test_any_split_equals_a_replay(spark, tmp_path, seed):
    rows = rows_of(random.Random(seed))
    cuts = sorted(random.Random(seed + 9).sample(range(1, len(rows)), 2 + seed))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    held(run(spark, batches, str(tmp_path)), replay(batches))


def test_one_batch_equals_the_batch_job(spark, tmp_path):
    rows = rows_of(random.Random(5))
    receipts, *_ = run(spark, [rows], str(tmp_path))
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], stateful.RECORD)
    want = ingest.import_receipts(batch, batch.limit(0))
    assert receipts == {r["ingest"]: r["status"] for r in want.collect()}


def test_changed_prefixes_and_conflicts_stop_streams(spark, tmp_path):
    first = [record("a", 0), record("a", 1), record("b", 0), record("b", 2), record("c", 0), record("c", 0, signature="x")]
    second = [record("a", 0, changed=True), record("b", 1), record("c", 1)]
    third = [record("a", 2), record("a", 1), record("b", 3), record("c", 2)]
    n = 0
    for batch in (first, second, third):
        for x in batch:
            x["ingest"] = (n := n + 1)
    found = run(spark, [first, second, third], str(tmp_path), True)
    held(found, replay([first, second, third], True))
    assert found[2]["a"] == (stateful.PREFIX_CHANGED, None) and found[2]["b"] == (None, None) and found[2]["c"] == (ingest.CONFLICT, 0)


def test_waiting_records_of_one_batch_are_written_once():
    """Every record asked the state twice or more, and each wait rewrote what waited before."""
    from tracewright.streaming import stateful

    class State(dict):
        calls = 0

        def get(self):
            State.calls += 1
            return dict.get(self, ())

        def update(self, v):
            State.calls += 1
            self[()] = v

        def getValue(self, k):
            State.calls += 1
            return dict.get(self, k)

        def updateValue(self, k, v):
            State.calls += 1
            self[k] = v

        def removeKey(self, k):
            State.calls += 1
            del self[k]

    state = stateful.ImportState()
    state.head, state.held, state.waiting = State(), State(), State()
    row = lambda p: {"stream": "s", "source_position": p, "locator": f"n{p}", "content_signature": "x", "payload": None, "ingest": p, "namespace": "a", "basis": "b", "prefix_changed": False}
    ran = lambda *at: [(r.kind, r.status) for f in state.handleInputRows(("s",), iter([stateful.pd.DataFrame([row(p) for p in at])]), None) for r in f.itertuples()]
    assert ran(1, 3) == [("receipt", "blocked_by_earlier_gap")] * 2 + [("stop", "blocked_by_earlier_gap")]
    assert set(state.waiting) == {(1,), (3,)} and State.calls == 4
    assert ran(0, 2) == [("new", "new")] * 4 + [("stop", None)]
    assert not state.waiting and set(state.held) == {("n0",), ("n1",), ("n2",), ("n3",)}
