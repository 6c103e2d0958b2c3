import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from tracewright.functions import ids
from tracewright.operators import ingest, lifecycle, normalize, quality, reads, routing, search
from tracewright.sources import ledger, transcripts
from tracewright.streaming import imports


def sequential(batch, held):
    """Receipts of records taken one by one in order of position and ingest."""
    by_locator = {(s, l): g for s, p, l, g in held}
    taken = {(s, p) for s, p, _, _ in held}
    mark = {}
    for s in {r[0] for r in [*batch, *held]}:
        n = -1
        while (s, n + 1) in taken:
            n += 1
        mark[s] = n
    out = {}
    for s, p, l, g, i in sorted(batch, key=lambda r: (r[0], r[1], r[4])):
        if (s, l) in by_locator:
            out[i] = ingest.ACCEPTED if by_locator[s, l] == g else ingest.CONFLICT
        elif (s, p) in taken:
            out[i] = ingest.CONFLICT
        elif p == mark[s] + 1:
            out[i] = ingest.NEW
            by_locator[s, l] = g
            taken.add((s, p))
            mark[s] = p
        else:
            out[i] = ingest.BLOCKED
    return out


def test_receipts_equal_one_by_one_import(spark):
    r = random.Random(3)
    for _ in range(3):
        held = [(s, p, f"l{p}", "g") for s in range(12) for p in range(r.randrange(4))]
        batch, n = [], 0
        for s in range(14):
            for p in range(7):
                for _ in range(r.choice([0, 1, 1, 2])):
                    batch.append((s, p, f"l{p}" if r.random() < 0.9 else f"m{p}", r.choice("gggh"), n))
                    n += 1
        b = spark.createDataFrame(batch, "stream long, source_position long, locator string, content_signature string, ingest long")
        h = spark.createDataFrame(held, "stream long, source_position long, locator string, content_signature string")
        got = {x.ingest: x.status for x in ingest.import_receipts(b.repartition(5), h).collect()}
        want = sequential(batch, held)
        assert len(got) == len(batch)
        # copies of a record that is new or held in the batch may be told apart only there
        assert {k: v for k, v in got.items() if v in (ingest.NEW, ingest.ACCEPTED)} == {k: v for k, v in want.items() if v in (ingest.NEW, ingest.ACCEPTED)}


def test_stream_import_closes_gaps(spark, tmp_path):
    rows = [(s, p, f"l{p}", "g", "x", p) for s in range(3) for p in range(6)]
    make = lambda rs: spark.createDataFrame(rs, imports.RECORD)
    got = imports.run_import(spark, [make([x for x in rows if x[1] != 2]), make([x for x in rows if x[1] == 2] + rows[:3]), make(rows[:1])], str(tmp_path))
    assert sorted((x.stream, x.source_position) for x in got.collect()) == sorted((s, p) for s, p, *_ in rows)
    left = imports.dedup_stream(make(rows), got, ["stream", "locator"])
    assert left.count() == 0


def test_hmac_and_ids(spark):
    keys = {"a": b"short", "b": b"k" * 100}
    df = spark.createDataFrame([("a", "x", "é"), ("b", "x", None), ("c", "x", "y")], "binding string, i string, t string")
    got = {r.binding: r.content_signature for r in ids.content_signature(df, ids.hmac_pads(spark, keys), "binding", "i", "t").collect()}
    for k, t in (("a", "2:é"), ("b", "-")):
        assert got[k] == hmac.new(keys[k], f"1:x{t}".encode(), hashlib.sha256).hexdigest()
    assert got["c"] is None
    versions = spark.createDataFrame([("2", ["1"])], "version string, prior_versions array<string>")
    many = ids.version_compatible_signatures(df.withColumn("v", F.lit("2")), versions, ids.hmac_pads(spark, keys), "binding", "v", "i", "t").filter("binding = 'a'").first().signatures
    assert many == [hmac.new(b"short", f"1:{v}1:x2:é".encode(), hashlib.sha256).hexdigest() for v in "21"]
    pairs = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), ("", None), (None, ""), ("1:a", ""), ("1", "a")], "x string, y string")
    assert pairs.select(ids.deterministic_id("d", F.col("x"), F.col("y"))).distinct().count() == 6
    one = df.select(ids.deterministic_id("d", F.col("i"))).first()[0]
    assert len(one) == 36 and one[14] == "8" and one[19] in "89ab"


def test_remotes_and_policies(spark):
    urls = {"https://Git.Example.com/Owner/Name.git?x=1#y": "git.example.com/owner/name", "git@host.org:team/sub/repo.git": "host.org/sub/repo", "ssh://user@h:22/a/b/": "h/a/b", "https://h/only": None, "": None, "nonsense": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(routing.normalize_remote(F.col("u"))).collect()] == list(urls.values())
    policy = [("b", 1, ["A/*", "bad"], [("h/x/y", "memory-system"), ("H/X/Y", "n1")], [("rel", "n2"), ("/a//b/", "n1")])]
    kind = "binding string, policy_version long, allowed_repository_patterns array<string>, remote_overrides array<struct<remote:string,target:string>>, directory_routes array<struct<directory:string,target:string>>"
    fixed, faults = routing.canonical_policy(spark.createDataFrame(policy, kind), spark.createDataFrame([("n1",)], "name string"))
    assert fixed.first().directory_routes[1].directory == "/a/b"
    assert {r.rule for r in faults.collect()} == {"repeated remote", "directory isn't absolute", "pattern isn't owner/name", "reserved target", "unknown target"}
    twice = [("b", k, [], [("h/x/y", t)], [("/a", t), ("/b", t)]) for k, t in ((2, "n1"), (3, "n3"), (3, "n3"), (4, None))] + [("b", 5, None, None, None)]
    names = spark.createDataFrame([("n1",), ("n1",), (None,)], "name string")
    assert sorted(tuple(r) for r in routing.canonical_policy(spark.createDataFrame(twice, kind), names)[1].collect()) == [(3, "b", "unknown target"), (3, "b", "unknown target"), (4, "b", "unknown target")]
    none = routing.canonical_policy(spark.createDataFrame(twice[:1], kind), names.limit(0))[1]
    assert [r.rule for r in none.collect()] == ["unknown target"]


def test_search_language_and_cover_density(spark):
    docs = [(1, "n", "quick brown fox jumps"), (2, "n", "the fox is quick and brown"), (3, "n", "brown bear"), (4, "n", "lazy dog")]
    memories = spark.createDataFrame(docs, "uuid int, namespace string, content string")
    index = search.build_index(memories)
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id int, query string")
    found = lambda q: sorted(r.uuid for r in search.fts_match(search.parse_websearch(ask(q)), index).collect())
    assert found("quick fox") == [1, 2]
    assert found('"brown fox"') == [1]
    assert found("bear or dog") == [3, 4]
    assert found("brown -fox") == [3]
    assert found("-fox") == []
    score = {r.uuid: r.score for r in search.fts_rank(search.fts_match(search.parse_websearch(ask("quick fox")), index)).collect()}
    assert score[1] == 0.1 / 2 and score[2] == 0.1 / 2
    stems = {r.lexeme for r in search.tokenize(memories, "content", "english").collect()}
    assert "the" not in stems and "jump" in stems


def test_transcripts_are_located_by_bytes(spark, tmp_path):
    folder = tmp_path / "archived_sessions"
    folder.mkdir()
    head = json.dumps({"type": "session_meta", "payload": {"id": "s1"}})
    data = [head.encode() + b"\r\n", b"\n", "{\"é\":1}\n".encode(), b"\r\n", b'{"type":"\xff"}\n', b"open end"]
    (folder / "a.jsonl").write_bytes(b"".join(data))
    (tmp_path / "b.jsonl").write_bytes(head.encode() + b"\nnot json\ntail")
    (tmp_path / "c.jsonl").write_bytes(b"no meta\n")
    rows = transcripts.terminality(transcripts.locate_records(transcripts.read_transcripts(spark, str(tmp_path)))).orderBy("file", "source_position").collect()
    a = [r for r in rows if r.file.endswith("a.jsonl")]
    at = [sum(map(len, data[:k])) for k in (0, 2, 4, 5)]
    assert [(r.source_position, r.byte_offset, r.byte_length) for r in a] == [(k, at[k], len(data[j])) for k, j in enumerate((0, 2, 4, 5))]
    assert [r.record_sha256 for r in a] == [hashlib.sha256(data[j]).hexdigest() for j in (0, 2, 4, 5)]
    assert [r.is_terminal for r in a] == [True] * 4
    assert [r.is_terminal for r in rows if r.file.endswith("b.jsonl")] == [True, True, False]
    df = transcripts.locate_records(transcripts.read_transcripts(spark, str(tmp_path)))
    kinds = [r[0] for r in df.orderBy("file", "source_position").select(transcripts.classify_record(F.col("value"))).collect()]
    assert kinds[:4] == ["structured", "structured", "uninspectable", "malformed"]
    known, bad = transcripts.resolve_session_identity(df)
    assert {r.external_session_id for r in known.collect()} == {"s1"} and [r.reason for r in bad.collect()] == ["no_session_meta"]
    assert len(transcripts.duplicate_transcripts(known).first().files) == 2
    marks = spark.createDataFrame([(r.file, at[2]) for r in a[:1]], "file string, verified_length long")
    tail = transcripts.incremental_file_tail(spark, str(tmp_path), marks)
    assert sorted(r.byte_offset for r in tail.filter(F.col("file").endswith("a.jsonl")).collect()) == at[2:]


def test_normalization_of_both_dialects(spark):
    item = lambda p, **k: json.dumps({"type": "response_item", "payload": p} | k)
    values = [
        item({"type": "message", "role": "robot", "content": "hi"}, cli_version={"name": "9"}),
        item({"type": "reasoning", "summary": [{"type": "summary_text", "text": "s"}], "content": [{"type": "reasoning_text", "text": "c"}, 5]}),
        item({"type": "web_search_call", "id": "w", "status": "completed", "action": {"q": 1}}),
        item({"type": "custom_tool_call", "call_id": "c", "name": "t", "input": "plain"}),
        json.dumps({"type": "session_meta", "payload": {"id": "s", "timestamp": "2024-05-01T10:00:00Z", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}, "forked_from_id": "f", "cli_version": "7"}}),
        json.dumps({"type": "compacted", "payload": {"message": "m", "window_id": 3}}),
        json.dumps({"hook_event_name": "PreCompact", "trigger": "auto"}),
        json.dumps({"type": "event_msg", "payload": {"type": "turn_aborted", "reason": "stop"}}),
        json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "x"}}),
        json.dumps({"type": "new_thing", "payload": {"a": 1}}),
        json.dumps({"type": "response_item", "payload": 7}),
        "broken {",
    ]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "stream long, source_position long, value string")
    n = normalize.normalize(df)
    got = {}
    for e in n.events.orderBy("source_position", "part_order").collect():
        got.setdefault(e.source_position, []).append((e.part_key, e.kind, e.actor))
    assert [[k for _, k, _ in got[i]] for i in range(len(values))] == [["message"], ["reasoning", "reasoning", "opaque"], ["tool_call", "tool_result"], ["tool_call"], ["context"], ["compaction"], ["compaction"], ["error"], ["annotation"], ["opaque"], ["opaque"], ["opaque"]]
    assert got[0] == [("content:message", "message", "unknown")]
    edges = {(r.relationship_type, r.target_native_id) for r in n.relationships.collect()}
    assert {("parent_session", "p"), ("spawned_by", "p"), ("forked_from", "f"), ("result_for", "w"), ("source_classification", "subagent")} == edges
    seen = {r.source_position: r for r in n.observations.collect()}
    assert seen[0].harness_version == "9" and seen[4].harness_version == "7" and seen[11].record_type == "malformed_json"
    assert str(n.events.filter("source_position = 4").first().occurred_at) == "2024-05-01 10:00:00"
    blocks = [json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "tool_use", "id": "u", "name": "n", "input": {}}]}}), json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u", "is_error": True}]}}), json.dumps({"type": "system", "subtype": "api_error", "error": {"text": "bad"}})]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(blocks)], "stream long, source_position long, value string")
    events = normalize.normalize(df, "blocks").events.orderBy("source_position", "part_order").collect()
    assert [e.kind for e in events] == ["message", "tool_call", "tool_result", "error"]
    assert json.loads(events[2].payload)["outcome"] == "failed" and json.loads(events[3].payload)["text"] == "bad"


def test_lifecycles(spark):
    ts = F.lit("2024-01-01").cast("timestamp")
    none = spark.createDataFrame([], lifecycle.MEMORY)
    batch = spark.createDataFrame([("n", "fact", "clean", "trace", "t", "a", "s", None), ("n", "fact", "token = abcdefgh", "trace", "t", "a", "s", None)], "namespace string, type string, content string, source_type string, source_id string, agent_id string, session_id string, supersedes string").withColumn("ts", ts)
    memories, traces, notes = lifecycle.propose(batch, none)
    assert memories.count() == 1 and traces.first().event_type == "memory_proposed" and "token" not in notes.first().content
    first = memories.first().uuid
    second, _, _ = lifecycle.propose(batch.limit(1).withColumns({"supersedes": F.lit(first), "content": F.lit("newer")}), memories)
    both = memories.unionByName(second)
    other = second.first().uuid
    assert second.first().version == 2
    orders = [(1, first, "approve", "ann", None), (2, first, "approve", "ann", None), (3, other, "reject", "ann", " "), (4, other, "approve", "bot:x", None), (5, "none", "approve", "ann", None)]
    commands = spark.createDataFrame(orders, "seq long, uuid string, action string, actor string, reason string").withColumn("ts", ts)
    state, decided, errors = lifecycle.apply_reviews(commands, both)
    assert {r.uuid: r.status for r in state.collect()} == {first: "superseded", other: "approved"}
    assert sorted((r.seq, r.error) for r in errors.collect()) == [(2, "wrong_status"), (3, "reason_required"), (5, "unknown_memory")]
    assert {r.agent_id for r in decided.collect()} == {"human:ann", "bot:x"}
    amended, _, wrong = lifecycle.apply_amendments(spark.createDataFrame([(first, "better", "ann"), (other, "password = hunter22", "ann")], "uuid string, content string, actor string").withColumn("ts", ts), both)
    assert sorted((r.status, r.version) for r in amended.collect()) == [("approved", 2), ("proposed", 2), ("superseded", 1)] and wrong.first().error == "sensitive-assignment"
    work = [(1, "checkout", "n", "T", None, "a", None), (2, "checkout", "n", "T", None, "b", None), (3, "check_in", "n", "T", None, "b", "done"), (4, "check_in", "n", "T", None, "a", "open"), (5, "checkout", "n", "T", None, "b", None), (6, "check_in", "n", "T", None, "b", "done"), (7, "release", "n", "T", None, "b", None)]
    commands = spark.createDataFrame(work, "seq long, action string, namespace string, title string, uuid string, agent_id string, status string").withColumns({"session_id": F.lit("s"), "notes": F.lit(None).cast("string"), "refs": F.lit(None).cast("string"), "ts": ts})
    state, done, errors = lifecycle.apply_workstream_commands(commands, spark.createDataFrame([], lifecycle.WORKSTREAM))
    assert [(r.status, r.owner_agent) for r in state.collect()] == [("done", "b")]
    assert sorted((r.seq, r.error) for r in errors.collect()) == [(2, "conflict"), (3, "not_owner"), (7, "unknown_workstream")]
    assert sorted(r.seq for r in done.collect()) == [1, 4, 5, 6]


def test_append_only_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n"), (2, "n"), (2, "n")], "id long, namespace string")
    for _ in range(2):
        ledger.append_ledger(rows, str(tmp_path / "t"), ["id"])
    assert ledger.read_ledger(spark, str(tmp_path / "t"), rows.schema).count() == 2
    locators = spark.createDataFrame([(1, ("native_id", "x", None, None)), (2, ("byte_range", None, 0, 5)), (3, ("native_id", None, None, None)), (4, None)], "id long, locator struct<kind:string,native_id:string,byte_offset:long,byte_length:long>")
    assert {r.key for r in quality.check_locator_shape(locators, "t", "id").collect()} == {"3", "4"}
    edges, streams = spark.createDataFrame([(1, "parent_session", None, "9")], "stream long, relationship_type string, target_stream long, native_id string"), spark.createDataFrame([(1, "b", "1", None, "n")], "stream long, binding string, external_session_id string, child_id string, namespace string")
    asked = spark.createDataFrame([(1,), (5,)], "session long")
    got = reads.navigate_sessions(edges, streams, asked, ["n"]).orderBy("session").collect()
    assert [(r.session, r.availability, r.error) for r in got] == [(1, "unavailable", None), (5, None, "not_permitted")]


def test_reviews_of_a_chain_are_folded_in_their_order(spark):
    """What an approval supersedes can't be retired or approved afterwards."""
    mem = "uuid string, namespace string, visibility string, status string, source_type string, source_id string, supersedes string"
    rows = [("A", "approved", None), ("B", "proposed", "A"), ("C", "proposed", "A"), ("D", "proposed", "C"), ("E", "proposed", None), ("F", "proposed", "gone")]
    memories = spark.createDataFrame([(u, "n", "shared", s, "trace", "x", p) for u, s, p in rows], mem)
    acts = [("approve", "B"), ("retire", "A"), ("approve", "D"), ("approve", "C"), ("retire", "B"), ("approve", "F"), ("reject", "E"), ("approve", "Z")]
    commands = spark.createDataFrame([(k, u, a, "ann", "why", None) for k, (a, u) in enumerate(acts)], "seq int, uuid string, action string, actor string, reason string, ts timestamp")
    new, traces, errors = lifecycle.apply_reviews(commands, memories)
    assert {r.uuid: r.status for r in new.collect()} == {"A": "superseded", "B": "retired", "C": "superseded", "D": "approved", "E": "rejected", "F": "approved"}
    assert {(r.seq, r.error) for r in errors.collect()} == {(1, "wrong_status"), (3, "wrong_status"), (7, "unknown_memory")}
    assert sorted(r.event_type for r in traces.collect()) == ["approval", "approval", "approval", "rejection", "retirement"]


def test_places_of_large_groups(spark):
    from tracewright.functions.numbering import numbered

    r = random.Random(1)
    rows = [(g, r.randrange(50) if r.random() < 0.9 else None, k) for k, g in enumerate([0] * 400 + [1] * 3)]
    df = spark.createDataFrame(rows, "g int, x int, k int")
    got = {x.k: x.place for x in numbered(df, ["g"], F.col("x").cast("double"), ["k"]).collect()}
    for g in (0, 1):
        mine = sorted((row for row in rows if row[0] == g), key=lambda row: (-1 if row[1] is None else row[1], row[2]))
        assert [got[k] for _, _, k in mine] == list(range(1, len(mine) + 1))


def test_tails_continue_where_they_were(spark, tmp_path):
    file = tmp_path / "a.jsonl"
    file.write_bytes(b'{"a":1}\n\n{"b":2}\r\n')
    first = transcripts.incremental_file_tail(spark, str(tmp_path), spark.createDataFrame([], "file string, verified_length long, verified_records long")).orderBy("byte_offset").collect()
    whole = transcripts.locate_records(transcripts.read_transcripts(spark, str(tmp_path))).orderBy("byte_offset").collect()
    assert [(r.source_position, r.byte_offset, r.byte_length, r.record_sha256, r.value) for r in first] == [(r.source_position, r.byte_offset, r.byte_length, r.record_sha256, r.value) for r in whole]
    done = spark.createDataFrame([(first[0].file, file.stat().st_size, 2)], "file string, verified_length long, verified_records long")
    assert transcripts.incremental_file_tail(spark, str(tmp_path), done).count() == 0
    with file.open("ab") as f:
        f.write(b'{"c":3}\n{"unfinished":')
    more = transcripts.incremental_file_tail(spark, str(tmp_path), done).collect()
    assert [(r.source_position, r.value) for r in more] == [(2, '{"c":3}')]


def test_copies_in_one_micro_batch_pass_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([(2,)], "k int")
    stream = imports.dedup_stream(spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in")), held, ["k"])
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_rule_files(spark, tmp_path):
    import pytest

    good = 'version: "v1"\nrules:\n  - {id: a, category: provider_token, priority: 5, prefilter: "tok,key", matcher: regex, pattern: "tok-[a-z]+"}\n'
    (tmp_path / "r.yaml").write_text(good)
    (tmp_path / "l.txt").write_text("# values\n\n  a long literal  \n")
    rules = ledger.load_rules(str(tmp_path / "r.yaml"), None, str(tmp_path / "l.txt"))
    assert rules.version == "v1+literals:1" and rules.rules[0].prefilter == ("tok", "key") and rules.literals == ("a long literal",)
    (tmp_path / "r.json").write_text(json.dumps({"version": "v2", "rules": [rules.rules[0]._asdict()]}))
    assert ledger.load_rules(str(tmp_path / "r.json")).version == "v2"
    for bad in ("", "rules: 5\nversion: v", "version: v\nrules:\n - 3", "rules: [", good.replace("regex", "glob"), good.replace('version: "v1"\n', "")):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(ValueError):
            ledger.load_rules(str(tmp_path / "b.yaml"))


def test_appends_read_only_buckets_that_may_hold_their_keys(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("stream"), (F.col("id") % 3).alias("n"), F.lit("payload").alias("payload"))
    ledger.append_ledger(rows(0, 500), path, ["stream", "n"], buckets=16)
    assert ledger.may_hold(rows(10_000, 10_004), path, ["stream", "n"], buckets=16) in ([], *[[k] for k in range(16)])
    known = rows(7, 8)
    only = ledger.may_hold(known, path, ["stream", "n"], buckets=16)
    assert len(only) == 1
    held = ledger.read_ledger(spark, path, known.schema, only).select("stream", "n")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket_no" in plan.split("PartitionFilters: [")[1].split("]")[0] and "payload" not in plan.split("ReadSchema")[1].split("\n")[0]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(held) == 1
    ledger.append_ledger(rows(490, 2000), path, ["stream", "n"], buckets=16)
    ledger.append_ledger(rows(0, 2000), path, ["stream", "n"], buckets=16)
    got = ledger.read_ledger(spark, path, known.schema)
    assert got.count() == got.select("stream").distinct().count() == 2000
    assert files(ledger.read_ledger(spark, path, known.schema, only)) == 2 and files(ledger.read_ledger(spark, path, known.schema)) > 16
    odd = spark.createDataFrame([(None, 1, "x"), (None, 1, "y"), (5000, None, "z")], "stream long, n long, payload string")
    for _ in range(2):
        ledger.append_ledger(odd, path, ["stream", "n"], buckets=16)
    assert ledger.read_ledger(spark, path, known.schema).filter("stream is null or n is null").count() == 2


def test_a_batch_that_runs_again_keeps_its_receipts(spark, tmp_path):
    rows = spark.createDataFrame([(1, p, f"l{p}", "g", "x", p) for p in (0, 1, 3)], imports.RECORD)
    for _ in range(2):
        imports.import_batch(rows, str(tmp_path / "ledger"), str(tmp_path / "retry"), str(tmp_path / "receipts"), 0)
    assert sorted((r.source_position, r.status) for r in spark.read.parquet(str(tmp_path / "receipts" / "0")).collect()) == [(0, "new"), (1, "new"), (3, "blocked_by_earlier_gap")]
    assert ledger.read_ledger(spark, str(tmp_path / "ledger"), imports.RECORD).count() == 2


def test_large_streams_are_counted_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ingest, "_RANGE", 8)
    r = random.Random(2)
    streams = {0: range(300), 1: [p for p in range(40) if p != 16], 2: [p for p in range(40) if p != 17], 3: range(16), 4: range(1, 9), 5: [0], 6: [*range(8), *range(24, 32)]}
    rows = [(s, p) for s, ps in streams.items() for p in [*ps, *ps]]
    r.shuffle(rows)
    got = {x.stream: x.checkpoint for x in ingest.contiguous_checkpoint(spark.createDataFrame(rows, "stream long, source_position long")).collect()}
    assert got == {0: 299, 1: 15, 2: 16, 3: 15, 4: -1, 5: 0, 6: 7}
    held = spark.createDataFrame([(0, p, f"l{p}", "g", "x", p) for p in (0, 1, 3)], imports.RECORD)
    batch = spark.createDataFrame([(0, p, f"l{p}", "g", "x", p) for p in (2, 4, 5)] + [(1, p, f"l{p}", "g", "x", p) for p in (*range(30), 31)], imports.RECORD)
    status = {(x.stream, x.source_position): x.status for x in ingest.import_receipts(batch, held).collect()}
    assert [k for k, v in sorted(status.items()) if v == ingest.BLOCKED] == [(0, 4), (0, 5), (1, 31)]
    named = ingest.backfill_positions(spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", None), (2, "x", 1.0)], "s int, n string, t double"), ["s"], ["t", "n"])
    assert {(x.s, x.n): x.source_position for x in named.collect()} == {(1, "c"): 0, (1, "a"): 1, (1, "b"): 2, (2, "x"): 0}


def test_text_of_any_depth(spark):
    r = random.Random(6)

    def value(depth):
        k = r.random()
        if depth == 0 or k < 0.2:
            return r.choice(["s", " padded ", "", 'q"[{', 7, 1.5, True, {}, [], {"other": "x"}, {"text": 5}])
        if k < 0.6:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        return {"content": value(depth - 1)} if k < 0.9 else {"text": r.choice(["t", " t ", " ", 3]), "content": value(depth - 1)}

    def flat(v):
        if isinstance(v, str):
            return v
        if isinstance(v, list):
            return "\n".join(flat(x) for x in v)
        if isinstance(v, dict):
            if isinstance(v.get("text"), str) and v["text"].strip(" "):
                return v["text"].strip(" ")
            return flat(v["content"]) if "content" in v else json.dumps(v, separators=(",", ":"))
        return json.dumps(v)

    deep = "end"
    for i in range(120):
        deep = [deep, str(i)] if i % 3 else {"content": deep}
    values = [value(r.randrange(9)) for _ in range(150)] + [deep]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, j string")
    got = {x.i: x.t for x in df.select("i", normalize.flatten_text(F.try_parse_json("j")).alias("t")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(values))] == [flat(v) for v in values]
