from tracewright.operators import provenance

SCHEMA = "uuid string, version long, status string, source_type string, source_id string, supersedes string"


def test_why_walks_to_the_root_of_long_chains_and_ends_on_cycles(spark):
    n = 2100
    rows = [(f"m{k}", k, "active", "trace", "s", f"m{k - 1}" if k else None) for k in range(n)]
    rows += [(f"c{k}", k, "active", "trace", "s", f"c{(k + 1) % 3}") for k in range(3)] + [("d", 0, "active", "trace", "s", "c1")]
    rows += [("lost", 0, "active", "trace", "s", "not kept"), ("self", 0, "active", "trace", "s", "self")]
    memories = spark.createDataFrame(rows, SCHEMA)
    roots = spark.createDataFrame([(f"m{n - 1}",), ("c2",), ("d",), ("lost",), ("self",), ("unknown",)], "uuid string")
    got = {(r.root, r.uuid): r.depth for r in provenance.why(memories, roots).collect()}
    want = {(f"m{n - 1}", f"m{k}"): n - 1 - k for k in range(n)}
    want |= {("c2", f"c{x}"): k for k, x in enumerate((2, 0, 1))} | {("d", "d"): 0} | {("d", f"c{x}"): k + 1 for k, x in enumerate((1, 2, 0))}
    assert got == want | {("lost", "lost"): 0, ("self", "self"): 0}
