"""Which namespace a stream belongs to: remote overrides, allowed origins, directories, and a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a stream without a route goes, and names that no policy may target.
FALLBACK = ("capture/unscoped", "fallback")
RESERVED = r"^(memory-system|capture/.*)$"


def normalize_remote(url: Column) -> Column:
    """`host/owner/name` of a URL or an scp-like address: lower case, last two parts of the path, without `.git`, query and
    fragment; null without a host or with fewer than two parts."""
    text = F.trim(url)
    is_url = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    host = F.when(is_url, F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).otherwise(F.regexp_extract(text, r"^(?:[^@/\s]+@)?([^:/\s]+):", 1))
    path = F.when(is_url, F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(text, r"^[^:/\s]+:([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.git$", "")
    ok = (host != "") & (F.size(parts) >= 2) & (name != "")
    return F.when(ok, F.lower(F.concat_ws("/", host, F.try_element_at(parts, F.lit(-2)), F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?i)\.git$", ""))))


def normalize_directory(path: Column) -> Column:
    """An absolute directory with single slashes and none at its end, `\\` as `/`; null if it isn't absolute."""
    p = F.regexp_replace(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/"), "(.)/$", "$1")
    return F.when(p.rlike("^(/|[A-Za-z]:/)"), p)


def override_route(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    """stream, namespace, basis by the first remote that a policy overrides: origin, then the others in their order; a remote's
    first rule counts. evidence: stream, binding, working_directory, remotes array<struct<name, url>>, dirty."""
    remotes = evidence.select("stream", "binding", F.posexplode("remotes").alias("place", "r"))
    remotes = remotes.select("stream", "binding", (F.col("r.name") != "origin").alias("other"), "place", normalize_remote(F.col("r.url")).alias("remote"))
    rules = policies.select("binding", F.posexplode("remote_overrides").alias("rule", "o")).select("binding", "rule", F.lower("o.remote").alias("remote"), F.col("o.target").alias("namespace"))
    hits = remotes.join(rules, ["binding", "remote"])
    return hits.groupBy("stream").agg(F.min_by("namespace", F.struct("other", "place", "rule")).alias("namespace")).withColumn("basis", F.lit("override"))


def glob_regex(pattern: Column) -> Column:
    """An anchored regex of an owner/name pattern in which * stands for anything but a slash."""
    escaped = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", "[^/]*"), F.lit("$"))


def origin_route(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    """stream, `repo/owner/name`, basis for streams whose origin matches an allowed pattern of their policy."""
    origin = F.filter("remotes", lambda r: r["name"] == "origin")
    rows = evidence.select("stream", "binding", normalize_remote(F.try_element_at(origin, F.lit(1))["url"]).alias("remote")).filter("remote is not null")
    rows = rows.withColumn("repo", F.substring_index("remote", "/", -2))
    allowed = policies.select("binding", F.explode("allowed_repository_patterns").alias("p")).select("binding", glob_regex(F.lower(F.trim("p"))).alias("pattern"))
    hits = rows.join(allowed, "binding").filter(F.expr("repo rlike pattern"))
    return hits.select("stream", F.concat(F.lit("repo/"), "repo").alias("namespace"), F.lit("origin").alias("basis")).distinct()


def directory_route(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    """stream, namespace, basis by the longest routed directory that the working directory lies in. A path is exploded into
    its own prefixes, which makes the longest-prefix match an equi-join."""
    rows = evidence.select("stream", "binding", normalize_directory(F.col("working_directory")).alias("d")).filter("d is not null")
    parts = F.split("d", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = rows.select("stream", "binding", F.explode(F.transform(prefixes, lambda p: F.when(p == "", "/").otherwise(p))).alias("directory"))
    routes = policies.select("binding", F.explode("directory_routes").alias("r")).select("binding", normalize_directory(F.col("r.directory")).alias("directory"), F.col("r.target").alias("namespace"))
    hits = rows.join(routes, ["binding", "directory"])
    return hits.groupBy("stream").agg(F.min_by("namespace", F.struct((-F.char_length("directory")).alias("l"), "directory", "namespace")).alias("namespace")).withColumn("basis", F.lit("directory"))


def resolve_route(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    """stream, namespace, basis of every row of evidence: override, else origin, else directory, else the fallback. Evidence
    from which a secret was redacted (dirty) selects nothing."""
    clean = evidence.filter(~F.coalesce(F.col("dirty"), F.lit(False))) if "dirty" in evidence.columns else evidence
    out = evidence.select("stream").distinct()
    for k, route in enumerate((override_route, origin_route, directory_route)):
        out = out.join(route(clean, policies).select("stream", F.struct("namespace", "basis").alias(f"r{k}")), "stream", "left")
    chosen = F.coalesce("r0", "r1", "r2", F.struct(F.lit(FALLBACK[0]).alias("namespace"), F.lit(FALLBACK[1]).alias("basis")))
    return out.select("stream", chosen["namespace"].alias("namespace"), chosen["basis"].alias("basis"))


def first_route_wins(routes: DataFrame, streams: DataFrame) -> DataFrame:
    """stream, namespace, basis: a stream that has a namespace keeps it (`established`); otherwise the route of its first
    record (source_position, ingest) counts."""
    first = routes.groupBy("stream").agg(F.min_by(F.struct("namespace", "basis"), F.struct("source_position", "ingest")).alias("r"))
    held = streams.select("stream", F.col("namespace").alias("held"))
    rows = first.join(held, "stream", "left")
    return rows.select("stream", F.coalesce("held", "r.namespace").alias("namespace"), F.when(F.col("held").isNotNull(), "established").otherwise(F.col("r.basis")).alias("basis"))


def canonical_policy(policies: DataFrame, namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(policies in canonical form, violations of (policy_version, binding, rule)).

    Patterns are trimmed and lower-cased, remotes and directories normalised. Keys have to be unique, targets known and not
    reserved, remotes and directories readable.
    """
    low = F.array_distinct(F.transform("allowed_repository_patterns", lambda p: F.lower(F.trim(p))))
    remotes = F.transform("remote_overrides", lambda o: F.struct(F.coalesce(normalize_remote(o["remote"]), F.lower(F.trim(o["remote"]))).alias("remote"), F.trim(o["target"]).alias("target")))
    folders = F.transform("directory_routes", lambda r: F.struct(normalize_directory(r["directory"]).alias("directory"), F.trim(r["target"]).alias("target")))
    out = policies.withColumns({"allowed_repository_patterns": low, "remote_overrides": remotes, "directory_routes": folders})
    targets = F.concat(F.transform("remote_overrides", lambda o: o["target"]), F.transform("directory_routes", lambda r: r["target"]))
    keys = lambda c, k: F.transform(c, lambda x: x[k])
    twice = lambda c, k: F.size(F.array_distinct(keys(c, k))) < F.size(c)
    faults = F.array(
        F.when(twice("remote_overrides", "remote"), "repeated remote"),
        F.when(twice("directory_routes", "directory"), "repeated directory"),
        F.when(F.exists("directory_routes", lambda r: r["directory"].isNull()), "directory isn't absolute"),
        F.when(F.exists("remote_overrides", lambda o: ~o["remote"].rlike("^[^/]+/[^/]+/[^/]+$")), "remote isn't host/owner/name"),
        F.when(F.exists("allowed_repository_patterns", lambda p: ~p.rlike("^[^/]+/[^/]+$")), "pattern isn't owner/name"),
        F.when(F.exists(targets, lambda t: t.rlike(RESERVED)), "reserved target"),
    )
    found = out.select("policy_version", "binding", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("rule"))
    # each target asks for its namespace by name; a row with several unknown ones is named once
    asked = out.withColumn("__row", F.monotonically_increasing_id()).select("__row", "policy_version", "binding", F.explode(targets).alias("name"))
    unknown = asked.join(namespaces.select("name"), "name", "left_anti").groupBy("__row", "policy_version", "binding").agg(F.lit("unknown target").alias("rule"))
    return out, found.unionByName(unknown.drop("__row"))


def latest_policy(policies: DataFrame) -> DataFrame:
    """The newest version of each binding's policy."""
    columns = [c for c in policies.columns if c != "binding"]
    return policies.groupBy("binding").agg(F.max_by(F.struct(*columns), "policy_version").alias("p")).select("binding", *(F.col(f"p.{c}").alias(c) for c in columns))


def ensure_namespaces(routes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """name of every routed repository namespace that isn't there yet, once."""
    return routes.filter(F.col("namespace").startswith("repo/")).select(F.col("namespace").alias("name")).distinct().join(namespaces, "name", "left_anti")
