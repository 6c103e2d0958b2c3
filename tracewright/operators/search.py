"""Ranked retrieval over memories for batches of requests.

requests: query_id, agent_id, namespaces array<string>, query, and optionally types array<string>, lanes array<string>,
max_rows int. memories: the ledger's memories with at least uuid, namespace, type, visibility, status, content, agent_id,
created_at (a timestamp, or seconds). Lanes carry ids and scores only; content is joined back after the cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import staged
from ..functions.text import english, lexemes, preview, tokenize, word_blocks  # noqa: F401 (tokenize: for callers)
from ..sources import index_store
from ..sources.index_store import open_index, postings

#: What holds without a configuration row, and the constant of reciprocal-rank fusion.
DEFAULTS = {"recency_half_life_h": 720.0, "max_results": 10, "preview_chars": 200, "include_proposed": False}
LANES = ("fts", "recency")
RRF_K = 60
#: Lexemes or namespaces up to which tasks are told what is asked for; more are joined.
FEW = 10_000


def authorize(requests: DataFrame, grants: DataFrame, default: str = "default") -> tuple[DataFrame, DataFrame]:
    """(allowed, forbidden with the namespaces at fault): grants is (agent_id, namespaces); `default` is open to all."""
    held = requests.join(grants.withColumnRenamed("namespaces", "__granted"), "agent_id", "left")
    wrong = F.array_except("namespaces", F.array_append(F.coalesce("__granted", F.array().cast("array<string>")), F.lit(default)))
    held = held.withColumn("forbidden", wrong).drop("__granted")
    return held.filter(F.size("forbidden") == 0).drop("forbidden"), held.filter(F.size("forbidden") > 0)


def effective_config(requests: DataFrame, config: DataFrame) -> DataFrame:
    """requests with the most specific row of config (agent and namespace, agent, namespace, any; `*` is any) for their agent
    and their first namespace, or the defaults."""
    # each request asks under four keys, the most specific first, so that one equality join answers it
    rows = config.select(F.col("agent_id").alias("__a"), F.col("namespace").alias("__n"), F.struct(*DEFAULTS).alias("__c"))
    first, any_ = F.get("namespaces", F.lit(0)), F.lit("*")
    keys = [F.struct(a.alias("__a"), n.alias("__n"), F.lit(k).alias("__k")) for k, (a, n) in enumerate(((F.col("agent_id"), first), (F.col("agent_id"), any_), (any_, first), (any_, any_)))]
    best = requests.select("query_id", F.inline(F.array(*keys))).join(rows, ["__a", "__n"]).groupBy("query_id").agg(F.min_by("__c", "__k").alias("__c"))
    return requests.join(best, "query_id", "left").withColumns({c: F.coalesce(F.col(f"__c.{c}"), F.lit(v)) for c, v in DEFAULTS.items()}).drop("__c")


def _seen(memory: str, agent: Column, include_proposed: Column) -> Column:
    m = lambda c: F.col(f"{memory}{c}")
    shared = (m("visibility") == "shared") & ((m("status") == "approved") | (include_proposed & (m("status") == "proposed")))
    return shared | ((m("visibility") == "private") & (m("status") == "approved") & (m("owner") == agent))


def visible(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, uuid) of every memory that each request may see, of its namespaces and types; requests carry
    include_proposed (see effective_config)."""
    slim = memories.select("uuid", F.col("namespace").alias("__n"), F.col("type").alias("__t"), "visibility", "status", F.col("agent_id").alias("owner"), "created_at")
    asked = requests.withColumn("__n", F.explode("namespaces"))
    types = F.col("types") if "types" in requests.columns else F.lit(None).cast("array<string>")
    asked = asked.withColumn("__types", types)
    rows = slim.join(asked, "__n").filter(_seen("", F.col("agent_id"), F.col("include_proposed")) & (F.coalesce(F.size("__types"), F.lit(0)).isin(0, -1) | F.array_contains("__types", F.col("__t"))))
    return rows.select(*requests.columns, "uuid", "created_at")


def _few(values: DataFrame) -> list | None:
    """The different values of a one-column table, unless they are more than a task should be told."""
    found = [r[0] for r in values.distinct().limit(FEW + 1).collect()]
    return found if len(found) <= FEW else None


def _repeats(memories: DataFrame) -> bool:
    return not memories.groupBy("namespace", "uuid").count().filter("count > 1").isEmpty()


def build_index(memories: DataFrame, config: str = "simple", terms: DataFrame | None = None) -> DataFrame:
    """namespace, lexeme, uuid, positions: an inverted index, made from the memories alone; of the lexemes of terms only, if
    they are given (a batch of queries against memories that have no index yet).

    A memory's words are grouped where it is read, and nothing is shuffled. Only if a uuid is met twice in a namespace, which is
    looked up first, are the places of such memories merged."""
    wanted = None if terms is None else _few(terms.select("lexeme"))
    rows = postings(word_blocks(memories, "content", config, wanted=wanted))
    if terms is not None and wanted is None:
        rows = rows.join(terms.select("lexeme").distinct(), "lexeme", "left_semi").select("namespace", "lexeme", "uuid", "positions")
    if not _repeats(memories):
        return rows
    return rows.groupBy("namespace", "lexeme", "uuid").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def build_blocks(memories: DataFrame, config: str = "simple", packed: bool = False) -> DataFrame:
    """build_index in blocks (namespace, lexeme, ids, places; see word_blocks): many documents' postings of a lexeme in a row;
    packed: as an index stores them (index_store.pack)."""
    if not _repeats(memories):
        return word_blocks(memories, "content", config, packed=packed)
    rows = index_store.blocks(build_index(memories, config))
    return index_store.pack(rows) if packed else rows


def index_statistics(blocks: DataFrame) -> DataFrame:
    """namespace, lexeme, n_memories, n_places of an index in blocks, packed ones too."""
    if "n_ids" in blocks.columns:
        return blocks.groupBy("namespace", "lexeme").agg(F.sum("n_ids").alias("n_memories"), F.sum("n_places").alias("n_places"))
    n = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    return blocks.groupBy("namespace", "lexeme").agg(F.sum(F.size("ids")).cast("long").alias("n_memories"), F.sum(n).alias("n_places"))


def parse_websearch(queries: DataFrame, config: str = "simple") -> DataFrame:
    """query_id, grp, alt, negated, lexeme, phrase_pos, phrase_len: all of a query's groups have to hold (none that is
    negated), a group if one of its alternatives does. Words are AND, `or` joins two neighbours, "…" is a phrase, - negates."""
    parts = F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    tokens = queries.select("query_id", F.posexplode(parts).alias("alt", "token"))
    order = Window.partitionBy("query_id").orderBy("alt")
    is_or = F.lower("token") == "or"
    joined = F.coalesce(F.lag(is_or).over(order), F.lit(False)) & (F.col("alt") > 1)
    tokens = tokens.withColumn("__new", F.when(is_or | joined, 0).otherwise(1)).withColumn("grp", F.sum("__new").over(order)).filter(~is_or)
    tokens = tokens.withColumn("negated", F.col("token").startswith("-"))
    words = lexemes(F.col("token"))
    rows = tokens.select("query_id", "grp", "alt", "negated", F.posexplode(words).alias("phrase_pos", "lexeme"))
    if config != "simple":
        rows = english(rows)
    return rows.withColumn("phrase_len", F.count("*").over(Window.partitionBy("query_id", "alt")))


def fts_match(terms: DataFrame, index: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """With spaces (query_id, namespace), only postings of a query's own namespaces are met. query_id, namespace, uuid, frequency (occurrences of wanted alternatives) and places (array of (pos, grp)) of the
    documents that satisfy each query; a query of negations alone matches nothing.

    Postings are shuffled once, whole, to their query and document, and judged there."""
    wanted = F.size(F.collect_set(F.when(~F.col("negated"), F.col("grp"))).over(Window.partitionBy("query_id")))
    asked = terms.withColumn("__wanted", wanted).filter("__wanted > 0")
    hits = index.join(asked, "lexeme") if spaces is None else index.join(asked.join(spaces, "query_id"), ["namespace", "lexeme"])
    entry = F.struct("grp", "alt", "negated", "phrase_pos", "phrase_len", "positions")
    found = hits.groupBy("query_id", "namespace", "uuid", "__wanted").agg(F.collect_list(entry).alias("__all"))

    def starts(head: Column) -> Column:
        """Where a phrase begins: each later word stands as far behind its first."""
        follows = lambda p: F.forall(F.sequence(F.lit(1), head["phrase_len"].cast("int") - 1), lambda k: F.exists("__all", lambda x: (x["alt"] == head["alt"]) & (x["phrase_pos"] == k) & F.array_contains(x["positions"], p + k)))
        return F.when(head["phrase_len"] == 1, F.array_distinct(head["positions"])).otherwise(F.filter(F.array_distinct(head["positions"]), follows))

    heads = F.transform(F.filter("__all", lambda x: x["phrase_pos"] == 0), lambda x: F.struct(x["grp"].alias("grp"), x["negated"].alias("negated"), starts(x).alias("at")))
    met = found.select("query_id", "namespace", "uuid", "__wanted", F.filter(heads, lambda x: F.size(x["at"]) > 0).alias("__met"))
    met = met.filter(~F.exists("__met", lambda x: x["negated"]) & (F.size(F.array_distinct(F.transform("__met", lambda x: x["grp"]))) == F.col("__wanted")))
    frequency = F.aggregate("__met", F.lit(0).cast("long"), lambda n, x: n + F.size(x["at"]))
    places = F.sort_array(F.flatten(F.transform("__met", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("pos"), x["grp"].alias("grp"))))))
    return met.select("query_id", "namespace", "uuid", frequency.alias("frequency"), places.alias("places"))


def fts_rank(matches: DataFrame, rank: str = "density") -> DataFrame:
    """matches with score: `frequency`, or cover density (each minimal stretch that holds all of a query's groups adds
    0.1 / (1 + places in it that are none of the query's))."""
    if rank == "frequency":
        return matches.withColumn("score", F.col("frequency").cast("double"))

    kind = T.StructType([*matches.schema.fields, T.StructField("score", T.DoubleType())])
    return matches.mapInArrow(_covers, kind).withColumn("score", F.round("score", 9))


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's sum over its minimal stretches. A place ends one if all of the row's groups were met and the newest
    places of each begin later than at the place before."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("places"))
        n = np.diff(lists.offsets.to_numpy().astype(np.int64))
        flat = lists.flatten()
        pos, grp = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        row, begin, i = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n), np.arange(len(pos))
        first = i.copy()
        for g in np.unique(grp):
            own = np.zeros(len(n), bool)
            own[row[grp == g]] = True
            last = np.maximum.accumulate(np.where(grp == g, i, -1))
            first = np.where(own[row], np.minimum(first, np.where(last >= begin, last, -1)), first)
        ends = np.flatnonzero((first >= 0) & np.append(True, (first[1:] != first[:-1]) | (row[1:] != row[:-1]))[: len(first)])
        at = first[ends]
        gain = 0.1 / (1 + np.maximum(0, pos[ends] - pos[at] - (ends - at)))
        score = np.bincount(row[ends], gain, len(n)).astype(float)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])


def fts_lane(requests: DataFrame, memories: DataFrame, index: DataFrame, config: str = "simple", rank: str = "density", terms: DataFrame | None = None) -> DataFrame:
    """query_id, uuid, rank, score of the best `lane_rows` memories that each request may see and that satisfy its query.
    terms: what parse_websearch makes of the requests, if that is at hand."""
    asked = requests.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    terms = parse_websearch(asked.select("query_id", "query"), config) if terms is None else terms.join(asked.select("query_id"), "query_id", "left_semi")
    spaces = asked.select("query_id", F.explode(F.array_distinct("namespaces")).alias("namespace"))
    scored = fts_rank(fts_match(terms, index, spaces), rank).select("query_id", "uuid", "score")
    # what was found is looked at, not all that may be seen
    slim = memories.select("uuid", F.col("namespace").alias("__n"), F.col("type").alias("__t"), "visibility", "status", F.col("agent_id").alias("owner"), "created_at")
    who = asked.select("query_id", "agent_id", "namespaces", (F.col("types") if "types" in asked.columns else F.lit(None).cast("array<string>")).alias("__types"), "include_proposed", "lane_rows")
    seen = scored.join(slim, "uuid").join(who, "query_id").filter(_seen("", F.col("agent_id"), F.col("include_proposed")) & F.array_contains("namespaces", F.col("__n")))
    return _top(seen.filter((F.coalesce(F.size("__types"), F.lit(0)) <= 0) | F.array_contains("__types", F.col("__t"))), asked)


def recency(created: Column, as_of: float, half_life_h: Column) -> Column:
    """Half after half_life_h hours, a quarter after twice that."""
    return F.exp(F.lit(-math.log(2)) * ((F.lit(float(as_of)) - created.cast("double")) / 3600.0) / half_life_h)


def recency_lists(memories: DataFrame, depth: int, by_type: bool = True) -> DataFrame:
    """namespace, list (`shared`, `proposed` or `own`), owner (of own ones), type (null: of all types), uuid, created_at: the
    newest `depth` memories of each list that a request can be given whole. A memory is in one list, and once more by its
    type; tasks cut their rows to the depth before any are shuffled."""
    kind = F.when((F.col("visibility") == "shared") & (F.col("status") == "approved"), "shared").when((F.col("visibility") == "shared") & (F.col("status") == "proposed"), "proposed").when((F.col("visibility") == "private") & (F.col("status") == "approved"), "own")
    rows = memories.withColumn("list", kind).filter("list is not null").select("namespace", "list", F.when(F.col("list") == "own", F.col("agent_id")).alias("owner"), F.col("type").cast("string").alias("type"), "uuid", "created_at")
    every = F.array(F.struct(F.lit(False).alias("__typed"), F.lit(None).cast("string").alias("type")), *([F.struct(F.lit(True).alias("__typed"), F.col("type").alias("type"))] if by_type else []))
    rows = rows.withColumn("__to", F.explode(every)).drop("type").select("*", "__to.*").drop("__to").filter("not __typed or type is not null").filter("list <> 'own' or owner is not null")
    order = Window.partitionBy("namespace", "list", "owner", "type").orderBy(F.desc("created_at"), "uuid")
    return rows.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= int(depth)).drop("__place", "__typed")


def recency_lane(requests: DataFrame, memories: DataFrame, as_of: float) -> DataFrame:
    """query_id, uuid, rank, score by age: a merge of the few lists that a request may see (see recency_lists), each cut to the
    deepest lane. A rank depends on who asks where, not on the query, so each combination of agent, namespaces, types and
    proposed is merged once; what is merged grows with lists and depth, not with memories."""
    typed = "types" in requests.columns
    scope = ["agent_id", "namespaces", *(["types"] if typed else []), "include_proposed"]
    named = F.sha2(F.to_json(F.struct(*scope)), 256)  # a hash of the columns alone would run neighbouring arrays together
    scopes = requests.withColumn("__scope", named).groupBy("__scope").agg(F.max("lane_rows").alias("lane_rows"), *(F.first(c).alias(c) for c in scope))
    scopes = staged(scopes.withColumnRenamed("__scope", "query_id"), "scopes")
    lists = recency_lists(memories, scopes.agg(F.max("lane_rows")).first()[0] or 0, typed)
    none = F.lit(None).cast("string")
    kinds = F.array(F.struct(F.lit("shared").alias("list"), none.alias("owner")), F.struct(F.lit("own").alias("list"), F.col("agent_id").alias("owner")), F.when(F.col("include_proposed"), F.struct(F.lit("proposed").alias("list"), none.alias("owner"))))
    of = F.when(F.coalesce(F.size("types"), F.lit(0)) > 0, F.array_distinct("types")).otherwise(F.array(none)) if typed else F.array(none)
    asked = scopes.select("query_id", "lane_rows", F.explode(F.array_distinct("namespaces")).alias("__n"), kinds.alias("__kinds"), of.alias("__of")).withColumn("__kind", F.explode(F.filter("__kinds", lambda k: k.isNotNull()))).withColumn("__type", F.explode("__of"))
    same = [F.col("namespace") == F.col("__n"), F.col("list") == F.col("__kind.list"), F.col("owner").eqNullSafe(F.col("__kind.owner")), F.col("type").eqNullSafe(F.col("__type"))]
    seen = asked.join(lists, same).select("query_id", "lane_rows", "uuid", "created_at", F.col("created_at").cast("double").alias("score"))
    ranked = _top(seen, scopes, "created_at").withColumnRenamed("query_id", "__scope").drop("score")
    rows = requests.withColumn("__scope", named).join(ranked, "__scope").filter(F.col("rank") <= F.col("lane_rows"))
    return rows.select("query_id", "uuid", "rank", recency(F.col("created_at"), as_of, F.col("recency_half_life_h").cast("double")).alias("score"))


def _top(scored: DataFrame, requests: DataFrame, *keep: str) -> DataFrame:
    """The best lane_rows of each request. The largest of these is a literal bound, by which tasks cut their own rows before
    any are shuffled."""
    most = requests.agg(F.max("lane_rows")).first()[0] or 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), "uuid")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= int(most)).filter(F.col("rank") <= F.col("lane_rows")).select("query_id", "uuid", "rank", "score", *keep)


def rrf_fuse(lanes: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """query_id, uuid, fused_score = sum of 1 / (k + rank) over any number of lanes, and each lane's rank and score."""
    union = None
    for name, lane in sorted(lanes.items()):
        rows = lane.select("query_id", "uuid", F.lit(name).alias("lane"), "rank", "score")
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy("query_id", "uuid").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused_score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lane", F.struct("rank", "score"))))).alias("lanes"))


def search(requests: DataFrame, memories: DataFrame, config: DataFrame, as_of: float, index: DataFrame | str | None = None, text_config: str = "simple", rank: str = "density") -> DataFrame:
    """query_id, place, uuid, fused_score, lanes, preview and the memory's columns, best first.

    A blank query is ranked by recency alone; unknown lane names are ignored, no lane means all. At most max_rows and the
    configuration's max_results come back; lanes are five times as deep. as_of is in seconds. index: postings of build_index, the
    folder of a stored index (sources.index_store), of which the queries' buckets are read, or none, to index what is asked for.
    """
    asked = effective_config(requests, config)
    limit = F.least(F.coalesce(F.col("max_rows"), F.col("max_results")), F.col("max_results")) if "max_rows" in asked.columns else F.col("max_results")
    # written once: every lane joins it, and Spark broadcasts it by its size if that is small
    asked = staged(asked.withColumn("take", limit).withColumn("lane_rows", F.col("take") * 5), "requests")
    terms = staged(parse_websearch(asked.select("query_id", "query"), text_config), "terms")
    if "lanes" in asked.columns:
        wanted = F.array_intersect("lanes", F.array(*map(F.lit, LANES)))
        asked = asked.withColumn("lanes", F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(F.array(*map(F.lit, LANES))))
        by = {x: asked.filter(F.array_contains("lanes", x) | (F.lit(x == "recency") & (F.trim(F.coalesce("query", F.lit(""))) == ""))).drop("lanes") for x in LANES}
    else:
        by = dict.fromkeys(LANES, asked)
    if isinstance(index, str):
        kind = memories.schema["uuid"].dataType
        index = open_index(memories.sparkSession, index, terms, asked.select("query_id", F.explode(F.array_distinct("namespaces")).alias("namespace"))).withColumn("uuid", F.col("uuid").cast(kind))
    if index is None:
        # a join by namespace would bring all texts of a namespace to one task
        named = asked.select(F.explode("namespaces").alias("namespace"))
        few = _few(named)
        own = memories.join(F.broadcast(named.distinct()), "namespace", "left_semi") if few is None else memories.filter(F.col("namespace").isin([x for x in few if x is not None]))
        index = build_index(own, text_config, terms)
    fused = rrf_fuse({"fts": fts_lane(by["fts"], memories, index, text_config, rank, terms), "recency": recency_lane(by["recency"], memories, as_of)})
    fused = fused.join(asked.select("query_id", "take", "preview_chars"), "query_id").join(memories.select("uuid", "created_at"), "uuid")
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.desc("created_at"), "uuid")
    cut = fused.withColumn("place", F.row_number().over(order)).filter("place <= take").drop("created_at", "take")
    full = cut.join(memories, "uuid")
    return full.withColumn("preview", preview(F.col("content"), F.col("preview_chars"))).drop("content", "preview_chars")


def superseders(memories: DataFrame) -> DataFrame:
    """uuid and superseded_by: the newest memory that supersedes it."""
    return memories.filter("supersedes is not null").groupBy(F.col("supersedes").alias("uuid")).agg(F.max_by("uuid", F.struct("created_at", "uuid")).alias("superseded_by"))


def lookup(requests: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, errors): whole records of any status by (agent_id, namespaces, uuid) if shared or the agent's own and of an
    allowed namespace, with their newest superseder."""
    asked = requests.select("request_id", F.col("agent_id").alias("__agent"), "namespaces", "uuid")
    rows = asked.join(memories, "uuid", "left").withColumn("__ok", (F.col("namespace").isNotNull()) & F.array_contains("namespaces", F.col("namespace")) & ((F.col("visibility") == "shared") | (F.col("agent_id") == F.col("__agent"))))
    ok = F.coalesce("__ok", F.lit(False))
    found = rows.filter(ok).drop("__ok", "__agent", "namespaces").join(superseders(memories), "uuid", "left")
    return found, rows.filter(~ok).select("request_id", "uuid", F.lit("not_found").alias("error"))


def lookup_traces(requests: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, errors): traces by (request_id, namespaces, trace_uuid) of an allowed namespace."""
    rows = requests.join(traces, "trace_uuid", "left").withColumn("__ok", F.coalesce(F.array_contains("namespaces", F.col("namespace")), F.lit(False)))
    return rows.filter("__ok").drop("__ok", "namespaces"), rows.filter("not __ok").select("request_id", "trace_uuid", F.lit("not_found").alias("error"))


def access_log(requests: DataFrame, kind: str) -> DataFrame:
    """A trace row for each access: `search` is a tool_call, `memory` a memory_consumed and `trace` a trace_consumed, with the
    item as its ref and in the item's own namespace. requests: session_id, agent_id, namespace, ref, ts."""
    event = {"search": "tool_call", "memory": "memory_consumed", "trace": "trace_consumed"}[kind]
    refs = F.when(F.col("ref").isNotNull(), F.array(F.col("ref").cast("string"))).otherwise(F.array().cast("array<string>"))
    return requests.select("session_id", "agent_id", "namespace", F.lit(event).alias("event_type"), refs.alias("refs"), "ts")
