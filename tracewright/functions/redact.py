"""Secrets in text: where they are, which rule names them, and the text without them.

Columns of spans come from built-in functions alone: regexp_replace puts private-use marks around each match, splitting at
the marks gives the lengths between, and a fold adds them up. Marks that a text has itself are first turned into another
character of the same length, so that places stay right. Whole tables (redact_text, decode_pass, reject_unsafe) are scanned
as Arrow columns (scan.py), which passes over clean texts far faster than any pattern of the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import DEFAULT, LITERAL_ID, LITERAL_PRIORITY, Rule, RuleSet
from .scan import Budgets, Exhausted, Scanner, without_spans

_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ufffd"
SPAN = "struct<rule_id:string,category:string,priority:int,start:int,end:int>"


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def prefilter(text: Column, rule: Rule) -> Column:
    """Whether any of a rule's literals occurs, in any case; it never changes what a rule finds."""
    low = F.lower(text)
    found = F.lit(False)
    for stem in rule.prefilter:
        found |= low.contains(stem.lower())
    return F.coalesce(found, F.lit(False))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the matches of a pattern, in code points from 0."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER), F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    parts = F.split(marked, _OPEN)
    start = F.struct(F.char_length(F.get(parts, F.lit(0))).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.instr(x, _CLOSE) - 1
        return F.struct((a["at"] + F.char_length(x) - 1).alias("at"), F.array_append(a["found"], F.struct(a["at"].alias("start"), end.alias("end"))).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda a: a["found"])


def _as_spans(found: Column, rule_id: str, category: str, priority: int) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), F.lit(priority).alias("priority"), s["start"].alias("start"), s["end"].alias("end")))


def rule_matches(text: Column, rules: RuleSet = DEFAULT) -> Column:
    """All matches of all text rules and literals."""
    found = [F.when(prefilter(text, r), _as_spans(places(text, r.pattern), r.id, r.category, r.priority)).otherwise(_empty()) for r in rules.text_rules()]
    return F.concat(literal_matches(text, rules), *found)


def literal_matches(text: Column, rules: RuleSet) -> Column:
    """Matches of operator-given values, longest first, in the order of the text, as a column: the plan holds every value. For
    many values use literal_spans."""
    if not rules.literals:
        return _empty()
    pattern = "|".join(f"\\Q{x}\\E" if "\\E" not in x else re.escape(x) for x in rules.literals)
    hit = F.lit(False)
    for x in rules.literals:
        hit |= text.contains(x)
    return F.when(hit, _as_spans(places(text, pattern), LITERAL_ID, "configured_credential", LITERAL_PRIORITY)).otherwise(_empty())


def literal_spans(df: DataFrame, text: str, rules: RuleSet, budgets: Budgets = Budgets()) -> DataFrame:
    """df with `literal_spans`, what literal_matches finds, for any number of values: one pass of an automaton over the texts,
    and a plan of one size. A text that passes a budget has null spans."""
    found = scanned(df, [text], rules._replace(rules=()), False, budgets)
    f = F.col("__found_0")
    return found.withColumn("literal_spans", F.when(f.isNull() | f["failure"].isNull(), F.coalesce(f["spans"], _empty()))).drop("__found_0")


_SPANS = pa.list_(pa.struct([("rule_id", pa.string()), ("category", pa.string()), ("priority", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.struct([("redacted", pa.string()), ("spans", _SPANS), ("omission", pa.string()), ("failure", pa.string()), ("skipped_runs", pa.int32())])
FOUND = f"struct<redacted:string,spans:array<{SPAN}>,omission:string,failure:string,skipped_runs:int>"


def _scan(col: pa.Array, s: Scanner, only_encoded: bool) -> pa.Array:
    """What is found in a column of texts: null for a text in which nothing is, and nothing was skipped."""
    plain, runs = s.may(col)
    if only_encoded:
        plain = np.zeros(len(col), bool)
    over = pc.fill_null(pc.greater(pc.binary_length(col), s.budgets.leaf_bytes), False).to_numpy(zero_copy_only=False)
    found: list[dict | None] = [None] * len(col)
    for k in np.flatnonzero(over).tolist():
        found[k] = {"redacted": "[OMITTED:leaf_exceeds_limit]", "spans": [], "omission": "leaf_exceeds_limit", "failure": None, "skipped_runs": 0}
    for k in np.flatnonzero((plain | runs) & ~over).tolist():
        text = col[k].as_py()
        try:
            spans, skipped = s.spans(text, bool(plain[k]), bool(runs[k]))
        except Exhausted:
            found[k] = {"redacted": None, "spans": [], "omission": None, "failure": "scan_budget_exhausted", "skipped_runs": 0}
            continue
        if spans or skipped:
            rows = [{"rule_id": i, "category": c, "priority": -p, "start": a, "end": b} for a, b, p, _, i, c in spans]
            found[k] = {"redacted": without_spans(text, spans), "spans": rows, "omission": None, "failure": None, "skipped_runs": skipped}
    return pa.array(found, _FOUND)


def scanned(df: DataFrame, columns: list[str], rules: RuleSet = DEFAULT, decode: bool = True, budgets: Budgets = Budgets(), only_encoded: bool = False) -> DataFrame:
    """df with `__found_<k>` for its k-th column of texts: struct<redacted, merged spans, omission, failure, skipped_runs>, or
    null where nothing is found. Nothing is shuffled."""
    names = [f"__found_{k}" for k in range(len(columns))]
    at = [df.columns.index(c) for c in columns]
    kind = T._parse_datatype_string(FOUND)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, kind) for n in names)])
    fields = schema.names

    def run(batches):
        s = Scanner(rules, decode, budgets)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_scan(batch.column(k), s, only_encoded) for k in at)], names=fields)

    return df.mapInArrow(run, schema)


def decode_pass(df: DataFrame, text: str, rules: RuleSet = DEFAULT, budgets: Budgets = Budgets()) -> DataFrame:
    """df with `encoded`: spans of encoded runs whose decoded text, one level deep and split at control characters, holds a
    match; named by its rule of highest priority. Runs over budgets.run_length are not decoded."""
    found = scanned(df, [text], rules, True, budgets, True)
    return found.withColumn("encoded", F.coalesce("__found_0.spans", _empty())).drop("__found_0")


def merge_spans(spans: Column) -> Column:
    """Overlapping spans as one, named by the span of highest priority, then greatest length, then least rule id."""
    wide = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("l"), s["rule_id"].alias("rule_id"), s["category"].alias("category")))
    kind = "array<struct<start:int,end:int,p:int,l:int,rule_id:string,category:string>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        name = lambda x: F.struct(x["p"].alias("p"), x["l"].alias("l"), x["rule_id"].alias("rule_id"), x["category"].alias("category"))
        best = F.least(name(last), name(s))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), best["p"].alias("p"), best["l"].alias("l"), best["rule_id"].alias("rule_id"), best["category"].alias("category"))
        return F.when((F.size(done) > 0) & (s["start"] < F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), both)).otherwise(F.array_append(done, s))

    merged = F.when(F.size(wide) <= 1, wide).otherwise(F.aggregate(F.array_sort(wide), F.array().cast(kind), step))
    return F.transform(merged, lambda s: F.struct(s["rule_id"].alias("rule_id"), s["category"].alias("category"), (-s["p"]).alias("priority"), s["start"].alias("start"), s["end"].alias("end")))


def cut(text: Column, spans: Column) -> Column:
    """text with every one of its merged spans replaced by `[REDACTED:<rule>]`."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[REDACTED:"), s["rule_id"], F.lit("]")).alias("out"))
    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def scan_receipt(spans: Column, omissions: Column | None = None) -> Column:
    """struct<status, rule_ids, categories, redaction_count> of merged spans; omissions are names of reasons, and win."""
    omitted = F.coalesce(omissions, F.array().cast("array<string>")) if omissions is not None else F.array().cast("array<string>")
    ids = F.array_sort(F.array_distinct(F.concat(F.transform(spans, lambda s: s["rule_id"]), F.transform(omitted, lambda o: F.concat(F.lit("omission:"), o)))))
    status = F.when(F.size(omitted) > 0, "omitted").when(F.size(spans) > 0, "redacted").otherwise("clean")
    return F.struct(status.alias("status"), ids.alias("rule_ids"), F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["category"]))).alias("categories"), F.size(spans).alias("redaction_count"))


def redact_text(df: DataFrame, text: str, rules: RuleSet = DEFAULT, decode: bool = True, leaf_limit: int = 64 << 20, budgets: Budgets = Budgets()) -> DataFrame:
    """df with `redacted`, `scan` (see scan_receipt) and `skipped_runs` (encoded runs too long to be decoded).

    A text of more than leaf_limit bytes becomes an omission marker. A text that passes a budget of matches, runs or decoded
    bytes fails closed: redacted is null, the status `failed` and the rule id `failure:scan_budget_exhausted`. A null text
    stays null and is clean. Columns of df with these names are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("redacted", "scan", "skipped_runs") and c != text])
    found = scanned(df, [text], rules, decode, budgets._replace(leaf_bytes=leaf_limit))
    f = F.col("__found_0")
    receipt = scan_receipt(F.coalesce(f["spans"], _empty()), F.when(f["omission"].isNotNull(), F.array(f["omission"])))
    failed = F.struct(F.lit("failed").alias("status"), F.array(F.concat(F.lit("failure:"), f["failure"])).alias("rule_ids"), F.array().cast("array<string>").alias("categories"), F.lit(0).alias("redaction_count"))
    return found.withColumns({"redacted": F.when(f.isNull(), F.col(text)).otherwise(f["redacted"]), "scan": F.when(f["failure"].isNotNull(), failed).otherwise(receipt), "skipped_runs": F.coalesce(f["skipped_runs"], F.lit(0))}).drop("__found_0")


def in_place(df: DataFrame, columns: list[str], rules: RuleSet = DEFAULT, budgets: Budgets = Budgets()) -> DataFrame:
    """df whose text columns are redacted where they are; a text that passes a budget becomes an omission marker."""
    found = scanned(df, columns, rules, True, budgets)
    new = {c: F.when(f.isNull(), F.col(c)).otherwise(F.coalesce(f["redacted"], F.concat(F.lit("[OMITTED:"), f["failure"], F.lit("]")))) for c, f in ((c, F.col(f"__found_{k}")) for k, c in enumerate(columns))}
    return found.withColumns(new).select(*df.columns)


def reject_unsafe(df: DataFrame, columns: list[str], rules: RuleSet = DEFAULT, limit: int = 64 << 20, budgets: Budgets = Budgets()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with rule_id and path): a row with any match is rejected by its rule of highest priority, one that
    passes a budget by `scan_budget_exhausted` and one that can't be inspected in whole by `required_inspection_incomplete`."""
    found = scanned(df, columns, rules, True, budgets._replace(leaf_bytes=limit))
    each = [F.col(f"__found_{k}") for k in range(len(columns))]
    some = lambda name: F.coalesce(*(x[name] for x in each))
    tag = lambda c: lambda s: F.struct((-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("l"), s["rule_id"].alias("rule_id"), F.lit(c).alias("path"))
    tagged = F.concat(*(F.transform(F.coalesce(x["spans"], _empty()), tag(c)) for x, c in zip(each, columns, strict=True)))
    found = found.withColumn("__first", F.try_element_at(F.array_sort(tagged), F.lit(1)))
    why = F.when(some("omission").isNotNull(), "required_inspection_incomplete").otherwise(F.coalesce(some("failure"), F.col("__first.rule_id")))
    path = F.when(some("omission").isNull() & some("failure").isNull(), F.col("__first.path"))
    found = found.withColumns({"rule_id": why, "path": path})
    return found.filter("rule_id is null").select(*df.columns), found.filter("rule_id is not null").select(*df.columns, "rule_id", "path")


def blocked_write_notes(rejected: DataFrame, agent: str = "agent_id", session: str = "session_id", namespace: str = "namespace", ts: str = "ts") -> DataFrame:
    """A note for each rejected write, which names the rule and the field and holds nothing of the text."""
    content = F.to_json(F.struct(F.lit("blocked_write").alias("kind"), F.col("rule_id").alias("rule"), F.col("path").alias("path")))
    return rejected.select(F.col(session).alias("session_id"), F.col(agent).alias("agent_id"), F.col(namespace).alias("namespace"), F.lit("note").alias("event_type"), content.alias("content"), F.array().cast("array<string>").alias("refs"), F.col(ts).alias("ts"))


def scan_budgets(spans: Column, candidates: Column, matches: int = Budgets().matches, runs: int = Budgets().runs) -> Column:
    """`scan_budget_exhausted` for a row with more matches or encoded runs than allowed, else null: the bounds that
    redact_text, redact_json and reject_unsafe keep, for spans found otherwise."""
    return F.when((F.size(spans) > matches) | (F.size(candidates) > runs), "scan_budget_exhausted")


def redaction_report(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """How many rows each rule concerned, from the scan column of redact_text."""
    return df.select(*by, F.explode("scan.rule_ids").alias("rule_id")).groupBy(*by, "rule_id").agg(F.count("*").alias("n"))
