"""Secrets in nested JSON, whose depth built-in expressions can't follow: the one redaction that rewrites rows in Python.

Only rows that a literal of a rule, a sensitive name or an encoded run can concern are parsed, each different text of an Arrow
batch once. Of their strings, one pass of the scanner's gates over all of a batch says which are looked at one by one.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_json import Pairs, dumps, loads
from .redact import prefilter
from .rules import DEFAULT, RuleSet
from .scan import ENCODED, MANY_LITERALS, Budgets, Exhausted, Scanner, without_spans

LEAF_LIMIT = 64 << 20
#: Halves of surrogate pairs, which JSON can spell and UTF-8 can't.
_HALVES = re.compile("[\ud800-\udfff]")
_SCAN = "status:string,rule_ids:array<string>,categories:array<string>,redaction_count:int"


def _strings(v, out: list[str]) -> None:
    if isinstance(v, str):
        out.append(v)
    elif isinstance(v, Pairs):
        for k, x in v:
            out.append(k)
            _strings(x, out)
    elif isinstance(v, list):
        for x in v:
            _strings(x, out)


class _Batch:
    """What the strings of a batch's documents hold, each different one told once."""

    def __init__(self, rules: RuleSet, scanner: Scanner):
        self.scanner = scanner
        self.rules = [(r.id, r.category, r.priority, re.compile(r.pattern)) for r in rules.field_rules()]
        self.names: dict[str | None, tuple | None] = {None: None}
        self.known: dict[str, list[tuple]] = {}
        self.gates: dict[str, tuple[bool, bool]] = {}

    def take(self, texts: list[str]) -> list:
        """The texts' values; None stands for a text that isn't JSON."""
        self.names, self.known, self.gates = {None: None}, {}, {}
        out, strings = [], []
        for t in texts:
            try:
                v = (loads(t),)
                _strings(v[0], strings)
            except (ValueError, RecursionError):
                v = None
                strings.append(t)
            out.append(v)
        strings = list(dict.fromkeys(strings))
        try:
            col = pa.array(strings, pa.large_string())
        except UnicodeEncodeError:  # half a surrogate pair is no UTF-8, and looked at in any case
            strings = [s for s in strings if not _HALVES.search(s)]
            col = pa.array(strings, pa.large_string())
        self.gates = dict(zip(strings, zip(*(x.tolist() for x in self.scanner.may(col)), strict=True), strict=True))
        return out

    def spans(self, text: str) -> list[tuple]:
        matched, encoded = self.gates.get(text, (True, True))
        if not matched and not encoded:
            return []
        if text not in self.known:
            self.known[text] = self.scanner.spans(text, matched, encoded)[0]
        return self.known[text]

    def field(self, name: str | None) -> tuple | None:
        if name not in self.names:
            self.names[name] = next(((i, c, p) for i, c, p, rx in self.rules if rx.search(name)), None)
        return self.names[name]


class _Scan:
    """One document's scan; its budget of matches holds for the whole document."""

    def __init__(self, batch: _Batch):
        self.scanner, self.batch = batch.scanner, batch
        self.found: list[tuple[str, str]] = []
        self.omitted: list[str] = []

    def spans(self, text: str) -> list[tuple]:
        """Merged spans: (start, end, -priority, -length, rule, category)."""
        spans = self.batch.spans(text)
        if len(spans) + len(self.found) > self.scanner.budgets.matches:
            raise Exhausted
        return spans

    def string(self, text: str) -> str:
        if len(text.encode("utf-8", "surrogatepass")) > LEAF_LIMIT:
            self.omitted.append("leaf_exceeds_limit")
            return "[OMITTED:leaf_exceeds_limit]"
        spans = self.spans(text)
        self.found += [(rule, category) for *_, rule, category in spans]
        return without_spans(text, spans)

    def value(self, v, name: str | None = None):
        field = self.batch.field(name)
        if field and v is not None:
            if isinstance(v, str):
                if any(-s[2] > field[2] for s in self.spans(v)):
                    return self.string(v)
                self.found.append(field[:2])
                return f"[REDACTED:{field[0]}]"
            reason = "sensitive_field_subtree" if isinstance(v, list) else "sensitive_field_scalar"
            self.omitted.append(reason)
            return f"[OMITTED:{reason}]"
        if isinstance(v, str):
            return self.string(v)
        if isinstance(v, Pairs):
            names = [(k, self.string(k)) for k, _ in v]
            changed = {b for a, b in names if a != b}
            if any(len({a for a, b in names if b == c}) > 1 for c in changed):
                self.omitted.append("redacted_name_collision")
                return "[OMITTED:redacted_name_collision]"
            return Pairs((b, self.value(x, a)) for (a, b), (_, x) in zip(names, v, strict=True))
        return [self.value(x, name) for x in v] if isinstance(v, list) else v


def _may(text: Column, of, rules: RuleSet) -> Column:
    """Whether any of the given rules, a literal or an encoded run can concern a text."""
    may = F.lit(False)
    for r in of:
        may |= prefilter(text, r)
    if len(rules.literals) > MANY_LITERALS:  # an automaton tells, not the plan
        return text.isNotNull()
    for x in rules.literals:
        may |= text.contains(x)
    for p in ENCODED.values():
        may |= text.rlike(p)
    return F.coalesce(may, F.lit(False))


def redact_json(df: DataFrame, column: str, rules: RuleSet = DEFAULT, budgets: Budgets = Budgets()) -> DataFrame:
    """df with `redacted` and `scan` (as of redact_text) for a column of JSON texts of any depth.

    Strings are redacted as text. Under a sensitive name a string is redacted as a whole, unless a rule of higher priority
    names it; numbers and truth values, objects and arrays are omitted, null stays. Arrays pass their name on. Names are
    redacted too: if that makes two of an object's names equal, the object is omitted. Text that isn't JSON is redacted as
    text; null stays null. Numbers, repeated names and all else stay as they are spelt. A document that passes a budget fails as in
    redact_text.
    """
    may = F.coalesce(_may(F.col(column), rules.rules, rules) | F.col(column).contains("\\") | (F.octet_length(column) > LEAF_LIMIT), F.lit(False))

    @F.arrow_udf(f"struct<redacted:string,{_SCAN}>")
    def scan(texts: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(texts)
        whole = coded.dictionary.to_pylist()
        batch = _Batch(rules, Scanner(rules, True, budgets))
        out = []
        for t, v in zip(whole, batch.take(whole), strict=True):
            s = _Scan(batch)
            try:
                try:
                    new = _HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", dumps(s.value(v[0]))) if v else s.string(t)
                except (ValueError, RecursionError):
                    s = _Scan(batch)
                    new = s.string(t)
            except Exhausted:
                out.append((None, "failed", ["failure:scan_budget_exhausted"], [], 0))
                continue
            ids = sorted({i for i, _ in s.found} | {f"omission:{o}" for o in s.omitted})
            out.append((new if ids else t, "omitted" if s.omitted else "redacted" if s.found else "clean", ids, sorted({c for _, c in s.found}), len(s.found)))
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32())
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
        at = coded.indices
        return pa.StructArray.from_arrays([c.take(at) for c in columns], names=["redacted", "status", "rule_ids", "categories", "redaction_count"])

    empty = F.array().cast("array<string>")
    clean = F.struct(F.lit("clean").alias("status"), empty.alias("rule_ids"), empty.alias("categories"), F.lit(0).alias("redaction_count"))
    # one pass: what no rule can concern reaches the scan as null
    rows = df.withColumn("__may", may).withColumn("__s", scan(F.when(F.col("__may"), F.col(column))))
    told = F.struct(*(F.col(f"__s.{n}").alias(n) for n in ("status", "rule_ids", "categories", "redaction_count")))
    return rows.withColumns({"redacted": F.when(F.col("__may"), F.col("__s.redacted")).otherwise(F.col(column)), "scan": F.when(F.col("__may"), told).otherwise(clean)}).drop("__s", "__may")


def redact_fields(df: DataFrame, props: str, rules: RuleSet = DEFAULT, budgets: Budgets = Budgets()) -> DataFrame:
    """df with `redacted`, as redact_json gives it, for a column of mostly flat JSON objects."""
    columns = [c for c in df.columns if c.lower() != "redacted"]
    return redact_json(df, props, rules, budgets).select(*columns, "redacted")
