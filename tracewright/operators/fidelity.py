"""What could not be kept, and how it is accounted for: size bounds, stripped binaries, outcome summaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact_json import Number, Pairs, dumps, loads

MIB = 1 << 20
#: Bounds, bands, and the reasons that belong to each class of outcome.
TRANSPORT_LIMIT, CONTENT_LIMIT = 1_000_000, 128 * MIB
BANDS = ((1 * MIB, "up_to_1_mib"), (64 * MIB, "over_1_mib_through_64_mib"), (128 * MIB, "over_64_mib_through_128_mib"))
OVER_BAND = "over_128_mib"
BINARY_CATEGORIES = ("attachment", "archive", "executable", "image", "audio")
REASONS = {
    "captured": ("complete",),
    "fidelity_omission": (
        "observation_exceeds_transport_limit",
        "observation_exceeds_content_limit",
        "unsupported_binary_content",
        "json_parse_error",
        "source_record_uninspectable",
        "invalid_utf8",
        "leaf_exceeds_limit",
        "sensitive_field_scalar",
        "sensitive_field_subtree",
        "redacted_name_collision",
    ),
    "safety_failure": ("matcher_timeout", "required_inspection_incomplete", "scan_budget_exhausted", "scanner_internal_failure", "scanner_policy_unavailable"),
}
OMISSION_FIELDS = ("reason", "originalByteCount", "policyVersion", "sourceIdentity")
POLICY_ADAPTER = "capture-fidelity-policy"
HARNESSES = ("codex", "claude_code", "other")


def size_band(size: Column, bands=BANDS) -> Column:
    """The band of a number of bytes: unknown (null or negative), at most each limit, or over the last."""
    out = F.lit(OVER_BAND)
    for limit, name in reversed(bands):
        out = F.when(size <= limit, name).otherwise(out)
    return F.when(size.isNull() | (size < 0), "unknown").otherwise(out)


def harness_norm(name: Column) -> Column:
    """codex, claude_code or other."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(low.startswith("codex"), "codex").when(low.rlike("^claude[-_ ]?code"), "claude_code").otherwise("other")


def summarize_outcomes(df: DataFrame) -> DataFrame:
    """harness, class, reason, size_band, count."""
    return df.groupBy("harness", "class", "reason", "size_band").agg(F.count("*").alias("count"))


def merge_outcomes(*summaries: DataFrame) -> DataFrame:
    """Summaries added up; any grouping of them gives the same."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy("harness", "class", "reason", "size_band").agg(F.sum("count").alias("count"))


def health_fidelity(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """health is blocked with any safety failure, fidelity degraded with any omission; neither says anything of the other."""
    has = lambda c: F.coalesce(F.bool_or(F.col("class") == c), F.lit(False))
    return summary.groupBy(*by).agg(F.when(has("safety_failure"), "blocked").otherwise("healthy").alias("health"), F.when(has("fidelity_omission"), "degraded").otherwise("complete").alias("fidelity"))


def closed_vocab_check(summary: DataFrame) -> DataFrame:
    """Rows with an unknown harness, band or class, a reason of another class, or a count that isn't positive, with `rule`."""
    known = F.lit(False)
    for k, reasons in REASONS.items():
        known |= (F.col("class") == k) & F.col("reason").isin(*reasons)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    faults = F.array(
        F.when(no(F.col("harness").isin(*HARNESSES)), "harness"),
        F.when(no(F.col("size_band").isin("unknown", OVER_BAND, *(b for _, b in BANDS))), "size_band"),
        F.when(no(F.col("class").isin(*REASONS)), "class").when(no(known), "reason"),
        F.when(no(F.col("count") > 0), "count"),
    )
    return summary.withColumn("rule", F.explode(F.filter(faults, lambda x: x.isNotNull())))


def omit_over_limit(df: DataFrame, payload: str, limit: int = TRANSPORT_LIMIT) -> DataFrame:
    """df with `omission` (null, or struct<reason, original_bytes>) and its payload replaced by null where it is over the
    limit in UTF-8; a limit can only tighten the bound on content."""
    size = F.octet_length(F.col(payload)).cast("long")
    bound = min(limit, CONTENT_LIMIT)
    reason = F.when(size > CONTENT_LIMIT, "observation_exceeds_content_limit").otherwise("observation_exceeds_transport_limit")
    over = F.coalesce(size > bound, F.lit(False))
    return df.withColumns({"omission": F.when(over, F.struct(reason.alias("reason"), size.alias("original_bytes"))), payload: F.when(~over, F.col(payload))})


def classify_fidelity(df: DataFrame) -> DataFrame:
    """df with class, reason and original_bytes from its omission column; text that only looks like an omission isn't one."""
    kept = F.col("omission").isNull()
    return df.withColumns({"class": F.when(kept, "captured").otherwise("fidelity_omission"), "reason": F.when(kept, "complete").otherwise(F.col("omission.reason")), "original_bytes": F.col("omission.original_bytes")})


def stored_omission(payload: Column, adapter: Column, adapter_version: Column, version: str) -> Column:
    """struct<reason, original_bytes> of a stored payload (JSON) that is an omission of this policy's own, else null.

    It is one only if the policy's adapter of this version stored it, and its `omission` has exactly the known fields: a
    reason about a size, a whole positive number of bytes, this version, and an object that names the source. A source's
    own text of that shape, or one with more or fewer fields, is no omission.
    """
    v = F.try_parse_json(payload)
    o = F.try_variant_get(v, "$.omission", "variant")
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.omission{path}", "variant")), "^[A-Z]+", 0)
    names = F.map_keys(F.from_json(F.to_json(o), "map<string,string>"))
    reason = F.try_variant_get(v, "$.omission.reason", "string")
    size = F.try_variant_get(v, "$.omission.originalByteCount", "long")
    known = (
        (adapter == POLICY_ADAPTER)
        & (adapter_version == version)
        & (kind("") == "OBJECT")
        & (F.array_sort(names) == F.array(*map(F.lit, sorted(OMISSION_FIELDS))))
        & (kind(".reason") == "STRING")
        & reason.isin("observation_exceeds_transport_limit", "observation_exceeds_content_limit")
        & (kind(".originalByteCount") == "BIGINT")
        & (size > 0)
        & (kind(".policyVersion") == "STRING")
        & (F.try_variant_get(v, "$.omission.policyVersion", "string") == version)
        & (kind(".sourceIdentity") == "OBJECT")
    )
    return F.when(known, F.struct(reason.alias("reason"), size.alias("original_bytes")))


_BYTE = re.compile(r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\Z")


def _stripped(value, found: list):
    if not isinstance(value, Pairs):
        return [_stripped(v, found) for v in value] if isinstance(value, list) else value
    last = dict(value)  # of repeated names the last one counts
    data = last.get("byte_payload")
    binary = last.get("type") == "binary_content" and isinstance(last.get("category"), str) and last["category"] in BINARY_CATEGORIES and isinstance(data, list) and not isinstance(data, Pairs)
    if not (binary and all(isinstance(b, Number) and _BYTE.match(b.text) for b in data)):
        return Pairs((k, _stripped(v, found)) for k, v in value)
    name, n = "capture_fidelity_omission", 1
    while name in last:
        n += 1
        name = f"capture_fidelity_omission_{n}"
    found.append(len(data))
    account = Pairs([("reason", "unsupported_binary_content"), ("original_bytes", Number(str(len(data)))), ("category", last["category"])])
    return Pairs([*((k, _stripped(v, found)) for k, v in value if k != "byte_payload"), (name, account)])


def strip_binary(df: DataFrame, column: str) -> DataFrame:
    """df whose JSON has lost the bytes of its binary parts, each replaced by an exact account of them; `stripped_bytes` lists
    their sizes. Only rows that can hold a binary part are parsed; others, and texts that aren't JSON, pass as they are."""
    may = F.col(column).contains("binary_content") & F.col(column).contains("byte_payload")

    @F.pandas_udf("struct<text:string,sizes:array<long>>")
    def strip(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found: list[int] = []
            try:
                new = dumps(_stripped(loads(t), found))
            except (ValueError, RecursionError):
                new, found = t, []
            out.append((new if found else t, found))
        return pd.DataFrame(out, columns=["text", "sizes"])

    rest = df.filter(~F.coalesce(may, F.lit(False))).withColumn("stripped_bytes", F.array().cast("array<long>"))
    hit = df.filter(may).withColumn("__s", strip(column)).withColumns({column: F.col("__s.text"), "stripped_bytes": F.col("__s.sizes")}).drop("__s")
    return rest.unionByName(hit)
