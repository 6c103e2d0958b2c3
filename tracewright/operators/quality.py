"""Checks of ledger tables. Each gives violations: (table, key, rule); none means that the tables are sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redact import rule_matches
from ..functions.rules import DEFAULT, RuleSet

#: The closed vocabularies.
VOCABULARIES = {
    "type": ("decision", "fact", "preference", "task", "adr", "runbook", "note", "constraint", "open_question", "warning"),
    "visibility": ("private", "shared"),
    "status": ("proposed", "approved", "rejected", "superseded", "retired"),
    "tier": ("hot", "warm", "cold"),
    "route_basis": ("override", "origin", "directory", "fallback", "established"),
    "workstream_status": ("open", "checked_out", "done", "abandoned"),
}


def _violation(df: DataFrame, table: str, key, rule) -> DataFrame:
    return df.select(F.lit(table).alias("table"), key.cast("string").alias("key"), (rule if not isinstance(rule, str) else F.lit(rule)).alias("rule"))


def check_enums(df: DataFrame, table: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Values outside their vocabulary (columns: column to vocabulary's name); null is one of them. One pass, a row a fault."""
    faults = F.array(*(F.when(~F.coalesce(F.col(c).isin(*VOCABULARIES[v]), F.lit(False)), F.lit(f"unknown {c}")) for c, v in columns.items()))
    return _violation(df.withColumn("__rule", F.explode(F.filter(faults, lambda x: x.isNotNull()))), table, F.col(key), F.col("__rule"))


def check_unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row; nulls are equal to each other."""
    return _violation(df.groupBy(*keys).count().filter("count > 1"), table, F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)), f"repeated {'+'.join(keys)}")


def check_foreign(df: DataFrame, table: str, key: str, column: str, target: DataFrame, target_key: str) -> DataFrame:
    """References to rows that aren't there; null refers to nothing."""
    known = target.select(F.col(target_key).alias(column)).distinct()
    return _violation(df.filter(F.col(column).isNotNull()).join(known, column, "left_anti"), table, F.col(key), f"dangling {column}")


def check_locator_shape(df: DataFrame, table: str, key: str) -> DataFrame:
    """A locator is either a native id or a byte range, and nothing of the other."""
    native = (F.col("locator.kind") == "native_id") & F.col("locator.native_id").isNotNull() & F.col("locator.byte_offset").isNull() & F.col("locator.byte_length").isNull()
    range_ = (F.col("locator.kind") == "byte_range") & F.col("locator.native_id").isNull() & (F.col("locator.byte_offset") >= 0) & (F.col("locator.byte_length") > 0)
    return _violation(df.filter(~F.coalesce(native | range_, F.lit(False))), table, F.col(key), "locator shape")


def check_content_hash(df: DataFrame, table: str, key: str) -> DataFrame:
    """Stored hashes that aren't the content's."""
    return _violation(df.filter(~F.sha2("content", 256).eqNullSafe(F.col("content_hash"))), table, F.col(key), "content hash")


def check_bootstrap(rows: DataFrame, required: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Required rows that are missing."""
    return _violation(required.join(rows.select(*keys).distinct(), keys, "left_anti"), table, F.concat_ws("|", *keys), "missing")


def check_append_only(old: DataFrame, new: DataFrame, table: str, key: str) -> DataFrame:
    """Rows of old that new has lost or changed."""
    return _violation(old.exceptAll(new.select(*old.columns)), table, F.col(key), "changed or lost")


def check_no_secret(df: DataFrame, table: str, key: str, columns: list[str], rules: RuleSet = DEFAULT) -> DataFrame:
    """Rules that still match a stored text."""
    spans = F.concat(*(rule_matches(F.coalesce(F.col(c), F.lit("")), rules) for c in columns))
    ids = F.array_distinct(F.transform(spans, lambda s: s["rule_id"]))
    return _violation(df.withColumn("__rule", F.explode(ids)), table, F.col(key), F.concat(F.lit("secret "), F.col("__rule")))
