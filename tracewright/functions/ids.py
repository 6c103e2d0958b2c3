"""Identifiers and signatures that depend on content alone, so that a job that runs twice names things alike."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def framed(*parts: Column) -> Column:
    """The parts as one text from which they can be told again: each behind its length in bytes, `-` for a null one."""
    texts = [p.cast("string") for p in parts]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def deterministic_id(domain: str, *parts: Column) -> Column:
    """A version-8 UUID of a domain and its parts; null isn't empty, and parts can't run into each other."""
    h = F.sha2(framed(F.lit(domain), *parts), 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def session_id(*parts: Column) -> Column:
    """The trace session of a stream that has none yet."""
    return F.concat(F.lit("capture:v1:"), F.sha2(framed(*parts), 256))


def hmac_pads(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """binding, ipad, opad: a key's two blocks for HMAC-SHA256, a row per binding."""
    rows = []
    for binding, key in keys.items():
        block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        rows.append((binding, bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)))
    return spark.createDataFrame(rows, "binding string, ipad binary, opad binary")


def hmac_sha256(message: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 in hex, of a message in UTF-8, from a key's pads."""
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def content_signature(df: DataFrame, pads: DataFrame, binding: str, *content: str, name: str = "content_signature") -> DataFrame:
    """df signed with its binding's key over its identity and content, its position left out; null without a key."""
    message = framed(*map(F.col, content))
    joined = df.join(pads.withColumnRenamed("binding", "__b"), F.col(binding) == F.col("__b"), "left")
    return joined.withColumn(name, hmac_sha256(message, F.col("ipad"), F.col("opad"))).drop("__b", "ipad", "opad")


def version_compatible_signatures(df: DataFrame, versions: DataFrame, pads: DataFrame, binding: str, version: str, *content: str) -> DataFrame:
    """df with `signatures`: its content signed under its own adapter version and under each listed prior one.

    versions: (version, prior_versions array<string>), a small table of the adapter's history."""
    known = versions.withColumnsRenamed({"version": "__v", "prior_versions": "__prior"})
    rows = df.join(known, F.col(version) == F.col("__v"), "left").join(pads.withColumnRenamed("binding", "__b"), F.col(binding) == F.col("__b"), "left")
    message = framed(*map(F.col, content))
    every = F.concat(F.array(F.col(version)), F.coalesce("__prior", F.array().cast("array<string>")))
    signed = F.transform(every, lambda v: hmac_sha256(F.concat(framed(v), message), F.col("ipad"), F.col("opad")))
    return rows.withColumn("signatures", signed).drop("__v", "__prior", "__b", "ipad", "opad")
