"""Exactly-once, gap-aware import of records into an append-only ledger.

A record is known by its stream and locator. Positions of a stream count up from 0 without gaps: what comes after a missing
position waits. All decisions of a batch are joins and windows over keys; payloads take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import deterministic_id, session_id
from ..functions.numbering import numbered

NEW, ACCEPTED, CONFLICT, BLOCKED = "new", "already_accepted", "accepted_source_conflict", "blocked_by_earlier_gap"


#: Positions that are counted together before a stream's ranges are put in order.
_RANGE = 1 << 16


def contiguous_checkpoint(observations: DataFrame) -> DataFrame:
    """stream, checkpoint: the last position before a stream's first gap; -1 if position 0 is missing.

    Positions are counted by range; only a stream's counts are ordered, and the positions of its first range that isn't full.
    """
    rows = observations.filter("source_position >= 0").select("stream", "source_position").distinct().withColumn("__range", F.floor(F.col("source_position") / _RANGE))
    sizes = rows.groupBy("stream", "__range").count()
    order = Window.partitionBy("stream").orderBy("__range")
    full = ((F.col("__range") == F.row_number().over(order) - 1) & (F.col("count") == _RANGE)).cast("int")
    sizes = sizes.withColumn("__full", full).withColumn("__lead", F.min("__full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lead = sizes.groupBy("stream").agg(F.sum("__lead").alias("__open"))
    within = Window.partitionBy("stream").orderBy("source_position")
    last = rows.join(lead, "stream").filter(F.col("__range") == F.col("__open")).withColumn("__n", F.col("__open") * _RANGE + F.row_number().over(within) - 1)
    last = last.groupBy("stream").agg(F.max(F.when(F.col("source_position") == F.col("__n"), F.col("source_position"))).alias("__last"))
    every = observations.select("stream").distinct().join(lead, "stream", "left").join(last, "stream", "left")
    return every.select("stream", F.coalesce("__last", F.coalesce("__open", F.lit(0)) * _RANGE - 1).cast("long").alias("checkpoint"))


def backfill_positions(df: DataFrame, by: list[str], order: list[str], name: str = "source_position") -> DataFrame:
    """df with positions from 0 in each stream, in the given order. If the first of these is a number or a time, large streams
    are numbered in ranges of it."""
    if isinstance(df.schema[order[0]].dataType, T.NumericType | T.TimestampType | T.DateType):
        first = F.col(order[0]).cast("timestamp" if isinstance(df.schema[order[0]].dataType, T.DateType) else df.schema[order[0]].dataType).cast("double")
        return numbered(df, by, first, order, "__place").withColumn(name, (F.col("__place") - 1).cast("long")).drop("__place")
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def import_receipts(batch: DataFrame, observations: DataFrame) -> DataFrame:
    """batch (stream, source_position, locator, content_signature, ingest and anything else) with `status`.

    A record whose locator the ledger has is already accepted, or in conflict if its signature differs; so is one whose
    position another record holds. Of records with one locator or position within the batch, the first by position and
    ingest competes and the others are judged against it. The rest are new as long as they follow on the checkpoint without
    a gap, else blocked.
    """
    key = ["stream", "locator"]
    held = observations.select(*key, F.col("content_signature").alias("__held"), F.lit(True).alias("__known"))
    taken = observations.select("stream", "source_position", F.lit(True).alias("__taken")).distinct()
    rows = batch.join(held, key, "left").join(taken, ["stream", "source_position"], "left")
    order = ["source_position", "ingest"]
    first = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumns({"__copy": F.row_number().over(first), "__first_signature": F.first("content_signature").over(first)})
    same = lambda c: F.col("content_signature").eqNullSafe(F.col(c))
    judged = (
        F.when(F.col("__known") & same("__held"), ACCEPTED)
        .when(F.col("__known"), CONFLICT)
        .when(F.col("__taken"), CONFLICT)
        .when((F.col("__copy") > 1) & same("__first_signature"), ACCEPTED)
        .when(F.col("__copy") > 1, CONFLICT)
    )
    rows = rows.withColumn("__judged", judged)
    # of the rest, one record competes for each position
    place = Window.partitionBy("stream", "source_position", F.col("__judged").isNull()).orderBy("ingest", "locator")
    rows = rows.withColumn("__judged", F.when(F.col("__judged").isNull() & (F.row_number().over(place) > 1), CONFLICT).otherwise(F.col("__judged")))
    # what follows on the checkpoint without a gap, counted from there
    marks = contiguous_checkpoint(observations).withColumnRenamed("checkpoint", "__mark")
    rows = rows.join(marks, "stream", "left").withColumn("__from", F.col("source_position") - F.coalesce("__mark", F.lit(-1)) - 1)
    reach = contiguous_checkpoint(rows.filter("__judged is null").select("stream", F.col("__from").alias("source_position"))).withColumnRenamed("checkpoint", "__reach")
    rows = rows.join(reach, "stream", "left")
    status = F.coalesce("__judged", F.when((F.col("__from") >= 0) & (F.col("__from") <= F.col("__reach")), NEW).otherwise(BLOCKED))
    # a copy of a record that is blocked or in conflict itself wasn't accepted
    rows = rows.withColumn("status", status)
    lead = F.first("status").over(first)
    status = F.when((F.col("__copy") > 1) & F.col("__known").isNull() & (F.col("status") == ACCEPTED) & (lead != NEW), lead).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*batch.columns, "status")


def validate_observations(df: DataFrame, harness_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations of (observation_uuid, rule)). df has contract_version, binding, harness, source_position and
    events array<struct<part_key, relationships array<struct<type, native_id>>>>; harness_of is (binding, expected)."""
    rows = df.join(harness_of, "binding", "left")
    keys = F.transform("events", lambda e: e["part_key"])
    edges = F.flatten(F.transform("events", lambda e: F.coalesce(e["relationships"], F.array().cast("array<struct<type:string,native_id:string>>"))))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    faults = F.array(
        F.when(~F.col("contract_version").eqNullSafe(F.lit(1)), "contract_version"),
        F.when(~F.col("harness").eqNullSafe(F.col("expected")), "harness"),
        F.when(~F.coalesce(F.col("source_position") >= 0, F.lit(False)), "source_position"),
        F.when(F.coalesce(F.size("events"), F.lit(0)) < 1, "no events"),
        F.when(F.exists(keys, blank), "blank part_key"),
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated part_key"),
        F.when(F.exists(edges, lambda r: blank(r["type"]) | blank(r["native_id"])), "blank relationship"),
    )
    rows = rows.withColumn("__faults", F.filter(faults, lambda x: x.isNotNull()))
    return rows.filter(F.size("__faults") == 0).drop("__faults", "expected"), rows.select("observation_uuid", F.explode("__faults").alias("rule"))


def attach_binding(records: DataFrame, bindings: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their active binding's agent, harness and newest policy version, rejects with a reason)."""
    newest = policies.groupBy("binding").agg(F.max("policy_version").alias("policy_version"))
    rows = records.join(bindings.join(newest, "binding", "left"), "binding", "left")
    reason = F.when(F.col("active").isNull(), "unknown_binding").when(~F.col("active"), "inactive_binding")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason", "active"), rows.filter("reason is not null").select(*records.columns, "reason")


def established_session(observations: DataFrame, events: DataFrame, by: str = "stream") -> DataFrame:
    """stream, trace_session_id: that of its first accepted event, or one derived from the stream."""
    first = events.join(observations.select("observation_uuid", by, "source_position"), "observation_uuid").groupBy(by).agg(F.min_by("session_id", F.struct("source_position", "part_order", "trace_uuid")).alias("s"))
    return observations.select(by).distinct().join(first, by, "left").select(by, F.coalesce("s", session_id(F.col(by))).alias("trace_session_id"))


def event_rows(accepted: DataFrame, streams: DataFrame) -> DataFrame:
    """A row per event of accepted observations; session, agent and namespace are the stream's, never the payload's."""
    who = streams.select("stream", "trace_session_id", "agent_id", "namespace")
    rows = accepted.join(who, "stream").select("observation_uuid", "stream", F.col("trace_session_id").alias("session_id"), "agent_id", "namespace", F.explode("events").alias("e"))
    return rows.select(deterministic_id("event", F.col("observation_uuid"), F.col("e.part_key")).alias("trace_uuid"), "observation_uuid", "session_id", "agent_id", "namespace", "e.part_key", "e.part_order", "e.kind", "e.actor", "e.payload")


def relationship_rows(accepted: DataFrame) -> DataFrame:
    """A row per relationship of the events of accepted observations."""
    rows = accepted.select("observation_uuid", F.explode("events").alias("e")).select("observation_uuid", "e.part_key", F.explode("e.relationships").alias("r"))
    return rows.select(deterministic_id("event", F.col("observation_uuid"), F.col("part_key")).alias("source_trace_uuid"), F.col("r.type").alias("relationship_type"), F.col("r.native_id").alias("target_native_id"))


def prefix_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """stream, first_changed_position: where a source, read again, no longer begins with what was verified (a changed record
    or a missing one); streams whose prefix stands are left out. Both: stream, source_position, record_sha256."""
    rows = old.join(new.withColumnRenamed("record_sha256", "__new"), ["stream", "source_position"], "left")
    return rows.filter(~F.col("record_sha256").eqNullSafe(F.col("__new"))).groupBy("stream").agg(F.min("source_position").alias("first_changed_position"))
