"""Import, redaction and outcome counts on streams.

Signatures of accepted records stay in the ledger, not in operator state: each micro-batch is judged against the ledger's
rows of its own streams by the batch job, so that a replayed batch converges. Rows that wait for a gap go to a retry table
and join the next batch. An import that keeps its state itself is in stateful.py.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import redact
from ..functions.rules import DEFAULT, RuleSet
from ..operators import fidelity, ingest
from ..functions.staging import staged
from ..sources.ledger import _exists, add_rows, may_hold, read_ledger

RECORD = "stream long, source_position long, locator string, content_signature string, payload string, ingest long"


def import_batch(batch: DataFrame, ledger: str, retry: str, receipts: str, batch_id: int) -> None:
    """One micro-batch: rows that wait and those of the batch are judged together; new ones are appended to the ledger, blocked
    ones become the next retry table, and all are receipted.

    Of the ledger, only what judges is read (no payloads), of the buckets of the batch's streams, and of these only the ones in
    which filters know any of the streams. A batch that runs again keeps the receipts of its first run, if that came so far.
    """
    spark = batch.sparkSession
    waiting = read_ledger(spark, f"{retry}/{batch_id - 1}", RECORD)
    rows = staged(batch.select(*waiting.columns).unionByName(waiting), "arrived")
    only = may_hold(rows, ledger, ["stream"])
    place = f"{receipts}/{batch_id}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        held = read_ledger(spark, ledger, RECORD, only).select("stream", "source_position", "locator", "content_signature")
        mine = held.join(rows.select("stream").distinct(), "stream", "left_semi")
        ingest.import_receipts(rows, mine).write.mode("overwrite").parquet(place)
    judged = read_ledger(spark, place, f"{RECORD}, status string")
    judged.filter(F.col("status") == ingest.BLOCKED).drop("status").write.mode("overwrite").parquet(f"{retry}/{batch_id}")
    new = judged.filter(F.col("status") == ingest.NEW).drop("status")
    held = read_ledger(spark, ledger, RECORD, only).select("stream", "locator")
    add_rows(staged(new.join(held, ["stream", "locator"], "left_anti"), "accepted"), ledger, ["stream"])


def stream_import(records: DataFrame, ledger: str, work: str, **trigger) -> StreamingQuery:
    """Starts the import of a stream of records (see RECORD) into a ledger; work holds checkpoint, retry table and receipts."""
    run = lambda batch, k: import_batch(batch, ledger, f"{work}/retry", f"{work}/receipts", k)
    return records.writeStream.foreachBatch(run).option("checkpointLocation", f"{work}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def dedup_stream(records: DataFrame, ledger: DataFrame, keys: list[str], event_time: str | None = None, within: str = "1 day") -> DataFrame:
    """Records of a stream that a (static) ledger hasn't, each key once.

    With the name of a time column, keys are remembered for `within` behind the watermark, so that the state stays bounded;
    without one, all keys of the stream are.
    """
    new = records.join(ledger.select(*keys).distinct(), keys, "left_anti")
    if event_time is None:
        return new.dropDuplicates(keys)
    return new.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def stream_redact(stream: DataFrame, text: str, rules: RuleSet = DEFAULT) -> DataFrame:
    """A stream whose text is redacted before any sink sees it; the columns are those of the batch job."""
    return redact.redact_text(stream, text, rules)


def stream_outcomes(stream: DataFrame) -> DataFrame:
    """Running outcome counts (update or complete mode); the state is bounded by the closed vocabularies."""
    return fidelity.summarize_outcomes(stream)


def run_import(spark: SparkSession, batches: list[DataFrame], work: str) -> DataFrame:
    """Feeds tables to stream_import one after the other, as files of a source folder, and gives the ledger."""
    source, ledger = f"{work}/source-{uuid.uuid4().hex}", f"{work}/ledger-{uuid.uuid4().hex}"
    place = f"{work}/work-{uuid.uuid4().hex}"
    for batch in batches:
        batch.write.mode("append").parquet(source)
        stream_import(spark.readStream.schema(RECORD).parquet(source), ledger, place).awaitTermination()
    return read_ledger(spark, ledger, RECORD)
