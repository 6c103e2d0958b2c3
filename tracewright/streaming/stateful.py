"""Import of a stream of records with keyed state: nothing of the ledger is read to judge a record.

Each stream's state lives in RocksDB: its checkpoint, first route and stop code, the signature of every accepted locator, and
the records that wait for a gap. State grows with the records that are accepted (a locator and a signature each) and spills
to disk; an import judged against a bucketed ledger (streaming.imports) keeps none instead.

Stop codes are data. A gap goes when it is closed; a conflict stays, at the least position that met one; a changed prefix
stays too, has no position, and stops the stream: nothing more of it is accepted. With halt_on_conflict a conflict stops it
as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.ingest import ACCEPTED, BLOCKED, CONFLICT, NEW

RECORD = "stream string, source_position long, locator string, content_signature string, payload string, ingest long, namespace string, basis string, prefix_changed boolean"
#: What leaves the operator: an accepted record (kind new), any other receipt, or a stream's new stop code.
ROW = "kind string, stream string, source_position long, locator string, content_signature string, payload string, ingest long, namespace string, basis string, status string"
PREFIX_CHANGED = "verified_prefix_changed"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
#: Rows that a stream's judgement gathers before they leave.
_LEAVE = 10_000
_FIELDS = ("source_position", "locator", "content_signature", "payload", "ingest", "namespace", "basis")


class ImportState(StatefulProcessor):
    """Judges the records of one stream at a time, in the order of position and ingest."""

    def __init__(self, halt_on_conflict: bool = False):
        self.halt_on_conflict = halt_on_conflict

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "checkpoint long, namespace string, basis string, code string, code_position long, moves long")
        self.held = handle.getMapState("held", "locator string", "signature string")
        self.waiting = handle.getMapState("waiting", "position long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A call of the state is a round trip to the JVM: what a batch itself holds is not asked for, and waiting records are
        written once, those that still wait after it."""
        self.key = key[0]
        head = self.head.get()
        checkpoint, *rest = head if head is not None else (-1, None, None, None, None, 0)
        self.checkpoint, (self.namespace, self.basis, self.code, self.at, moves) = int(checkpoint), rest
        before, self.new_waiting = (self.code, self.at), {}
        self.none_held, self.fresh = self.checkpoint < 0, {}
        self.stored = set() if head is None else {int(k[0]) for k in self.waiting.keys()}
        self.late: dict[int, list[dict]] = {}
        self.out: list[dict] = []
        for frame in rows:
            columns = {c: [None if v is None or v is pd.NA or v != v else v for v in frame[c].tolist()] for c in (*_FIELDS, "prefix_changed")}
            for r in sorted((dict(zip(columns, x, strict=True)) for x in zip(*columns.values(), strict=True)), key=lambda r: (r["source_position"] or 0, r["ingest"] or 0, r["locator"] or "")):
                if r["prefix_changed"]:
                    self.code, self.at = PREFIX_CHANGED, None
                else:
                    self.judge({f: int(r[f]) if f in ("source_position", "ingest") and r[f] is not None else r[f] for f in _FIELDS})
            if len(self.out) >= _LEAVE:
                yield self.left()
        for r in self.new_waiting.values():  # what still waits after all of this batch
            self.receipt(r, BLOCKED)
        for at, found in self.late.items():
            self.waiting.updateValue((at,), (json.dumps(found),))
        if self.code in (None, BLOCKED):
            first = min((*self.stored, *self.late), default=None)
            self.code, self.at = (BLOCKED if first is not None else None), first
        if (self.code, self.at) != before:
            moves += 1
            self.out.append({"kind": "stop", "stream": self.key, "source_position": self.at, "ingest": moves, "status": self.code})
        self.head.update((self.checkpoint, self.namespace, self.basis, self.code, None if self.at is None else int(self.at), int(moves)))
        if self.out:
            yield self.left()

    def left(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in _NAMES})

    def stopped(self) -> bool:
        return self.code == PREFIX_CHANGED or self.halt_on_conflict and self.code == CONFLICT

    def judge(self, r: dict) -> None:
        held = self.fresh.get(r["locator"])
        if held is None and not self.none_held:
            found = self.held.getValue((r["locator"],))
            held = None if found is None else found[0]
        if held is not None:
            same = held == (r["content_signature"] or "")
            return self.receipt(r, ACCEPTED) if same else self.conflict(r)
        if r["source_position"] <= self.checkpoint:
            return self.conflict(r)
        if self.stopped():
            return self.receipt(r, BLOCKED)
        if r["source_position"] > self.checkpoint + 1:
            return self.wait(r)
        self.checkpoint = r["source_position"]
        self.fresh[r["locator"]] = r["content_signature"] or ""
        self.held.updateValue((r["locator"],), (r["content_signature"] or "",))
        basis = "established"
        if self.namespace is None:
            self.namespace, self.basis = r["namespace"], r["basis"]
            basis = r["basis"]
        self.receipt(r | {"namespace": self.namespace, "basis": basis}, NEW)
        while not self.stopped() and (self.checkpoint + 1 in self.stored or self.checkpoint + 1 in self.late):
            at = self.checkpoint + 1
            for x in self.waiting_at(at, True):
                self.new_waiting.pop((x["source_position"], x["locator"], x["ingest"]), None)
                self.judge(x)
            if self.checkpoint < at:
                break

    def waiting_at(self, at: int, remove: bool) -> list[dict]:
        """What waits at a position, in order; removed from the state, if that is what holds it and it is to go."""
        if at in self.late:
            rows = self.late.pop(at) if remove else self.late[at]
        else:
            rows = json.loads(self.waiting.getValue((at,))[0]) if at in self.stored else []
        if remove and at in self.stored:
            self.stored.discard(at)
            self.waiting.removeKey((at,))
        return rows

    def wait(self, r: dict) -> None:
        at = r["source_position"]
        self.late[at] = sorted([*self.waiting_at(at, False), r], key=lambda x: (x["ingest"] or 0, x["locator"] or ""))
        self.new_waiting[at, r["locator"], r["ingest"]] = r

    def conflict(self, r: dict) -> None:
        if self.code != PREFIX_CHANGED:
            self.at = min(r["source_position"], self.at) if self.code == CONFLICT else r["source_position"]
            self.code = CONFLICT
        self.receipt(r, CONFLICT)

    def receipt(self, r: dict, status: str) -> None:
        where = {} if status == NEW else {"payload": None, "namespace": self.namespace, "basis": "established" if self.namespace is not None else None}
        self.out.append({"kind": "new" if status == NEW else "receipt", "stream": self.key, "status": status} | r | where)

    def close(self) -> None:
        pass


def stateful_import(records: DataFrame, out: str, checkpoint: str, halt_on_conflict: bool = False, **trigger) -> StreamingQuery:
    """Starts the import of a stream of records (see RECORD) into a log of rows (see ROW) at out, exactly once.

    A record with prefix_changed set says that its stream's verified prefix no longer stands. Positions are not null.
    Records of one stream are handled by one task, in Arrow batches; its waiting records and signatures stay on disk.
    """
    spark = records.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = records.groupBy("stream").transformWithStateInPandas(ImportState(halt_on_conflict), ROW, "Append", "None")
        return rows.writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(out)
    finally:
        spark.conf.set(provider, before)


def import_log(spark: SparkSession, out: str) -> DataFrame:
    """All rows that an import has written; kind is a partition, so that receipts and the ledger are read apart."""
    return spark.read.schema(ROW).parquet(out)


def latest_receipts(log: DataFrame) -> DataFrame:
    """The last word on every record: one that was blocked and then judged is told as judged."""
    key = ["stream", "source_position", "locator", "content_signature", "ingest"]
    return log.filter("kind <> 'stop'").groupBy(*key).agg(F.min_by(F.struct("status", "namespace", "basis"), F.when(F.col("status") == BLOCKED, 1).otherwise(0)).alias("r")).select(*key, "r.*")


def stop_codes(log: DataFrame) -> DataFrame:
    """stream, code, source_position: each stream's present stop code, of those that have had any; null is running again. In the
    log, a stream's changes of code are numbered in ingest."""
    last = F.max_by(F.struct("status", "source_position"), "ingest")
    return log.filter("kind = 'stop'").groupBy("stream").agg(last.alias("s")).select("stream", F.col("s.status").alias("code"), "s.source_position")
