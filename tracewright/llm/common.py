"""What the operators of this folder share: the shared scratch folder, joins whose small side is measured before it is
broadcast, and the Arrow plumbing that hands whole texts to numpy."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import shared_dir

#: A join side is broadcast up to this many rows of a few numbers each; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and losing an executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast only if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_small(big: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """big joined with a staged table that is broadcast only if it has at most BROADCAST_ROWS rows."""
    return big.join(small(other), on, how)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add (names are compared as Spark does, ignoring case)."""
    new = {x.lower() for x in names}
    return df.drop(*[c for c in df.columns if c.lower() in new])


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """df, where columns that an operator is about to replace go by other names, and the columns that give df back."""
    new = {x.lower() for x in names}
    kept = {c: f"__kept_{c}" for c in df.columns if c.lower() in new}
    return df.withColumnsRenamed(kept), [F.col(kept.get(c, c)).alias(c) for c in df.columns]


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], compute: Callable[[], Callable[[pa.RecordBatch, pa.Array], dict]]) -> DataFrame:
    """df with columns made from its text, batch by batch and without a shuffle.

    compute() runs once a task and gives a function of (batch, its text column) to a dict of arrays. Columns of df that
    have the name of a new one are replaced.
    """
    df = without(df, [f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in slices(batches, 8 << 20):
            if batch.num_rows:
                f = f or compute()
                new = f(batch, batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(new[x.name] for x in fields)], names=schema.names)

    return df.mapInArrow(tidied(run), schema)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the offsets of its rows in them; no copy."""
    col = pc.fill_null(col, "") if col.null_count else col
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, at, data = col.buffers()
    off = np.frombuffer(at, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if at else np.zeros(len(col) + 1, np.int64)
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)), off - off[0]


def tidied(run: Callable) -> Callable:
    """run, after which a worker that waits for its next task gives the memory of its last one back."""

    def inner(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about so many bytes, so that a worker holds little more than that besides what Spark hands it."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def shards(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
