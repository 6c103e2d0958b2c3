"""Append-only tables of Parquet files."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import RuleSet, validated
from ..functions.staging import staged


#: Buckets of a ledger; a batch reads those that its keys fall into. Fixed when the ledger is first written.
BUCKETS = 64
#: Bits of a filter for each key, and how many of them a key sets: about one in a hundred absent keys is taken for present.
_BITS, _SET = 10, 7
_BUCKET, _FILTERS = "bucket_no", "_filters"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def bucket_of(by: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a row's key."""
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def read_ledger(spark: SparkSession, path: str, schema, only: list[int] | None = None) -> DataFrame:
    """A ledger's rows, of the given buckets only if there are any; a ledger that isn't there yet is empty. Any other fault (no
    permission, a broken file) is raised."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(path)
    return (rows if only is None else rows.filter(F.col(_BUCKET).isin(only))).select(*kind.names)


def _spots(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits that each key sets in a filter of so many bits (a power of two)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(_SET, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _filter(table: pa.Table) -> pa.Table:
    hashes = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
    size = 1 << max(6, int(len(hashes) * _BITS - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_spots(hashes, size).ravel()] = True
    return pa.table({_BUCKET: pa.array([table.column(_BUCKET)[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _suspect(keys: pa.Table, filters: pa.Table) -> pa.Table:
    hashes = keys.column("h").to_numpy().astype(np.int64).view(np.uint64)
    found = False
    for held in filters.column("bits").to_pylist():
        bits = np.unpackbits(np.frombuffer(held, np.uint8))
        found = found or bool(bits[_spots(hashes, len(bits))].all(1).any())
    return pa.table({_BUCKET: pa.array(keys.column(_BUCKET).unique().to_pylist() if found else [], pa.int32())})


def _keys(df: DataFrame, by: list[str], bucket_by: list[str], buckets: int) -> DataFrame:
    return df.select(bucket_of(bucket_by, buckets).alias(_BUCKET), F.xxhash64(*by).alias("h")).distinct()


def may_hold(df: DataFrame, path: str, by: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS) -> list[int]:
    """The buckets in which a ledger may hold any of df's keys; the filters of all others clear them, so that they needn't be
    read. Filters and keys meet by bucket; only numbers of buckets come back."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/{_FILTERS}"):
        return []
    filters = spark.read.schema(f"{_BUCKET} int, bits binary").parquet(f"{path}/{_FILTERS}")
    met = _keys(df, by, bucket_by or by, buckets).groupBy(_BUCKET).cogroup(filters.groupBy(_BUCKET)).applyInArrow(lambda k, f: _suspect(k, f) if k.num_rows else k.select([_BUCKET]), f"{_BUCKET} int")
    return sorted(r[0] for r in met.distinct().collect())


def add_rows(df: DataFrame, path: str, by: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS, partition_by: str | None = None) -> None:
    """Appends rows that the ledger is known not to hold. Filters are written first: one that is too many costs a look, one that
    is missing would let a row in twice."""
    bucket_by = bucket_by or by
    _keys(df, by, bucket_by, buckets).groupBy(_BUCKET).applyInArrow(_filter, f"{_BUCKET} int, bits binary").write.mode("append").parquet(f"{path}/{_FILTERS}")
    writer = df.withColumn(_BUCKET, bucket_of(bucket_by, buckets)).repartition(_BUCKET).write.mode("append")
    writer.partitionBy(*[_BUCKET, *([partition_by] if partition_by else [])]).parquet(path)


def append_ledger(df: DataFrame, path: str, keys: list[str], partition_by: str | None = None, buckets: int = BUCKETS) -> None:
    """Appends the rows whose key the ledger hasn't; of rows with one key in df, one is appended. Nothing is ever changed, and
    a batch that runs twice adds nothing the second time.

    Of the ledger, only key columns of the buckets that the batch's keys fall into and that the filters don't clear are read.
    A null in a key is a value like any other.
    """
    df = staged(df.dropDuplicates(keys), "append")
    only = may_hold(df, path, keys, buckets=buckets)
    held = read_ledger(df.sparkSession, path, df.schema, only).select(*(F.col(k).alias(f"__held_{k}") for k in keys))
    known = [F.col(k).eqNullSafe(F.col(f"__held_{k}")) for k in keys]
    add_rows(staged(df.join(held, known, "left_anti"), "append") if only else df, path, keys, None, buckets, partition_by)


def export_envelopes(df: DataFrame, path: str) -> None:
    """A JSON object per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_rules(path: str) -> tuple[list[dict], str]:
    """The rule rows and version of a YAML or JSON file on the driver: `version` and `rules`, a mapping each."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        held = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("rules in YAML need the package yaml; give them as JSON") from e
        try:
            held = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"the rule file can't be read: {e}") from None
    if not isinstance(held, dict) or not isinstance(held.get("rules"), list) or not all(isinstance(r, dict) for r in held["rules"]):
        raise ValueError("a rule file needs a version and a list of rules")
    return held["rules"], str(held.get("version") or "")


def load_rules(rows: list[dict] | str, version: str | None = None, literals_path: str | None = None) -> RuleSet:
    """A validated rule set of rows, or of a rule file; literals are lines of a file on the driver, blank lines and those that
    begin with # aside. Whatever is wrong raises ValueError, so that no job runs with fewer rules."""
    if isinstance(rows, str):
        rows, found = read_rules(rows)
        version = version or found
    literals = []
    if literals_path:
        literals = [x.strip() for x in Path(literals_path).read_text().splitlines() if x.strip() and not x.lstrip().startswith("#")]
    return validated(version, rows, literals)
