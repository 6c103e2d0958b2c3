"""A corpus pipeline: language identification, one document of each group of near copies, benchmark decontamination, packing.

Each stage takes what the one before kept, written as Parquet and read again, and all but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import on_workers
from tracewright.llm import decontaminate, jaccard_join, language_id, packing
from tracewright.llm.common import aside, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject. They learn from this stage's own input. Null, empty and letterless
    texts are in no language and go. All columns of docs come back as they were."""
    on_workers(spark)
    rows, back = aside(docs, [f.name for f in language_id.FIELDS])
    found = language_id.identify(rows, language_id.fit(language_id.teaching(docs)))
    return found.filter(~F.col("rejected")).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of documents linked by a Jaccard similarity of 0.75 on five words; of
    repeated rows one. Documents without words all stay."""
    on_workers(spark)
    return jaccard_join.distinct_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words lie in windows of the benchmark."""
    on_workers(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: its bucket, batch and slot."""
    return packing.pack(packing.measured(docs), F.col("n_words")).drop("n_words")


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("packing", pack_lengths)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Language models and optimal buckets are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None
