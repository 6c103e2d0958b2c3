"""Agent-trace ledgers, secret redaction, retrieval and provenance as Spark jobs over tables."""

from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of rows that a Python worker is handed at once, unless the session says otherwise: texts can be long.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def on_workers(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers find this package where the driver does (a source checkout that isn't installed) and are
    handed rows by their bytes, not their number."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
    if _BATCH[0] not in spark.conf.getAll and spark.sparkContext.getConf().get(_BATCH[0]) is None:
        spark.conf.set(*_BATCH)
    return spark
