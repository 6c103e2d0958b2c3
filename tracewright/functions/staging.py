"""Tables written to the shared folder, where lineage ends and a lost executor costs nothing."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset. On a cluster a
    warehouse on the local file system is refused, as executors would write where nobody else reads."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and urlparse(warehouse).scheme in ("", "file"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{warehouse}/_shared".rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
