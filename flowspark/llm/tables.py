"""Input tables and stored intermediate tables of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import pin, shared_dir

#: Rows and bytes of one Arrow batch handed to Python: a batch of long texts stays small.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    pin(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, which every executor reaches."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it back: later jobs restart from the files, whatever
    executors are lost, and read only the columns they need."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
