"""Session settings the plans rely on, and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM interprets, and never compiles, methods above 8,000 bytes of bytecode: let Spark
    # split wide projections (log parsing) instead of fusing them into one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "flowspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Apply the settings a session may lack: UTC times (results depend on it) and the method
    size limit."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, RECOMMENDED[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where none is named, a folder of the warehouse,
    which every executor reaches as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages restart from shared storage, not from the source."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: later jobs start from the files, whatever
    executors are lost, and see the same rows in the same parts however often they read them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
