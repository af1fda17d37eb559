"""Small state tables written once per micro-batch.

Every table is a folder with one sub-folder per batch.  A retried batch overwrites its own
sub-folder with the same rows, so processing is exactly-once whatever fails in between; the
folder must be shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class StateTable:
    def __init__(self, spark: SparkSession, folder: str, name: str, schema: T.StructType | str):
        self.spark = spark
        self.path = f"{folder}/{name}"
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _exists(self, path: str) -> bool:
        """Asked of the file system, because a folder of a failed batch may be missing."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        """Store this batch's rows and hand back the stored rows: later steps of the batch start
        from storage, not from the source."""
        target = f"{self.path}/batch={batch}"
        df.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target)

    def write_once(self, df: DataFrame, batch: int) -> DataFrame:
        """write(), unless this batch is stored already: for tables whose files another stream follows."""
        target = f"{self.path}/batch={batch}"
        if self._exists(f"{target}/_SUCCESS"):
            return self.spark.read.schema(self.schema).parquet(target)
        return self.write(df, batch)

    def read(self, batch: int) -> DataFrame:
        """The rows of one batch (none when there was no such batch)."""
        target = f"{self.path}/batch={batch}"
        if not self._exists(target):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(target)

    def read_all(self, with_batch: bool = False) -> DataFrame:
        """The rows of every batch."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return found if with_batch else found.select(*self.schema.names)
