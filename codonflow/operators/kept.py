"""Tables between the steps of a query whose steps would be too much for the disks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Kept:
    """Tables in a shared folder, made once and read again while a query runs; the folder goes when it ends.

    Each is written by a job of its own, with whose end its shuffle files go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._n = spark, path, 0

    def __enter__(self) -> Kept:
        self._before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_CLEAN, self._before)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __call__(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path, schema = f"{self.path}/{self._n}", df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)
