"""What an indexing run has done, kept so that a restart goes on from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "layer string, key string, repo_id string"


class Checkpoint:
    """Finished keys of a repository's layers, as a table in a shared folder. Rows of another repository, and a folder that can't be read, count as nothing done."""

    def __init__(self, spark: SparkSession, path: str, repo_id: str):
        self.spark, self.path, self.repo_id = spark, path, repo_id

    def _file_system(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def done(self, layer: str) -> DataFrame:
        fs, p = self._file_system()
        if not fs.exists(p):
            return self.spark.createDataFrame([], "key string")
        rows = self.spark.read.schema(DONE).option("ignoreCorruptFiles", True).parquet(self.path)
        return rows.where((F.col("repo_id") == self.repo_id) & (F.col("layer") == layer)).select("key").distinct()

    def mark(self, layer: str, keys: DataFrame) -> None:
        """Add finished keys (the first column). A commit is one write, so mark some at a time."""
        name = keys.columns[0]
        keys.select(F.lit(layer).alias("layer"), F.col(name).cast("string").alias("key"), F.lit(self.repo_id).alias("repo_id")).write.mode("append").parquet(self.path)

    def left(self, layer: str, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key isn't finished."""
        d = self.done(layer).select(F.col("key").alias("_done"))
        return rows.join(d, F.col(key).cast("string") == F.col("_done"), "left_anti")

    def clear(self) -> None:
        fs, p = self._file_system()
        fs.delete(p, True)
