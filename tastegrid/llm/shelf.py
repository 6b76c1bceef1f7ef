"""Intermediate tables in the shared folder, written once and removed when used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastegrid.sources.workspace import fresh_path


# Files of a table for each core of the cluster, at most. Many more would only be small.
FILES_PER_CORE = 8


class Shelf:
    """Tables of one run. They survive lost executors, and nothing is computed twice."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, label: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it again; an earlier table of that label stays."""
        path = fresh_path(self.spark, label)
        most = FILES_PER_CORE * self.spark.sparkContext.defaultParallelism
        df.coalesce(most).write.parquet(path)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables that no later step reads."""
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
