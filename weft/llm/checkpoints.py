"""Intermediate tables in the folder that the cluster shares, so that no result hangs on an executor's disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.sources.shared import shared_folder as folder


class Tables:
    """Tables that a job writes and reads again; each can be dropped when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._made = 0

    def put(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, from files."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(read)] = read, path
        return read

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes the files behind what ``put`` returned; other frames are let be."""
        for df in frames:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_others(self, *kept: DataFrame) -> None:
        self.drop(*[df for df, _ in list(self._paths.values()) if not any(df is k for k in kept)])
