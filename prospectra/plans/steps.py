"""Tables between the steps of a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospectra.streaming.jobs import run_folder


class Steps:
    """Writes tables that several steps read once, in a new folder that driver and executors share.

    A step then starts from files: its plan holds no step before it, and any executor can read them
    again after another is lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, run_folder(spark)

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
