"""Exports as batches: a sheet and its rows of the ledger count together or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import write_csv

ROW = "business_id bigint, platform string, exported_on date, status string"


class ExportLog:
    """Batches of leads under ``path``, each with an id that its caller gives.

    A batch first writes the leads that it has chosen, then a sheet and a ledger made of these files,
    then a line that commits it. Whatever breaks off before that line, running the batch again
    under its id goes on with the leads that were chosen the first time: none is lost, none is
    exported twice. A batch that is committed does nothing more. One batch at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def committed(self) -> DataFrame:
        """(``batch``, ``leads``) of the batches that count."""
        found = self._read("commits", "leads bigint, batch string")
        return self.spark.createDataFrame([], "leads bigint, batch string") if found is None else found

    def ledger(self) -> DataFrame:
        """The rows of batches that count."""
        found = self._read("ledger", f"{ROW}, batch string")
        rows = self.spark.createDataFrame([], f"{ROW}, batch string") if found is None else found
        return rows.join(self.committed().select("batch"), "batch", "left_semi").drop("batch")

    def sheets(self) -> list[str]:
        """Folders of the sheets that count, in order of their batches."""
        return [f"{self.path}/sheets/batch={r['batch']}" for r in self.committed().select("batch").distinct().orderBy("batch").toLocalIterator()]

    def run(self, batch: str, platform: str, day: object, choose: Callable[[DataFrame], DataFrame], sheet: Callable[[DataFrame], DataFrame]) -> int:
        """Export a batch on a platform and a day; returns how many leads it has.

        ``choose`` gets the ledger and gives the leads; ``sheet`` makes the columns of a file from leads.
        """
        if not batch or not set(batch) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"):
            raise ValueError("a batch's id has letters, digits, _ and - only")
        done = self.committed().filter(F.col("batch") == batch).first()
        if done:
            return done["leads"]
        if not self._there(f"chosen/batch={batch}"):
            choose(self.ledger()).write.mode("overwrite").parquet(f"{self.path}/chosen/batch={batch}")
        leads = self.spark.read.parquet(f"{self.path}/chosen/batch={batch}")
        rows = leads.select("business_id", F.lit(platform).alias("platform"), F.lit(day).cast("date").alias("exported_on"), F.lit("queued").alias("status"))
        write_csv(sheet(leads), f"{self.path}/sheets/batch={batch}", "overwrite")
        self._write_ledger(rows, batch)
        n = rows.count()
        self.spark.createDataFrame([(n,)], "leads bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return n

    def _write_ledger(self, rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def _there(self, part: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True
