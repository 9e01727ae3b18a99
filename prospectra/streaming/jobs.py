"""Incremental runs. A stream's checkpoint is the resume cursor; nothing here keeps state between batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from prospectra.operators.writers import insert_absent


def new_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def insert_stream(rows: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append what arrives and is not there. A batch that runs again inserts nothing twice."""
    return rows.writeStream.foreachBatch(lambda batch, _: insert_absent(batch, target, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rescore_stream(evidence: DataFrame, rescore: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Score anew the businesses that new evidence touches.

    ``rescore`` gets the distinct ids of a batch and returns their scores; they are appended with
    the batch's number, and the latest row of a business counts. A batch that runs again replaces
    its own folder.
    """

    def step(batch: DataFrame, number: int) -> None:
        touched = batch.select("business_id").distinct()
        rescore(touched).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return evidence.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify_stream(found: DataFrame, verify: Callable[[DataFrame], DataFrame], evidence: str, rescore: Callable[[DataFrame, DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Turn what was found into evidence, then score anew the businesses that it touches.

    ``verify`` makes rows of evidence from a batch; those whose business and source have none yet are
    appended to ``evidence``. ``rescore`` gets the ids of the batch and all evidence. A batch that
    runs again appends nothing twice and replaces its own scores.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = verify(batch)
        insert_absent(rows, evidence, ["business_id", "source"])
        known = batch.sparkSession.read.schema(rows.schema).parquet(evidence)
        rescore(batch.select("business_id").distinct(), known).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for checkpoints and targets of one run."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(at or '/tmp/checkpoints/prospectra').rstrip('/')}/{uuid.uuid4().hex}"
