"""What the operators of this package share: the shared folder, tables in it, Arrow batch sizes."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints/prospectra"
#: Bytes of an Arrow batch, whatever its rows hold; bounds a Python worker's memory.
BATCH_BYTES = 4 << 20


def _root(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or DEFAULT_SHARED).rstrip("/")


#: The folder under the shared one that takes the tables stored now, and only these.
_scope: ContextVar[str] = ContextVar("scope", default="tables")


@contextmanager
def scope() -> Iterator[str]:
    """A folder of its own for the tables that are stored inside; gives its name, for ``emptied``."""
    name = uuid.uuid4().hex
    before = _scope.set(name)
    try:
        yield name
    finally:
        _scope.reset(before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under the session's ``spark.checkpoint.dir`` if set."""
    return f"{_root(spark)}/{_scope.get()}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage, and any executor can read the files again after another is lost.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, scope_name: str) -> None:
    """Empty the tables stored in a scope. Only for when every result that reads them has been written."""
    spark.range(0).write.mode("overwrite").parquet(f"{_root(spark)}/{scope_name}")  # an empty table in their place


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes. All operators set the same, so lazy results may run in any order."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_resident: dict[object, object] = {}


def resident(key: object, make):
    """What a worker process keeps from task to task: one object at a time, so that operators do not add up in it."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _resident[key] = make()
    return _resident[key]


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z only. ``lower`` does the same to pure ASCII and is much faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
