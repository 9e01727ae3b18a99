"""Keys of rows that come without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ids(rows: DataFrame, keys: list[str], id_col: str, known: DataFrame | None = None, bits: int = 62) -> DataFrame:
    """``rows`` with a 64-bit id below zero, a hash of ``keys``, of which every row must have its own.

    The whole table is checked: where two rows share an id, or one is among the ``id_col`` of
    ``known``, all but the first by key try the next hash, until none is left. So an id is that of
    its key unless two collide, and then goes by the order of their keys.
    """
    tried = rows.withColumn("_try", F.lit(0))
    while True:
        hashed = tried.withColumn(id_col, -1 - F.pmod(F.xxhash64(*keys, "_try"), F.lit((1 << bits) - 1)))
        same = Window.partitionBy(id_col).orderBy(*keys)
        marked = hashed.withColumn("_clash", F.row_number().over(same) > 1)
        if known is not None:
            taken = known.select(F.col(id_col).alias("_taken")).distinct()
            marked = marked.join(taken, F.col(id_col) == F.col("_taken"), "left").withColumn("_clash", F.col("_clash") | F.col("_taken").isNotNull()).drop("_taken")
        if not marked.filter("_clash").limit(1).count():
            return hashed.drop("_try")
        tried = marked.withColumn("_try", F.col("_try") + F.col("_clash").cast("int")).drop("_clash", id_col)
