"""Keyed tables of Parquet files that take updates.

Rows are dealt into buckets by a hash of their key. An update reads and writes the buckets that it
touches, into a folder of its own, and then writes which folder holds each bucket: a manifest of one
row a bucket, the one with the highest number counts. Files of other buckets stay where they are, so
readers of the manifest before see that table to its end, and an update that breaks off has changed
nothing. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prospectra.operators.windows import keep_first


class BucketTable:
    """A table at ``path`` with ``schema``, unique by ``keys``; no row has a null in a key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(number, {bucket: number of the update that wrote it}); a table that is not there yet has number 0 and no bucket."""
        try:
            rows = self.spark.read.schema("bucket int, written int, number int").parquet(f"{self.path}/manifest")
            last = rows.agg(F.max("number")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (0, {}) if last is None else (last, {r["bucket"]: r["written"] for r in rows.filter(F.col("number") == last).collect()})

    def _files(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/written={n}/bucket={b}" for b, n in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._files(self.manifest()[1])

    def read_touched(self, rows: DataFrame) -> DataFrame:
        """The buckets that may hold keys of ``rows``, and no other."""
        held = self.manifest()[1]
        return self._files({b: held[b] for b in self._touched(rows) if b in held})

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # as many as there are buckets

    def _rewrite(self, rows: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> int:
        """The buckets of ``rows`` anew; returns how many that were."""
        number, held = self.manifest()
        touched = self._touched(rows)
        if touched:
            out = merged(self._files({b: held[b] for b in touched if b in held})).select(*self.schema.names)
            # a bucket is one file; overwriting clears what an update that broke off has left
            out.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/written={number + 1}")
            full = {r[0] for r in out.select(self.bucket()).distinct().collect()}
            now = {b: n for b, n in held.items() if b not in touched} | {b: number + 1 for b in touched if b in full}
            new = self.spark.createDataFrame(sorted(now.items()), "bucket int, written int").coalesce(1)
            new.write.mode("overwrite").parquet(f"{self.path}/manifest/number={number + 1}")
        return len(touched)

    def _first(self, rows: DataFrame) -> DataFrame:
        return keep_first(rows.select(*self.schema.names).dropna(subset=self.keys), self.keys, F.to_json(F.struct(*self.schema.names)))

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of their key or come in; of rows with one key the first by content. Repeating it changes nothing."""
        new = self._first(rows)
        return self._rewrite(new, lambda old: old.join(new, self.keys, "left_anti").unionByName(new))

    def insert_absent(self, rows: DataFrame) -> int:
        """Rows whose key the table does not hold come in; buckets that gain none are not written."""
        new = self._first(rows).join(self.read_touched(rows), self.keys, "left_anti")
        return self._rewrite(new, lambda old: old.unionByName(new))

    def update(self, rows: DataFrame, columns: list[str]) -> int:
        """``columns`` take the values of ``rows`` where the table has their key; keys that it lacks do not come in."""
        new = keep_first(rows.select(*self.keys, *columns), self.keys, F.to_json(F.struct(*columns)))
        renamed = new.select(*self.keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
        hit = new.join(self.read_touched(new).select(*self.keys), self.keys, "left_semi")
        return self._rewrite(hit, lambda old: old.join(renamed, self.keys, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}))

    def remove(self, rows: DataFrame) -> int:
        gone = rows.select(*self.keys).join(self.read_touched(rows).select(*self.keys), self.keys, "left_semi")
        return self._rewrite(gone, lambda old: old.join(rows, self.keys, "left_anti"))
