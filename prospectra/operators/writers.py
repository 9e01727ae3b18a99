"""Writers. Parquet tables have no keys and no updates; each rule is kept by a join before the write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .leads import refreshed_sheet
from .windows import keep_first


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, for each key the first by content, whose key the table does not hold. Null keys never collide."""
    with_key = F.lit(True)
    for k in keys:
        with_key = with_key & F.col(k).isNotNull()
    keyed = new.filter(with_key)
    first = keyed.distinct() if set(new.columns) == set(keys) else keep_first(keyed, keys, F.to_json(F.struct(*new.columns)))
    return first.join(old, keys, "left_anti").unionByName(new.filter(~with_key))


def insert_absent(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append what the table at ``path`` does not hold; returns how many rows that were.

    Safe to repeat, but for rows with a null key: those never collide and are appended each time.
    """
    from pyspark.sql import Observation

    watch = Observation("inserted")
    rows = absent(new, _table(new, path), keys)
    rows.observe(watch, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return watch.get["n"]


def _table(new: DataFrame, path: str) -> DataFrame:
    """The table at a path, empty if there is none yet."""
    try:
        return new.sparkSession.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return new.limit(0)


def updated(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``base`` with the columns of ``updates`` where it has a row."""
    columns = [c for c in updates.columns if c != key]
    renamed = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(renamed, key, "left")
    old = lambda c: F.col(c) if c in base.columns else F.lit(None)
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old(c)) for c in columns}).drop("_hit", *[f"_new_{c}" for c in columns])


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).option("escape", "\"").option("emptyValue", "").option("nullValue", "").csv(path)


def refresh_sheet(leads: DataFrame, path: str) -> None:
    """The whole sheet anew, lists joined by comma and space."""
    write_csv(refreshed_sheet(leads), path, "overwrite")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Export rows, in folders by platform: a query of one platform reads no other."""
    rows.write.mode("append").partitionBy("platform").parquet(path)


def job_runs(log: DataFrame) -> DataFrame:
    """One row a run from a log that only grows: a run is logged when it starts and when it ends.

    Of a run's rows the last counts; a run that has ended has its start from its first row. Errors
    are cut to 4,000 characters.
    """
    last = lambda c: F.max_by(c, F.struct("at", F.col("status") != "running"))
    ended = F.col("status") != "running"
    return log.groupBy("run_id").agg(
        F.first("job_name").alias("job_name"), last("status").alias("status"), F.min("at").alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("finished_at"),
        F.coalesce(F.max("processed"), F.lit(0)).alias("processed"), F.substring(last("error"), 1, 4000).alias("error"),
    )


def write_metrics(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("section", "key", "value")).alias("value")).write.mode("overwrite").text(path)


def evidence_row(source: str, verdicts: DataFrame, at: Column) -> DataFrame:
    """Verdicts as rows of evidence."""
    return verdicts.select("business_id", F.lit(source).alias("source"), "result", F.col("website") if "website" in verdicts.columns else F.lit(None).cast("string").alias("website"), at.alias("checked_at"))
