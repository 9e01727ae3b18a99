"""Values as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, history: DataFrame, keys: list[str], at: str, since: str, values: list[str], span: Column | None = None) -> DataFrame:
    """``rows`` with the ``values`` that ``history`` last gave their key, up to and at the time ``at``; null where it gave none.

    Both tables are united and sorted by key and time, so a row's value is the last one before it;
    no pair of rows is made. ``span`` cuts time into numbered pieces (an expression over ``_at``), by
    years if it is not given: a key with a long history is the work of many tasks, and what a piece
    begins with comes from one row for each piece before it. At equal times a history row counts
    before a row, and of several the greatest by its values. Rows come back as often as they came,
    those with a null time or key without values.
    """
    span = F.year("_at") if span is None else span
    own = F.struct(*[F.col(c).alias(c) for c in values])
    told = history.select(*keys, F.col(since).alias("_at"), own.alias("_value")).filter(F.col("_at").isNotNull())
    asked = rows.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(told.schema["_value"].dataType).alias("_value"), F.struct(*rows.columns).alias("_given"))
    both = asked.unionByName(told, allowMissingColumns=True).withColumn("_span", span)
    within = Window.partitionBy(*keys, "_span").orderBy("_at", F.col("_given").isNotNull(), "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_value", ignorenulls=True).over(within)).filter("_given IS NOT NULL")

    pieces = both.groupBy(*keys, "_span").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    start = pieces.withColumn("_start", F.last("_end", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_span").alias("_s"), "_start")
    met = F.col("_span") == F.col("_s")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_k_{k}"))
    whole = F.col("_at").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    known = F.when(whole, F.coalesce("_last", "_start"))
    return found.join(start, met, "left").select("_given.*", *[known[c].alias(c) for c in values])
