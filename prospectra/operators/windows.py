"""Latest, first and best row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key. Spark drops most others before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", at).filter("_rank = 1").drop("_rank")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return keep_first(rows, keys, *[F.desc_nulls_last(c) for c in order])


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """One value for each job, scope and key, blank scopes taken as the global one."""
    from prospectra.functions.text import scope

    return latest(checkpoints.withColumn("scope", scope("scope")), ["job_name", "scope", "checkpoint_key"], "updated_at", "checkpoint_value")


def after_cursor(rows: DataFrame, ts: str, key: str, at: object, last: object) -> DataFrame:
    """Rows after a (time, key) cursor; without a cursor (``at`` None) all rows, as from the start."""
    if at is None:
        return rows
    return rows.filter((F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > last)))


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page; no limit or one under 1 gives all rows."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit is not None and limit > 0 else out


def batch(rows: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """At most so many rows, the first in the order; no limit or one under 1 gives all, unsorted."""
    return page(rows, order, limit) if limit is not None and limit > 0 else rows


def work_queue(rows: DataFrame, *first: Column) -> DataFrame:
    """Rows that meet the conditions first, then by score, best first and unscored last, then by age."""
    return rows.orderBy(*[c.desc() for c in first], F.desc_nulls_last("lead_score"), "created_at", "business_id")
