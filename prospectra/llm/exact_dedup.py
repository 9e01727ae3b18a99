"""Exact duplicates by content sort, in DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters and sorted, so that equal texts
stand side by side; each row is compared in full with its neighbour. The key that deals rows to
ranges ends in a hash of the row's id, so a group of copies of any size is spread over many ranges
side by side. The last text of each range is compared in full with the first of the next, and what
equals across borders is joined up, so that no task gathers the texts of a hot group. A row has its
text once, through shuffle and sort.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Ranges for each shuffle partition. Ranges are dealt by hash, and more of them even out.
RANGES_PER_PARTITION = 4
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 12


def _key(norm: Column, digest: Column) -> Column:
    """Content order: leading characters, then a digest. In hex, so that no text can hold the separator."""
    return F.concat_ws(".", F.hex(F.encode(F.substring(norm, 1, 16), "utf-8")), digest)


def _splitters(keys: DataFrame, ranges: int) -> list[str]:
    """Borders between the ranges from a sample; they decide where rows go, never the result."""
    rows = keys.count()
    if rows == 0 or ranges < 2:
        return []
    share = min(1.0, SAMPLES_PER_RANGE * ranges / rows)
    found = sorted(r[0] for r in keys.sample(fraction=share, seed=11).collect())
    borders = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
    # each is cut where it first differs from the one before: a plan with many ranges stays small
    return [b[: len(commonprefix([a, b])) + 1] for a, b in zip(["", *borders], borders, strict=False)]


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    borders, steps = F.split(F.lit(",".join(splitters)), ","), []
    step = 1
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2
    fits = lambda at: (at <= len(splitters)) & (F.try_element_at(borders, at) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(fits(at + s), at + s).otherwise(at))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Mark the exact duplicates among ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest id stays (null ids sort lowest; of rows that repeat both id and text
    exactly one stays). One row comes back for each input row: ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` and the ``carry`` columns, as a struct ``carried``.
    An empty table gives an empty result; other columns of the input are ignored.
    """
    spark = docs.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [*carry] if text_col in carry else [*carry, text_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(c) for c in fields]).alias("_given"))
    norm = ascii_lower(F.coalesce(F.col("_given")[text_col], F.lit("")))
    digested = rows.withColumn("_digest", F.sha2(norm, 256))
    keyed = digested.withColumn("_key", _key(norm, F.col("_digest"))).withColumn("_spread", F.concat("_key", F.hex(F.xxhash64("_id"))))
    splitters = _splitters(keyed.select("_spread"), ranges)
    dealt = keyed.withColumn("_range", _range_of(F.col("_spread"), splitters)).select("_id", "_given", "_key", "_digest", "_range").repartition("_range")

    # equal texts side by side, the largest id first; each text is compared in full with the one before
    order = Window.partitionBy("_range").orderBy("_key", "_hash", F.desc_nulls_last("_id"))
    marked = (
        dealt.withColumn("_hash", F.xxhash64(norm))
        .withColumns({"_before": F.lag(norm).over(order), "_row": F.row_number().over(order), "_after": F.lead(F.lit(1)).over(order)})
        .withColumns({"_first": F.col("_row") == 1, "_last": F.col("_after").isNull()})
        .withColumns({"_new": F.col("_first") | (F.col("_before") != norm), "_edge": F.when(F.col("_first") | F.col("_last"), norm)})
        .select("_id", "_digest", "_range", "_row", "_new", "_first", "_last", "_edge", *(["_given"] if carry else []))
    )
    numbered = marked.withColumn("_run", F.sum(F.col("_new").cast("long")).over(Window.partitionBy("_range").orderBy("_row")))
    run = Window.partitionBy("_range", "_run")
    light = stored(numbered.withColumns({"_best": F.max("_id").over(run), "_size": F.count(F.lit(1)).over(run)}).drop("_row"), "content_sorted")

    # the last text of a range against the first of the next: two texts a range meet in a join, and the rest is flags
    edges = light.filter(F.col("_edge").isNotNull()).select("_range", "_run", "_first", "_last", "_edge", "_best", "_size")
    in_order = Window.orderBy("_range")
    following = edges.select("_range").distinct().withColumn("_next", F.lead("_range").over(in_order))
    first = edges.filter("_first").select(F.col("_range").alias("_next"), F.col("_edge").alias("_first_text"))
    same = edges.filter("_last").join(following, "_range").join(first, "_next").select(F.col("_next").alias("_range"), (F.col("_edge") == F.col("_first_text")).alias("_same"))
    ends = edges.groupBy("_range", "_run").agg(F.bool_or("_first").alias("_opens"), F.max("_best").alias("_best"), F.max("_size").alias("_size")).join(same, "_range", "left")
    breaks = F.when(F.col("_opens") & F.coalesce("_same", F.lit(False)), 0).otherwise(1)
    chained = ends.withColumn("_chain", F.sum(breaks).over(Window.orderBy("_range", "_run")))  # two rows a range at most
    whole = Window.partitionBy("_chain")
    joined = chained.select(
        "_range", "_run", F.max("_best").over(whole).alias("_all_best"), F.sum("_size").over(whole).alias("_all_size"),
        (F.row_number().over(whole.orderBy(F.desc_nulls_last("_best"), "_range", "_run")) == 1).alias("_leads"),
    )
    out = light.join(F.broadcast(joined), ["_range", "_run"], "left")  # two rows a range at most, whatever the input
    return out.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("_all_best", "_best").alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        (F.col("_new") & F.coalesce("_leads", F.lit(True))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
        *([F.struct(*[F.col("_given")[c].alias(c) for c in carry]).alias("carried")] if carry else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_dedup(docs, id_col, text_col, tuple(docs.columns)).filter("kept").select("carried.*")
