"""Counts over the engine's tables; each table is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V


def business_totals(scored: DataFrame) -> DataFrame:
    none = F.coalesce("website_url", F.lit("")) == ""
    has = F.col("lead_score").isNotNull()
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(none).alias("no_website"), F.count_if(has).alias("scored"), F.count_if(has & none).alias("scored_no_website")).withColumn("unscored", F.greatest(F.col("total") - F.col("scored"), F.lit(0)))


def contact_totals(contacts: DataFrame) -> DataFrame:
    has = F.count_if(F.col("lead_score").isNotNull())
    return contacts.agg(F.count(F.lit(1)).alias("total"), has.alias("scored"), F.greatest(F.count(F.lit(1)) - has, F.lit(0)).alias("unscored"))


def export_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "queued").alias("queued"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows each value has, most frequent first."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def coverage(verifications: DataFrame) -> DataFrame:
    """Businesses that each source, and any source, has looked at."""
    each = verifications.groupBy("source").agg(F.countDistinct("business_id").alias("businesses"))
    return each.unionByName(verifications.agg(F.countDistinct("business_id").alias("businesses")).withColumn("source", F.lit("any")))


def conclusive_split(verifications: DataFrame) -> DataFrame:
    done = F.col("result").isin(V.CONCLUSIVE_RESULTS)
    return verifications.groupBy("source").agg(F.count_if(done).alias("conclusive"), F.count_if(~done).alias("inconclusive"))


def confidence_distribution(scored: DataFrame) -> DataFrame:
    """Scored businesses without a website at each level; all four levels are there."""
    levels = scored.sparkSession.createDataFrame([(c,) for c in V.CONFIDENCE_LEVELS], "confidence string")
    rows = scored.filter(F.col("lead_score").isNotNull() & (F.coalesce("website_url", F.lit("")) == ""))
    return levels.join(rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def conclusive_histogram(businesses: DataFrame, verifications: DataFrame) -> DataFrame:
    """How many businesses have 0, 1, 2.. conclusive sources."""
    each = verifications.groupBy("business_id").agg(F.count_if(F.col("result").isin(V.CONCLUSIVE_RESULTS)).alias("k"))
    return businesses.select("business_id").join(each, "business_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("conclusive_sources")).agg(F.count(F.lit(1)).alias("businesses"))


def eligibility(scored: DataFrame, verifications: DataFrame, floor: float) -> DataFrame:
    """Leads at a floor, those with evidence, those left, and leads never scored."""
    seen = verifications.select("business_id", F.lit(True).alias("_seen")).distinct()
    rows = scored.filter(F.coalesce("website_url", F.lit("")) == "").join(seen, "business_id", "left")
    at = F.coalesce(F.col("lead_score") >= floor, F.lit(False))
    done = F.coalesce("_seen", F.lit(False))
    return rows.agg(F.count_if(at).alias("eligible"), F.count_if(at & done).alias("processed"), F.count_if(at & ~done).alias("remaining"), F.count_if(F.col("lead_score").isNull()).alias("never_scored"))


def distinct_names(rows: DataFrame, c: str) -> DataFrame:
    """Distinct values of a column in order, blanks left out."""
    return rows.filter(F.coalesce(c, F.lit("")) != "").select(c).distinct().orderBy(c)


def recent_activity(scored: DataFrame, as_of, minutes: int = 10) -> DataFrame:
    """Rescored within a window, those of them with evidence, and what waits for a score."""
    recent = F.coalesce(F.col("scored_at") >= as_of - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))
    return scored.agg(F.count_if(recent).alias("rescored"), F.count_if(recent & (F.col("confidence") != "unverified")).alias("verified_and_rescored"), F.count_if(F.col("scored_at").isNull()).alias("pending"))


def daily_target(ledger: DataFrame, platform: str, target: int) -> DataFrame:
    done = ledger.filter(F.col("platform") == platform).agg(F.countDistinct("business_id").alias("exported"))
    return done.select(F.lit(platform).alias("platform"), F.lit(target).alias("target"), "exported", F.greatest(F.lit(target) - F.col("exported"), F.lit(0)).alias("remaining"), (F.col("exported") >= target).alias("completed"))


def funnel(scored: DataFrame, ledger: DataFrame) -> DataFrame:
    """Five stages with the share of the stage before; null where a stage grows or follows none."""
    exported = ledger.select("business_id", F.lit(True).alias("_exported")).distinct()
    rows = scored.join(exported, "business_id", "left")
    none, seen = F.coalesce("website_url", F.lit("")) == "", F.col("confidence") != "unverified"
    sure = F.col("confidence").isin("high", "medium")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(none).alias("no_website"), F.count_if(none & seen).alias("verified"), F.count_if(none & sure).alias("confident"), F.count_if(F.coalesce("_exported", F.lit(False))).alias("exported"))
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(c).alias("name"), F.col(c).alias("n")) for k, c in enumerate(("total", "no_website", "verified", "confident", "exported"))])
    flat = counts.select(F.inline(stages))
    before = F.lag("n").over(Window.orderBy("stage"))  # five rows
    return flat.withColumn("conversion", F.when((before > 0) & (F.col("n") <= before), F.round(100 * F.col("n") / before, 2)))


def recent_jobs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("started_on"), F.desc("run_id")).limit(limit)


def metrics_report(
    businesses: DataFrame, verifications: DataFrame, scored: DataFrame, domains: DataFrame, ledger: DataFrame, contacts: DataFrame | None = None, contact_ledger: DataFrame | None = None, runs: DataFrame | None = None, recent: int = 10,
) -> DataFrame:
    """(``section``, ``key``, ``value``) of all counts.

    Contacts count by score, both ledgers by what is queued, and the last runs of jobs come with what
    each has processed (key: place, job, status, start) where their tables are given.
    """
    tall = lambda df, section, key, value: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("long").alias("value"))

    def wide(row: DataFrame, section: str) -> DataFrame:
        """A row of counts as one row each."""
        return row.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c in row.columns])))

    count = lambda rows, c: rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    split = conclusive_split(verifications)
    sections = [
        wide(business_totals(scored), "businesses"), tall(count(domains, "status"), "domains", "status", "n"), tall(coverage(verifications), "coverage", "source", "businesses"),
        tall(split, "conclusive", "source", "conclusive"), tall(split, "inconclusive", "source", "inconclusive"), tall(confidence_distribution(scored), "confidence", "confidence", "n"), tall(count(ledger, "platform"), "exports", "platform", "n"),
    ]
    if "status" in ledger.columns:
        sections.append(wide(export_totals(ledger), "business_exports"))
    if contacts is not None:
        sections.append(wide(contact_totals(contacts), "contacts"))
    if contact_ledger is not None:
        sections.append(wide(export_totals(contact_ledger), "contact_exports"))
    if runs is not None:
        last = recent_jobs(runs, recent)
        place = F.row_number().over(Window.orderBy(F.desc("started_on"), F.desc("run_id")))  # as many rows as are asked for
        sections.append(tall(last.withColumn("key", F.concat_ws("|", place.cast("string"), "job_name", "status", F.col("started_on").cast("string"))), "jobs", "key", "processed"))
    out = sections[0]
    for x in sections[1:]:
        out = out.unionByName(x)
    return out


def run_summary(stages: DataFrame) -> DataFrame:
    """Sums over the stages of a run."""
    return stages.agg(F.coalesce(F.sum("websites_found"), F.lit(0)).alias("websites_discovered"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))


