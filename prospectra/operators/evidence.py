"""Evidence that a business has, or has not, a website."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions import text as X

from .windows import keep_first

WEIGHT = "decimal(4,2)"


def weight() -> Column:
    """Weight of a row's ``result`` from its ``source``."""
    out = F.lit(V.UNLISTED_WEIGHT).cast(WEIGHT)
    for source, results in V.EVIDENCE_WEIGHTS.items():
        for result, w in results.items():
            out = F.when((F.col("source") == source) & (F.col("result") == result), F.lit(w).cast(WEIGHT)).otherwise(out)
    return out


def level(count: Column, total: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) == 0, "unverified").when(total >= 1.5, "high").when(total >= 0.7, "medium").otherwise("low")


def confidence(verifications: DataFrame) -> DataFrame:
    """Sources, their number, exact total weight and level of each business with evidence.

    Weights are decimals: sums of doubles would depend on their order near the levels' borders.
    """
    sources = F.sort_array(F.collect_set("source"))
    summed = verifications.groupBy("business_id").agg(F.size(sources).cast("long").alias("source_count"), F.sum(weight()).cast("decimal(8,2)").alias("weight"), sources.alias("sources"))
    return summed.withColumn("confidence", level(F.col("source_count"), F.col("weight")))


def business_confidence(businesses: DataFrame, verifications: DataFrame) -> DataFrame:
    found = confidence(verifications)
    return businesses.join(found, "business_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit("unverified")))


def unverified_by(businesses: DataFrame, verifications: DataFrame, source: str) -> DataFrame:
    """Businesses that a source has not yet looked at."""
    return businesses.join(verifications.filter(F.col("source") == source), "business_id", "left_anti")


def without_source(verifications: DataFrame, source: str) -> DataFrame:
    """Evidence with one source's taken back."""
    return verifications.filter(F.col("source") != source)


def first_results(results: DataFrame, most: int = 10) -> DataFrame:
    """At most so many results of a query, blank URLs dropped and a URL's first place kept."""
    some = results.filter((F.col("rank") <= most) & (F.coalesce("href", F.lit("")) != ""))
    return keep_first(some, ["business_id", "href"], "query_no", "rank")


def search_verdicts(businesses: DataFrame, results: DataFrame, most: int = 10) -> DataFrame:
    """``result`` and ``website`` of each business from its search results.

    A result whose domain holds the name wins; else a root page that shares two of its words, and
    60 % of them, with the name. Directories and mail providers never win. Earlier results first.
    """
    named = first_results(results, most).join(businesses.select("business_id", "name"), "business_id")
    host = X.url_host("href")
    words = X.name_words("name")
    shared = F.size(F.array_intersect(words, X.name_words(F.coalesce("title", F.lit("")))))
    strong = X.domain_holds_name(host, "name")
    titled = X.is_root_url("href") & (F.size(words) >= 2) & (shared >= 2) & (shared >= 0.6 * F.size(words))
    step = F.when(strong, 1).when(titled, 2)
    usable = ~X.is_directory_url("href") & ~host.isin(V.RESULT_MAIL_DOMAINS)
    site = F.when(X.is_root_url("href"), F.col("href")).otherwise(X.to_root_url("href"))
    judged = named.select("business_id", F.when(usable, step).alias("_step"), "query_no", "rank", F.when(step == 1, site).otherwise(F.col("href")).alias("_site"))
    best = judged.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.min_by(F.when(F.col("_step").isNotNull(), F.col("_site")), F.when(F.col("_step").isNotNull(), F.struct("_step", "query_no", "rank"))).alias("website"),
    )
    out = businesses.select("business_id").join(best, "business_id", "left")
    result = F.when(F.col("result_count").isNull(), "no_results").when(F.col("website").isNotNull(), "has_website").otherwise("no_website")
    return out.select("business_id", result.alias("result"), "website", F.coalesce("result_count", F.lit(0)).alias("result_count"))


def engine_coverage(results: DataFrame) -> DataFrame:
    """Distinct engines, results and results outside directories of each business."""
    return results.groupBy("business_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("engines")))).alias("engines"), F.count(F.lit(1)).alias("results"), F.count_if(~X.is_directory_url("href")).alias("outside_directories")
    )


def place_verdicts(businesses: DataFrame, places: DataFrame) -> DataFrame:
    """``result``, ``website`` and ``phone`` of each business from its first place."""
    first = places.filter("rank = 1").select("business_id", "place")
    rows = businesses.select("business_id", "name").join(first, "business_id", "left")
    place, site = F.col("place"), X.blank_to_null(F.col("place.website"))
    match = X.place_matches_name(place["name"], "name")
    result = F.when(place.isNull(), "no_match").when(~match, "poor_match").when(site.isNotNull(), "has_website").otherwise("no_website")
    phone = F.coalesce(X.blank_to_null(place["national_phone"]), X.blank_to_null(place["international_phone"]))
    return rows.select("business_id", result.alias("result"), F.when(match, site).alias("website"), F.when(match, phone).alias("phone"), F.when(match, place["rating"]).alias("rating"), F.when(match, place["review_count"]).alias("review_count"))


def judged_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts given elsewhere as JSON; a status that is not known means not sure."""
    v = F.from_json("verdict", "struct<status: string, website: string>")
    known = v["status"].isin("has_website", "no_website", "not_sure")
    result = F.when(known, v["status"]).otherwise("not_sure")
    return verdicts.select("business_id", result.alias("result"), F.when(result == "has_website", X.blank_to_null(v["website"])).alias("website"))


def found_emails(finder: DataFrame, leads: DataFrame, known: DataFrame, least: int = 50, least_score: int = 30) -> DataFrame:
    """New addresses for leads from the first of their non-public domains with a result."""
    asked = leads.filter((F.col("lead_score") >= least_score) & ~X.is_public_mail_domain("domain"))
    hits = keep_first(asked.join(finder.filter(F.size("emails") > 0), "domain"), ["business_id"], "domain")
    sure = hits.select("business_id", F.explode("emails").alias("e")).filter(F.coalesce("e.confidence", F.lit(0)) >= least)
    value = F.lower(F.trim("e.value"))
    new = sure.select("business_id", F.lit("email").alias("contact_type"), value.alias("value")).filter("value <> ''").distinct()
    return new.join(known, ["business_id", "contact_type", "value"], "left_anti")


def apply_websites(businesses: DataFrame, verifications: DataFrame) -> DataFrame:
    """Businesses with the website last found for those that have none; these lose their ``scored_at``, if there is one, and so are due for a score."""
    found = verifications.filter("website IS NOT NULL").groupBy("business_id").agg(F.max_by("website", F.struct("checked_at", "source")).alias("_found"))
    rows = businesses.join(found, "business_id", "left").withColumn("_given", X.blank_to_null("website_url"))
    rows = rows.withColumn("website_url", F.coalesce("_given", "_found"))
    if "scored_at" in businesses.columns:
        rows = rows.withColumn("scored_at", F.when(F.col("_given").isNotNull() | F.col("_found").isNull(), F.col("scored_at")))
    return rows.drop("_found", "_given")
