"""The engine's entities as derived from the driver's tables, each by a rule that any SQL engine can follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions.text import url_host

SEGMENT_CATEGORIES = {"MACHINERY": "trades", "BUILDING": "contractors", "FURNITURE": "retail", "AUTOMOBILE": "auto"}
EVENT_SOURCES = {"click": "domain_guess", "view": "searxng", "purchase": "llm", "signup": "ddg", "error": "google_search"}
STATUS_BY_PAGE = ["hosted", "parked", "registered_no_web", "new", "verified_unhosted"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(c: str, mapping: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in mapping.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def cities(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    country = F.when(F.col("n_nationkey") % 4 == 0, "AE").when(F.col("n_nationkey") % 4 == 1, "CA").when(F.col("n_nationkey") % 4 == 2, "US")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("name"), country.alias("country"), F.col("r_name").alias("region"))


def businesses(spark: SparkSession, d: str) -> DataFrame:
    """Customers; some are named like domains, some carry a brand, a fifth have a website."""
    i = F.col("c_custkey")
    name = F.when(i % 17 == 0, F.concat(F.lit("biz"), i.cast("string"), F.lit(".com"))).otherwise(F.col("c_name"))
    created = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("_first"))
    return table(spark, d, "customer").join(created, "c_custkey", "left").select(
        i.alias("business_id"), name.alias("name"), _by("c_mktsegment", SEGMENT_CATEGORIES, "other").alias("category"),
        F.when(i % 5 == 0, F.concat(F.lit("http://www.biz"), i.cast("string"), F.lit(".example.com/"))).alias("website_url"),
        F.when(i % 23 == 0, F.lit("Brand")).alias("brand"), F.col("c_nationkey").alias("city_id"),
        F.coalesce(F.to_date("_first"), F.lit("1992-01-01").cast("date")).alias("created_at"),
    )


def business_contacts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    email = F.when(i % 3 == 0, F.when(i % 6 == 0, F.concat(F.lit("owner"), i.cast("string"), F.lit("@gmail.com"))).otherwise(F.concat(F.lit("info@biz"), i.cast("string"), F.lit(".example.com"))))
    phone = F.when(i % 2 == 0, F.concat(F.lit("+1-555-"), i.cast("string")))
    both = F.array(F.struct(F.lit("email").alias("t"), email.alias("v")), F.struct(F.lit("phone").alias("t"), phone.alias("v")))
    return table(spark, d, "customer").select(i.alias("business_id"), F.explode(both).alias("c")).filter("c.v IS NOT NULL").select("business_id", F.col("c.t").alias("contact_type"), F.col("c.v").alias("value"))


def domains(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "pages").groupBy(url_host("url").alias("domain")).agg(F.min("page_id").alias("domain_id"))
    at = F.col("domain_id") % 8
    status = F.lit("unregistered_candidate")
    for k, s in enumerate(STATUS_BY_PAGE):
        status = F.when(at == k, s).otherwise(status)
    return first.select("domain_id", "domain", status.alias("status"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters of the businesses are linked to the domain of a page."""
    pages = table(spark, d, "pages")
    n = pages.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    some = table(spark, d, "customer").filter(F.col("c_custkey") % 4 != 0).withColumn("one", F.lit(1)).join(F.broadcast(n), "one")  # a single row
    hosts = pages.select("page_id", url_host("url").alias("domain")).join(domains(spark, d), "domain").select("page_id", "domain_id", "domain", "status")
    return some.select(F.col("c_custkey").alias("business_id"), (F.col("c_custkey") % F.col("n")).alias("page_id")).join(hosts, "page_id").select("business_id", "domain_id", "domain", "status")


def verifications(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and type as evidence of that type's source."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("checked_at"))
    result = F.when(F.col("value") < 10, "no_results").when(F.col("value") < 30, "no_website").when(F.col("value") < 60, "no_match").otherwise("has_website")
    return e.select(F.col("user_id").alias("business_id"), _by("event_type", EVENT_SOURCES, "foursquare").alias("source"), result.alias("result"), "checked_at")


def business_exports(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter(F.col("o_custkey") % 3 == 0)
    return o.groupBy(F.col("o_custkey").alias("business_id"), F.col("o_orderpriority").alias("platform")).agg(F.to_date(F.min("o_orderdate")).alias("exported_on"))


def job_runs(spark: SparkSession, d: str) -> DataFrame:
    status = _by("o_orderstatus", {"F": "success", "P": "running"}, "failed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("job_name"), status.alias("status"), F.to_date("o_orderdate").alias("started_on"), F.col("o_totalprice").alias("processed"))


def organizations(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the domains have an organization."""
    return domains(spark, d).filter("domain_id % 3 <> 0").select(F.concat(F.lit("org"), F.col("domain_id").cast("string")).alias("org_id"), "domain_id", F.concat(F.lit("Org "), "domain").alias("name"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """One observation for each page of a domain; which records it saw goes by the page's number."""
    i = F.col("page_id")
    return table(spark, d, "pages").select(
        url_host("url").alias("domain"), i.alias("observation"), (i % 5 == 0).alias("has_a"), (i % 11 == 0).alias("has_aaaa"), (i % 13 == 0).alias("has_cname"),
        (i % 3 == 0).alias("has_mx"), (i % 2 == 0).alias("has_ns"), (i % 7 == 0).alias("has_http"), (i % 17 == 0).alias("has_tcp"), (i % 19 == 0).alias("dns_error"),
        F.when(i % 4 == 0, 404).when(i % 4 == 1, 200).when(i % 4 == 2, 429).alias("rdap_status"), "html",
    )


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Five role addresses for each domain, as an enrichment leaves them."""
    from prospectra.functions.text import role_emails

    return domains(spark, d).select("domain_id", F.explode(role_emails("domain")).alias("email")).withColumn("source", F.lit("role"))
