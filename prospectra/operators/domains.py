"""Domains: their status from what was observed, their links to businesses, their role contacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import text as X

from .windows import batch, keep_first, latest


def fold_record_checks(checks: DataFrame) -> DataFrame:
    """Flags of each domain from checks of single records (``host_kind`` apex or www, ``record``, ``found``, ``failed``, ``target``)."""
    seen = lambda record, apex=False: F.coalesce(F.bool_or(F.when((F.col("record") == record) & ((F.col("host_kind") == "apex") if apex else F.lit(True)), F.col("found"))), F.lit(False))
    return checks.groupBy("domain").agg(
        seen("A").alias("has_a"), seen("AAAA").alias("has_aaaa"), seen("CNAME").alias("has_cname"), seen("MX", True).alias("has_mx"), seen("NS", True).alias("has_ns"),
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("dns_error"), F.sort_array(F.collect_set("target")).alias("cname_targets"),
    )


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def domain_status() -> Column:
    serves = _true("has_a") | _true("has_aaaa") | _true("has_cname") | _true("has_http") | _true("has_tcp")
    return (
        F.when(_true("is_parked"), "parked").when(serves, "hosted").when(_true("has_mx"), "registered_no_web")
        .when(_true("has_ns"), "registered_dns_only").when(_true("dns_error"), "dns_error").otherwise("unregistered_candidate")
    )


def is_registered() -> Column:
    """True with any record; unknown without an RDAP answer or with 404; else true."""
    dns = _true("has_a") | _true("has_aaaa") | _true("has_cname") | _true("has_mx") | _true("has_ns")
    return F.when(dns, True).when(F.col("rdap_status").isNull() | (F.col("rdap_status") == 404), None).otherwise(True)


def classify_domains(observations: DataFrame, domains: DataFrame | None = None, statuses: list[str] | None = None) -> DataFrame:
    """New status of each observed domain, with its old one where ``domains`` has it."""
    seen = latest(observations, ["domain"], "observation").withColumns({"new_status": domain_status(), "is_registered": is_registered()})
    if domains is None:
        return seen
    chosen = domains.filter(F.col("status").isin(statuses)) if statuses else domains
    return chosen.join(seen, "domain", "left").withColumn("new_status", F.coalesce("new_status", F.lit("rdap_error"))).withColumn("changed", F.col("new_status") != F.col("status"))


def business_domains(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """(``business_id``, ``domain``, ``source``): the website's domain, and the addresses' but for public ones. The website wins a tie."""
    some = lambda domain: F.explode(F.array_compact(F.array(domain))).alias("domain")  # no row for null; a filter would work the domain out again
    site = businesses.select("business_id", some(X.normalize_domain("website_url")), F.lit("website").alias("source"))
    mail = contacts.filter("contact_type = 'email'").select("business_id", some(X.email_domain("value")), F.lit("email").alias("source"))
    both = site.unionByName(mail.filter(~X.is_public_mail_domain("domain")))
    return keep_first(both, ["business_id", "domain"], F.desc("source"))  # website after email


def sync_domains(businesses: DataFrame, contacts: DataFrame, domains: DataFrame, links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new domains, new links): what the businesses name and the tables do not hold. A new domain's id is a hash of its name, below zero.

    With ``keep``, which writes a table and reads it, what the businesses name is found once for both.
    """
    wanted = business_domains(businesses, contacts)
    wanted = keep(wanted, "wanted_domains") if keep else wanted
    new = wanted.select("domain").distinct().join(domains.select("domain"), "domain", "left_anti").withColumns({"status": F.lit("new"), "domain_id": -1 - F.pmod(F.xxhash64("domain"), F.lit((1 << 62) - 57))})
    return new, wanted.join(links.select("business_id", "domain"), ["business_id", "domain"], "left_anti")


def organizations_for(domains: DataFrame, organizations: DataFrame) -> DataFrame:
    """One organization for each domain: the one that is there (the smallest id of several), else a new one, with ``is_new``."""
    known = organizations.groupBy("domain_id").agg(F.min("org_id").alias("_known"))
    rows = domains.select("domain_id", "domain").join(known, "domain_id", "left")
    made = F.sha2(F.concat_ws("|", F.lit("organization"), "domain"), 256)
    return rows.select("domain_id", F.coalesce("_known", made).alias("org_id"), "domain", F.col("_known").isNull().alias("is_new"))


def role_contacts(domains: DataFrame, observations: DataFrame, known: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(domains with their next status, new role contacts) of domains that are verified without a host; with a limit so many of them, by name."""
    due = batch(domains.filter(F.col("status").isin("verified_unhosted", "checked")), [F.col("domain")], limit)
    seen = latest(observations, ["domain"], "observation").select("domain", "has_mx")
    rows = due.join(seen, "domain", "left")
    reachable = rows.filter(_true("has_mx"))
    made = reachable.select("domain_id", F.explode(X.role_emails("domain")).alias("email")).join(known.select("domain_id", "email"), ["domain_id", "email"], "left_anti")
    fresh = made.select("domain_id").distinct().withColumn("_new", F.lit(True))
    status = F.when(~_true("has_mx"), "mx_missing").when(_true("_new"), "enriched").otherwise("no_contacts")
    return rows.join(fresh, "domain_id", "left").select("domain_id", "domain", status.alias("status")), made.select("domain_id", "email", F.lit("role").alias("source"), F.lit("0.20").cast("decimal(4,2)").alias("confidence"))
