"""Lead queries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.functions import text as X

from .windows import batch, page

ACTIVE = ["hosted", "parked", "registered_no_web", "registered_dns_only", "mx_missing"]
QUALIFIED = ["verified_unhosted", "checked", "no_mx", "enriched", "no_contacts", "unregistered_candidate"]


def with_contact(rows: DataFrame, contacts: DataFrame, kind: str | None = None) -> DataFrame:
    return rows.join(contacts.filter(F.col("contact_type") == kind) if kind else contacts, "business_id", "left_semi")


def without_contact(rows: DataFrame, contacts: DataFrame, kind: str | None = None) -> DataFrame:
    return rows.join(contacts.filter(F.col("contact_type") == kind) if kind else contacts, "business_id", "left_anti")


def _own(links: DataFrame, statuses: list[str]) -> DataFrame:
    return links.filter(F.col("status").isin(statuses) & ~X.is_public_mail_domain("domain"))


def with_domain_status(rows: DataFrame, links: DataFrame, statuses: list[str]) -> DataFrame:
    return rows.join(_own(links, statuses), "business_id", "left_semi")


def without_domain_status(rows: DataFrame, links: DataFrame, statuses: list[str]) -> DataFrame:
    return rows.join(_own(links, statuses), "business_id", "left_anti")


def unexported(rows: DataFrame, ledger: DataFrame, platform: str | None = None) -> DataFrame:
    """Rows not exported on a platform, or on none at all."""
    return rows.join(ledger.filter(F.col("platform") == platform) if platform else ledger, "business_id", "left_anti")


def best_first() -> list[Column]:
    return [F.desc_nulls_last("lead_score"), F.col("created_at"), F.col("business_id")]


def eligible_leads(
    scored: DataFrame, contacts: DataFrame, links: DataFrame, ledger: DataFrame | None = None, *, platform: str | None = None, min_score: float | None = None, no_website: bool = True,
    category: str | None = None, city: str | None = None, require_contact: bool = False, exclude_active: bool = False, require_qualified: bool = False, min_confidence: str | None = None,
    verified_only: bool = False, cities: DataFrame | None = None,
) -> DataFrame:
    """Leads that meet every condition. All of them come before a limit, confidence too.

    ``city`` is a part of the city's name in any case, looked up in ``cities`` by ``city_id`` or, without
    them, in the leads' own ``city``; its ``%`` and ``_`` are wildcards.
    """
    rows = scored.filter(F.col("lead_score").isNotNull())
    if no_website:
        rows = rows.filter(F.coalesce("website_url", F.lit("")) == "")
    if min_score is not None:
        rows = rows.filter(F.col("lead_score") >= min_score)
    if category:
        rows = rows.filter(F.col("category") == category)
    if city:
        named = lambda c: F.col(c).ilike(f"%{city}%")
        rows = rows.filter(named("city")) if cities is None else rows.join(cities.filter(named("name")), "city_id", "left_semi")
    if min_confidence or verified_only:
        rows = rows.filter(X.confidence_rank("confidence") >= X.confidence_rank(F.lit(min_confidence or "low")))
    if require_contact:
        rows = with_contact(rows, contacts)
    if exclude_active:
        rows = without_domain_status(rows, links, ACTIVE)
    if require_qualified:
        rows = with_domain_status(without_domain_status(rows, links, ["hosted", "parked"]), links, QUALIFIED)
    if ledger is not None:
        rows = unexported(rows, ledger, platform)
    return rows


def page_with_total(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of leads, best first, with ``total``: how many there are on all pages."""
    out = page(rows, best_first(), limit, offset).withColumn("_one", F.lit(1))
    return out.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row


def lead_export(leads: DataFrame, ledger: DataFrame, platform: str, day: Column, limit: int | None = None, fresh_only: bool = False, max_written: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to write, ledger rows): the best leads not yet exported on the platform, or with ``fresh_only`` on any.

    A ``limit`` under one is none; ``max_written`` bounds the rows besides, and zero or less writes none.
    """
    rows = unexported(leads, ledger, None if fresh_only else platform).orderBy(*best_first())
    rows = rows.limit(limit) if limit is not None and limit > 0 else rows
    rows = rows.limit(max(0, max_written)) if max_written is not None else rows
    return rows, rows.select("business_id", F.lit(platform).alias("platform"), day.alias("exported_on"), F.lit("queued").alias("status"))


def daily_fill(leads: DataFrame, ledger: DataFrame, platform: str, target: int, recycle: bool = True) -> DataFrame:
    """The leads that fill a day's platform up to its target: never exported ones first, then, if allowed, others.

    The rank needs no pass over all rows in one place: each half is a top-k, and what is left to
    fill is one number joined to it.
    """
    done = ledger.filter(F.col("platform") == platform)
    left = done.agg(F.greatest(F.lit(target) - F.countDistinct("business_id"), F.lit(0)).alias("_left")).withColumn("_one", F.lit(1))
    ever = ledger.select("business_id", F.lit(1).alias("_before")).distinct()
    rows = unexported(leads, ledger, platform).join(ever, "business_id", "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    if not recycle:
        rows = rows.filter("_before = 0")
    order = [F.col("_before"), *best_first()]
    top = rows.orderBy(*order).limit(target)
    ranked = top.withColumn("fill_rank", F.row_number().over(Window.orderBy(*order)))  # at most the target's rows
    return ranked.withColumn("_one", F.lit(1)).join(F.broadcast(left), "_one").filter(F.col("fill_rank") <= F.col("_left")).withColumn("recycled", F.col("_before") == 1).drop("_before", "_left", "_one")


def contact_export(contacts: DataFrame, domains: DataFrame, ledger: DataFrame, platform: str, min_score: float | None = None, limit: int | None = None) -> DataFrame:
    """Contacts of enriched domains that the platform does not have; with a limit the best of them, by id where they tie."""
    rows = contacts.join(domains.filter("status = 'enriched'").select("domain_id", "domain"), "domain_id")
    if min_score is not None:
        rows = rows.filter(F.col("lead_score") >= min_score)
    rows = rows.join(ledger.filter(F.col("platform") == platform), "contact_id", "left_anti")
    return batch(rows, [F.desc_nulls_last("lead_score"), F.col("contact_id")], limit)


def joined(c: str, separator: str = ";") -> Column:
    return F.array_join(F.sort_array(F.coalesce(F.col(c), F.array().cast("array<string>"))), separator)


def _text(c: str | Column, name: str | None = None) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")).alias(name or c)


def lead_sheet(leads: DataFrame, separator: str = ";") -> DataFrame:
    """The 19 columns of the export; sets as sorted text, nulls as empty."""
    rows = leads.withColumn("free_emails", F.array_except("emails", "business_emails"))
    sets = [
        "emails", "business_emails", "free_emails", "phones", "domains", "verified_unhosted_domains", "unregistered_domains", "registered_domains", "unknown_domains", "hosted_domains", "parked_domains",
    ]
    return rows.select(
        _text("name", "business_name"), *[_text(c) for c in ("category", "address", "city", "country")], *[joined(c, separator).alias(c) for c in sets], _text("lead_score"), _text("source"), _text("source_id"),
    )


def refreshed_sheet(leads: DataFrame) -> DataFrame:
    """The 12 columns of the sheet that is written anew each time."""
    sets = {"Emails": "emails", "Business Emails": "business_emails", "Phones": "phones", "Domains": "domains", "Hosted Domains": "hosted_domains", "Registered Domains": "registered_domains"}
    plain = {"Name": "name", "Category": "category", "Address": "address", "City": "city", "Country": "country"}
    return leads.select(*[_text(c, name) for name, c in plain.items()], F.coalesce("lead_score", F.lit(0)).alias("Lead Score"), *[joined(c, ", ").alias(name) for name, c in sets.items()])


def contact_sheet(contacts: DataFrame) -> DataFrame:
    """The 8 columns of the contact export, nulls as empty."""
    return contacts.select(*[_text(c) for c in ("domain", "organization", "email", "first_name", "last_name", "title", "source", "lead_score")])


def no_website_sheet(businesses: DataFrame, contacts: DataFrame, cities: DataFrame) -> DataFrame:
    """The 11 columns of businesses without a website; phones and addresses in order of entry, nulls as empty, a zero coordinate too."""
    in_order = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("contact_type") == kind) & (F.col("value") != ""), F.struct("contact_id", "value")))), lambda x: x["value"]), ";")
    lists = contacts.groupBy("business_id").agg(in_order("phone").alias("phone"), in_order("email").alias("email"))
    places = cities.select("city_id", F.col("name").alias("city"), "country")
    rows = businesses.filter(F.coalesce("website_url", F.lit("")) == "").join(lists, "business_id", "left").join(places, "city_id", "left")
    at = lambda c: _text(F.when(F.col(c) != 0, F.col(c)), c)
    return rows.select(*[_text(c) for c in ("name", "category", "address", "city", "country", "phone", "email")], at("lat"), at("lon"), _text("source"), _text("source_id"))
