"""Features and scores of businesses and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions import text as X

from .evidence import business_confidence
from .windows import keep_first


def contact_sets(contacts: DataFrame) -> DataFrame:
    """Addresses, those on a domain of the business's own, and phones of each business."""
    domain = X.email_domain("value")
    email, phone = F.col("contact_type") == "email", F.col("contact_type") == "phone"
    own = email & domain.isNotNull() & ~X.is_public_mail_domain(domain)
    as_set = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("value"))))
    return contacts.groupBy("business_id").agg(as_set(email).alias("emails"), as_set(own).alias("business_emails"), as_set(phone).alias("phones"))


def domain_sets(links: DataFrame) -> DataFrame:
    """Domains of each business by status; those of public mail providers do not count."""
    used = links.filter(~X.is_public_mail_domain("domain")).select("business_id", "domain", F.coalesce("status", F.lit("")).alias("status"))
    as_set = lambda statuses: F.sort_array(F.collect_set(F.when(F.col("status").isin(statuses), F.col("domain"))))
    return used.groupBy("business_id").agg(
        F.sort_array(F.collect_set("domain")).alias("domains"), as_set(V.VERIFIED_UNHOSTED).alias("verified_unhosted_domains"), as_set(V.UNREGISTERED).alias("unregistered_domains"),
        as_set(["hosted"]).alias("hosted_domains"), as_set(["parked"]).alias("parked_domains"), as_set(V.REGISTERED).alias("registered_domains"), as_set(V.UNKNOWN_STATUS).alias("unknown_domains"),
    )


def status_counts(links: DataFrame) -> DataFrame:
    """How many domains of each status a business has, as a map."""
    used = links.filter(~X.is_public_mail_domain("domain")).select("business_id", "domain", F.coalesce("status", F.lit("unknown")).alias("status")).distinct()
    each = used.groupBy("business_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("business_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("domain_status_counts"))


SETS = ["emails", "business_emails", "phones", "domains", "verified_unhosted_domains", "unregistered_domains", "hosted_domains", "parked_domains", "registered_domains", "unknown_domains"]


def business_features(businesses: DataFrame, contacts: DataFrame, links: DataFrame) -> DataFrame:
    joined = businesses.join(contact_sets(contacts), "business_id", "left").join(domain_sets(links), "business_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in SETS})


def _some(c: str) -> Column:
    return F.size(c) > 0


def score_businesses(businesses: DataFrame, contacts: DataFrame, links: DataFrame, verifications: DataFrame, branded: Column | None = None) -> DataFrame:
    """Score, reason, confidence and the facts behind them for each business."""
    return score_features(business_features(businesses, contacts, links), verifications, branded)


def score_features(features: DataFrame, verifications: DataFrame, branded: Column | None = None) -> DataFrame:
    """Scores of ``business_features``, which stay as they are while evidence is added.

    ``branded`` says whether a business belongs to a chain. A website, a chain and an active
    domain each make the score 0, in this order. Caps apply to what is left, the least of them wins.
    """
    f = business_confidence(features, verifications)
    chain = F.coalesce(branded if branded is not None else F.lit(False), F.lit(False))
    has_site = X.blank_to_null("website_url").isNotNull()
    active = _some("hosted_domains") | _some("parked_domains") | _some("registered_domains")
    domainish = X.looks_like_domain("name")
    no_contact = ~_some("emails") & ~_some("phones")
    category = F.trim(F.coalesce("category", F.lit("")))
    total = (
        F.lit(25)
        + F.when(_some("business_emails"), 20).when(_some("emails"), 5).otherwise(0)
        + F.when(_some("phones"), 15).otherwise(0)
        + F.when(category.isin(V.HIGH_CATEGORIES), 20).when(category.isin(V.MEDIUM_CATEGORIES), 10).when(category != "", 5).otherwise(0)
    )
    caps = [
        F.when(_some("unknown_domains"), 10), F.when(domainish, 15), F.when(no_contact, 5),
        F.when(F.col("confidence") == "unverified", 35).when(F.col("confidence") == "low", 50), F.lit(100),
    ]
    capped = F.least(total, *caps)  # null caps do not count
    score = F.when(has_site | chain | active, 0).otherwise(capped).cast("decimal(6,2)")
    reason = F.when(has_site, "has_website").when(chain, "branded_chain").when(active, "active_domain").when(no_contact, "no_contacts").when(domainish, "name_is_domain")
    return f.withColumns({
        "lead_score": score, "reason": reason, "is_branded_chain": chain, "name_looks_like_domain": domainish, "has_email": _some("emails"), "has_business_email": _some("business_emails"),
        "has_phone": _some("phones"), "has_active_domain": active,
    })


def score_reasons() -> Column:
    """The facts behind a scored business as one struct."""
    facts = ["category", "has_email", "has_business_email", "has_phone", "has_active_domain", "reason", "is_branded_chain", "name_looks_like_domain", "confidence", *SETS[3:]]
    counts = [F.size(c).alias(c[:-1] + "_count") for c in ("domains", "verified_unhosted_domains", "unregistered_domains", "registered_domains", "unknown_domains")]
    return F.struct(*facts, *counts).alias("score_reasons")


def stale(scored: DataFrame, contacts: DataFrame, links: DataFrame, domains: DataFrame, verifications: DataFrame | None = None) -> DataFrame:
    """Businesses never scored, or with a contact, link, domain or evidence newer than their score."""
    newest = [contacts.select("business_id", F.col("created_at").alias("at")), links.select("business_id", F.col("created_at").alias("at"))]
    newest.append(links.select("business_id", "domain_id").join(domains.select("domain_id", F.col("updated_at").alias("at")), "domain_id").select("business_id", "at"))
    if verifications is not None:
        newest.append(verifications.select("business_id", F.col("checked_at").alias("at")))
    seen = newest[0]
    for x in newest[1:]:
        seen = seen.unionByName(x)
    last = seen.groupBy("business_id").agg(F.max("at").alias("_last"))
    return scored.join(last, "business_id", "left").filter(F.col("scored_at").isNull() | (F.col("_last") > F.col("scored_at"))).drop("_last")


def contact_features(links: DataFrame, businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """What the businesses of a domain say about its contacts."""
    phones = contacts.filter("contact_type = 'phone'").select("business_id", F.lit(True).alias("_phone")).distinct()
    rows = links.select("domain_id", "business_id").distinct().join(businesses.select("business_id", "category", "website_url"), "business_id").join(phones, "business_id", "left")
    return rows.groupBy("domain_id").agg(
        F.sort_array(F.collect_set(F.nullif(F.col("category"), F.lit("")))).alias("categories"),
        F.bool_or(F.coalesce("website_url", F.lit("")) == "").alias("has_no_website_business"),
        F.bool_or(F.coalesce("_phone", F.lit(False))).alias("has_phone"),
    )


def score_contacts(contacts: DataFrame, domains: DataFrame, features: DataFrame) -> DataFrame:
    """Score of each contact from its address, its domain's status and the domain's businesses."""
    rows = contacts.join(domains.select("domain_id", "domain", "status"), "domain_id").join(features, "domain_id", "left")
    any_of = lambda values: F.coalesce(F.arrays_overlap("categories", X.words_array(values)), F.lit(False))
    status = F.col("status")
    total = (
        F.when(F.col("source") == "role", 10).otherwise(0)
        + F.when(X.role_prefix("email").isNotNull(), 10).otherwise(0)
        + F.when(status.isin("verified_unhosted", "enriched"), 20).when(status.isin("checked", "mx_missing", "no_mx"), 15).when(status == "unregistered_candidate", 10).otherwise(0)
        + F.when(F.coalesce("has_no_website_business", F.lit(False)), 25).otherwise(0)
        + F.when(F.coalesce("has_phone", F.lit(False)), 20).otherwise(0)
        + F.when(any_of(V.HIGH_CATEGORIES), 25).when(any_of(V.MEDIUM_CATEGORIES), 10).when(F.size("categories") > 0, 5).otherwise(0)
    )
    out = status.isin("hosted", "parked")
    return rows.withColumns({"lead_score": F.when(out, 0).otherwise(F.least(total, F.lit(100))).cast("decimal(6,2)"), "disqualified": out})


#: The set that holds a domain by its status, besides ``domains``.
STATUS_SETS = {
    "verified_unhosted_domains": V.VERIFIED_UNHOSTED, "unregistered_domains": V.UNREGISTERED, "hosted_domains": ["hosted"], "parked_domains": ["parked"],
    "registered_domains": V.REGISTERED, "unknown_domains": V.UNKNOWN_STATUS,
}


def feature_changes(contact_changes: DataFrame, link_changes: DataFrame, domain_changes: DataFrame, links: DataFrame) -> DataFrame:
    """(``business_id``, ``set``, ``value``, ``added``): what changes do to the sets of the businesses that they touch.

    ``contact_changes`` have ``business_id``, ``contact_type``, ``value``, ``link_changes`` a
    ``business_id``, ``domain`` and ``status``, ``domain_changes`` a ``domain`` and its new ``status``; the first two
    have ``added`` (false: removed) and all a ``change`` number: of changes to one thing the last
    counts. ``links`` are those before the changes; domains that change reach businesses by them
    and by the links that come in.
    """
    last = lambda rows, *keys: keep_first(rows, list(keys), F.desc("change"))
    c = last(contact_changes, "business_id", "contact_type", "value")
    mail, own = F.col("contact_type") == "email", X.email_domain("value")
    sets = F.array_compact(F.array(F.when(mail, "emails"), F.when(mail & own.isNotNull() & ~X.is_public_mail_domain(own), "business_emails"), F.when(F.col("contact_type") == "phone", "phones")))
    contacts = c.select("business_id", F.explode(sets).alias("set"), "value", "added")
    usable = ~X.is_public_mail_domain("domain")
    changed = last(domain_changes, "domain").select("domain", F.col("status").alias("_now"))
    linked = last(link_changes, "business_id", "domain")
    # links that stay, of domains that change, are as if they came in anew
    moved = links.select("business_id", "domain", "status").join(changed.select("domain"), "domain", "left_semi").join(linked, ["business_id", "domain"], "left_anti").withColumn("added", F.lit(True))
    d = linked.select("business_id", "domain", "status", "added").unionByName(moved).filter(usable).join(changed, "domain", "left").withColumn("status", F.coalesce("_now", "status", F.lit("")))
    named = [F.struct(F.lit("domains").alias("set"), F.col("added"))]
    named += [F.struct(F.lit(name).alias("set"), (F.col("added") & F.col("status").isin(statuses)).alias("added")) for name, statuses in STATUS_SETS.items()]
    domains = d.select("business_id", F.col("domain").alias("value"), F.explode(F.array(*named)).alias("x")).select("business_id", "x.set", "value", "x.added")
    return contacts.unionByName(domains).distinct()


def changed_features(features: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of ``features`` that changes touch, with their sets after them; a business without a row starts from empty sets.

    No contact, link or domain is read again: each set loses what has been removed and gains what
    has been added.
    """
    pick = lambda c, added: F.collect_set(F.when((F.col("set") == c) & (F.col("added") if added else ~F.col("added")), F.col("value")))
    delta = changes.groupBy("business_id").agg(*[pick(c, True).alias(f"_add_{c}") for c in SETS], *[pick(c, False).alias(f"_cut_{c}") for c in SETS])
    rows = delta.join(features.select("business_id", *SETS), "business_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("business_id", *[F.sort_array(F.array_union(F.array_except(F.coalesce(F.col(c), none), F.col(f"_cut_{c}")), F.col(f"_add_{c}"))).alias(c) for c in SETS])
