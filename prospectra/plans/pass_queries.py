"""A whole pass over the driver's tables with every input present, and the SQL to hold it against."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.operators import leads as L
from prospectra.sources import entities as N

from . import passes
from .more_queries import CHECKED, _branded, _observed
from .oracle import ENTITIES, public, quoted
from .queries import _int, _search_results, query


def _inputs(spark, d) -> dict:
    """What fetchers have left: parts as elements, long second words as chains, and rows for some customers in each layer."""
    parts, customers = N.table(spark, d, "part"), N.table(spark, d, "customer").select(F.col("c_custkey").alias("business_id"))
    i, text = F.col("business_id"), lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    key = F.col("p_partkey").cast("string")
    tags = F.create_map(F.lit("name"), F.col("p_name"), F.lit("craft"), F.lit("smith"), F.lit("phone"), text("+1 ", key))
    elements = parts.filter("p_partkey % 10 = 0").select(
        F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.lit(25.0).alias("lat"), F.lit(55.0).alias("lon"), F.lit(None).cast("struct<lat: double, lon: double>").alias("center"), tags.alias("tags")
    )
    words = F.split("p_name", " ")
    names = parts.select("p_name", words[0].alias("a"), words[1].alias("b")).distinct()
    body = F.concat(F.lit("<html><head><title>"), "p_name", F.lit(" shop</title></head><body>"), F.repeat(F.lit("filler "), 100), F.lit("</body></html>"))
    pages = names.filter("b = 'widget'").select(F.concat(F.lit("https://"), "a", "b", F.lit(".com/")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status_code"), body.alias("html"))
    place = lambda name, site, phone: F.struct(
        name.alias("name"), site.cast("string").alias("website"), phone.cast("string").alias("national_phone"), F.lit(None).cast("string").alias("international_phone"), F.lit(4.0).alias("rating"), F.lit(1).alias("review_count")
    )
    named = N.businesses(spark, d).filter("business_id % 7 = 0").select("business_id", "name")
    places = named.select("business_id", F.lit(1).alias("rank"), place(F.col("name"), F.when(i % 14 == 0, text("http://place", i.cast("string"), ".example/")), text("+9 ", i.cast("string"))).alias("place"))
    more_places = customers.filter("business_id % 6 = 1").select("business_id", F.lit(1).alias("rank"), place(F.lit("Elsewhere"), F.lit(None), F.lit(None)).alias("place"))
    href = F.when(i % 8 == 1, text("http://customer", F.lpad(i.cast("string"), 9, "0"), ".com/")).otherwise(text("http://elsewhere", i.cast("string"), ".net/"))
    more_results = customers.filter("business_id % 4 = 1").select("business_id", F.lit(1).alias("query_no"), F.lit(1).alias("rank"), href.alias("href"), F.lit("").alias("title"))
    verdict = F.to_json(F.struct(F.when(i % 15 == 2, "has_website").otherwise("no_website").alias("status"), text("http://llm", i.cast("string"), "/").alias("website")))
    judged = customers.filter("business_id % 5 = 2").select("business_id", verdict.alias("verdict"))
    chains = names.filter("length(b) = 5").select(F.lower("b").alias("chain")).distinct()
    return {"elements": elements, "pages": pages, "places": places, "more_places": more_places, "results": _search_results(spark, d)[1], "more_results": more_results, "judged": judged, "chains": chains}


def _whole_pass(spark, d):
    """One pass over the driver's tables; role contacts of every third domain are there already."""
    known = N.contacts(spark, d).filter("domain_id % 3 = 0").select("domain_id", "email", "source")
    none = spark.createDataFrame([], "contact_id string, platform string")
    return passes.one_pass(
        N.businesses(spark, d), N.business_contacts(spark, d), N.domains(spark, d), N.links(spark, d), _observed(spark, d), N.verifications(spark, d), known, N.organizations(spark, d),
        N.business_exports(spark, d), none, at=F.lit("1998-01-01").cast("timestamp_ntz"), platform="1-URGENT", limit=100, branded=_branded(), **_inputs(spark, d),
    )


def _scored_from(suffix: str, businesses: str, verifications: str) -> dict[str, str]:
    """The entities from evidence to scores over other tables, under names with a suffix."""
    features = ENTITIES["features"].replace("FROM businesses b", f"FROM {businesses} b").replace("LEFT JOIN confidence USING", f"LEFT JOIN confidence{suffix} USING")
    return {
        f"confidence{suffix}": ENTITIES["confidence"].replace("FROM verifications", f"FROM {verifications}"), f"features{suffix}": features,
        f"scored{suffix}": ENTITIES["scored"].replace("FROM features", f"FROM features{suffix}"),
    }


#: Of each layer in its order: which businesses its fetcher has rows of, the result and the website.
_LAYERS = {
    "domain_guess": ("TRUE", "CASE WHEN split_part(name, ' ', 2) = 'widget' THEN 'has_website' ELSE 'no_match' END", "CASE WHEN split_part(name, ' ', 2) = 'widget' THEN 'https://' || replace(name, ' ', '') || '.com/' END"),
    "ddg": ("business_id IN (SELECT page_id FROM pages)", "'no_website'", "NULL"),
    "google_search": (
        "business_id >= 0 AND business_id % 4 = 1", "CASE WHEN business_id % 8 = 1 AND business_id % 17 <> 0 THEN 'has_website' ELSE 'no_website' END",
        "CASE WHEN business_id % 8 = 1 AND business_id % 17 <> 0 THEN 'http://customer' || lpad(CAST(business_id AS VARCHAR), 9, '0') || '.com/' END",
    ),
    "llm": ("business_id >= 0 AND business_id % 5 = 2", "CASE WHEN business_id % 15 = 2 THEN 'has_website' ELSE 'no_website' END", "CASE WHEN business_id % 15 = 2 THEN 'http://llm' || business_id || '/' END"),
    "google_places": ("business_id >= 0 AND business_id % 7 = 0", "CASE WHEN business_id % 14 = 0 THEN 'has_website' ELSE 'no_website' END", "CASE WHEN business_id % 14 = 0 THEN 'http://place' || business_id || '.example/' END"),
    "foursquare": ("business_id >= 0 AND business_id % 6 = 1", "'poor_match'", "NULL"),
}

#: Imported parts have ids below zero, by their keys; the queries name them by their source.
PASSED = CHECKED | {
    "old_businesses": ENTITIES["businesses"],
    "businesses": """SELECT business_id, name, category, website_url, brand, city_id, created_at FROM old_businesses
        UNION ALL SELECT -1 - p_partkey, p_name, 'trades', NULL, CASE WHEN length(split_part(p_name, ' ', 2)) = 5 THEN 'Chain' END, NULL, NULL FROM part WHERE p_partkey % 10 = 0""",
    "old_contacts": ENTITIES["contacts"],
    "contacts": """SELECT business_id, contact_type, value FROM old_contacts UNION ALL SELECT -1 - p_partkey, 'phone', '+1 ' || p_partkey FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT c_custkey, 'phone', '+9 ' || c_custkey FROM customer WHERE c_custkey % 7 = 0""",
    "enriched": """SELECT domain, CASE WHEN status = 'verified_unhosted' THEN CASE WHEN p % 3 <> 0 OR p IS NULL THEN 'mx_missing' WHEN (SELECT min(domain_id) FROM domains x WHERE x.domain = c.domain) % 3 = 0 THEN 'no_contacts' ELSE 'enriched' END ELSE status END AS status
        FROM checked c LEFT JOIN seen USING (domain)""",
    "links": CHECKED["links"].replace("JOIN checked", "JOIN enriched"),
    **_scored_from("_before", "businesses", "verifications"),
    "layer_0": "SELECT business_id, source, result, CAST(NULL AS VARCHAR) AS website FROM verifications",
    **{
        f"layer_{k}": f"""SELECT * FROM layer_{k - 1} UNION ALL SELECT business_id, '{layer}', {result}, {site} FROM scored_before
            WHERE coalesce(website_url, '') = '' AND lead_score >= {passes.LAYERS[layer]} AND ({asked}) AND business_id NOT IN (SELECT business_id FROM layer_{k - 1} WHERE source = '{layer}' OR website IS NOT NULL)"""
        for k, (layer, (asked, result, site)) in enumerate(_LAYERS.items(), 1)
    },
    "with_sites": "SELECT * REPLACE (coalesce(website_url, (SELECT max(website) FROM layer_6 v WHERE v.business_id = businesses.business_id)) AS website_url) FROM businesses",
    **_scored_from("_after", "with_sites", "layer_6"),
}

KEY = "CASE WHEN business_id < 0 THEN 'node/' || (-1 - business_id) ELSE CAST(business_id AS VARCHAR) END AS business"


@query(f"SELECT {KEY}, lead_score, confidence, reason FROM scored_after", **PASSED)
def one_pass(spark, d):
    key = F.coalesce("source_id", F.col("business_id").cast("string")).alias("business")
    return _whole_pass(spark, d)["scored"].select(key, _int("lead_score"), "confidence", "reason")


@query(f"SELECT {KEY}, source, result, website FROM layer_6", **PASSED)
def one_pass_evidence(spark, d):
    """Evidence after six layers, each asked only about what those before it have left open."""
    out = _whole_pass(spark, d)
    names = out["businesses"].select("business_id", F.coalesce("source_id", F.col("business_id").cast("string")).alias("business"))
    return out["verifications"].join(names, "business_id", "left").select(F.coalesce("business", F.col("business_id").cast("string")).alias("business"), "source", "result", "website")


@query(
    f"""SELECT business_id FROM scored_after s WHERE website_url IS NULL AND business_id NOT IN (SELECT business_id FROM exports WHERE platform = '1-URGENT') AND n_emails + n_phones > 0
    AND NOT EXISTS (SELECT 1 FROM links l WHERE l.business_id = s.business_id AND status IN ({quoted(L.ACTIVE)}) AND NOT {public("domain")})
    AND EXISTS (SELECT 1 FROM links l WHERE l.business_id = s.business_id AND status IN ({quoted(L.QUALIFIED)}) AND NOT {public("domain")}) ORDER BY lead_score DESC, created_at, business_id LIMIT 100""",
    **PASSED,
)
def one_pass_export(spark, d):
    """Leads of a pass under the rules of an export: a contact, no active domain, a qualified one."""
    return _whole_pass(spark, d)["ledger"].select("business_id")


@query("SELECT domain_id, email FROM role_contacts JOIN domains USING (domain_id) JOIN enriched USING (domain) WHERE enriched.status = 'enriched'", **PASSED)
def one_pass_contacts(spark, d):
    return _whole_pass(spark, d)["contact_export"].select("domain_id", "email")


@query(
    """SELECT domain, coalesce(org_id, sha256('organization|' || domain)) AS org_id, org_id IS NULL AS is_new FROM enriched LEFT JOIN (SELECT domain, org_id FROM organizations JOIN domains USING (domain_id)) USING (domain)
    WHERE org_id IS NOT NULL OR (enriched.status IN ('enriched', 'no_contacts') AND domain IN (SELECT domain FROM checked WHERE status = 'verified_unhosted'))""",
    **PASSED,
)
def one_pass_organizations(spark, d):
    """Organizations after a pass: those that were there, and new ones only for domains that were due and receive mail."""
    out = _whole_pass(spark, d)
    new = F.col("domain").isNotNull()
    names = out["domains"].select("domain_id", F.col("domain").alias("name_"))
    return out["organizations"].join(names, "domain_id").select(F.col("name_").alias("domain"), "org_id", new.alias("is_new"))
