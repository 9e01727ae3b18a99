"""The registered queries of the lead engine and the SQL to hold each against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions import text as X
from prospectra.operators import domains as D
from prospectra.operators import evidence as E
from prospectra.operators import joins as J
from prospectra.operators import leads as L
from prospectra.operators import metrics as M
from prospectra.operators import scoring as S
from prospectra.operators import sites
from prospectra.operators import windows as W
from prospectra.sources import entities as N
from prospectra.sources import poi as P

from .oracle import CANDIDATES, OWNERSHIP, TITLE, host, public, quoted, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, **parts: str):
    """Register a query under its function's name, with SQL over the entities if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **parts)
        return f

    return add


def scored(spark: SparkSession, d: str) -> DataFrame:
    """All businesses of the driver's tables with score, reason and confidence."""
    return S.score_businesses(N.businesses(spark, d), N.business_contacts(spark, d), N.links(spark, d), N.verifications(spark, d), F.col("brand").isNotNull())


def _int(c: str) -> Column:
    return F.col(c).cast("int").alias(c)


def _csv(c: str, sep: str = ",") -> Column:
    return F.array_join(c, sep).alias(c)


# --- windows, scans, scalars


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def scan_dedup_first(spark, d):
    return W.keep_first(N.table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query(f"SELECT {host('url')} AS domain, max(page_id) AS observation FROM pages GROUP BY 1")
def latest_observation(spark, d):
    return W.latest(N.observations(spark, d).drop("html"), ["domain"], "observation").select("domain", "observation")


@query(r"""SELECT page_id, CASE WHEN h LIKE '%.%' AND NOT regexp_matches(h, '\s') THEN h END AS domain FROM (
    SELECT page_id, split_part(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '\.+$', ''), '^www\.', ''), ':', 1) AS h FROM pages)""")
def normalize_domain(spark, d):
    return N.table(spark, d, "pages").select("page_id", X.normalize_domain("url").alias("domain"))


@query(f"SELECT business_id, value, {public(chr(39).join(['split_part(value, ', '@', ', 2)']))} AS is_public FROM contacts WHERE contact_type = 'email'")
def public_email_filter(spark, d):
    mail = N.business_contacts(spark, d).filter("contact_type = 'email'")
    return mail.select("business_id", "value", X.is_public_mail_domain(X.email_domain("value")).alias("is_public"))


@query("SELECT business_id, name FROM businesses WHERE coalesce(website_url, '') = ''")
def no_website_filter(spark, d):
    return N.businesses(spark, d).filter(F.coalesce("website_url", F.lit("")) == "").select("business_id", "name")


def _part_tags(spark, d) -> DataFrame:
    """Parts as tagged places: the second word of the name is a shop, craft, office or amenity by the part's size."""
    kind = F.col("p_size") % 5
    word = F.element_at(F.split("p_name", " "), -1)
    key = F.when(kind == 0, "craft").when(kind == 1, "shop").when(kind == 2, "office").when(kind == 3, "tourism").otherwise("amenity")
    value = F.when(kind == 4, F.when(F.col("p_partkey") % 2 == 0, "cafe").otherwise("bank")).otherwise(word)
    return N.table(spark, d, "part").select("p_partkey", F.create_map(F.lit("name"), F.col("p_name"), key, value).alias("tags"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'trades' WHEN 1 THEN 'retail' WHEN 2 THEN 'professional_services' WHEN 3 THEN 'hospitality'
    ELSE CASE WHEN p_partkey % 2 = 0 THEN 'food' ELSE 'finance' END END AS category FROM part""")
def category_map(spark, d):
    return _part_tags(spark, d).select("p_partkey", P.classify().alias("category"))


@query("SELECT business_id FROM features WHERE domainish")
def name_like_domain(spark, d):
    return N.businesses(spark, d).filter(X.looks_like_domain("name")).select("business_id")


@query("""SELECT DISTINCT p_name AS name, chain FROM part, (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS chain FROM part WHERE length(split_part(p_name, ' ', 2)) >= 4)
    WHERE contains(lower(p_name), chain)""")
def brand_chain_join(spark, d):
    parts = N.table(spark, d, "part").select(F.col("p_name").alias("name"))
    chains = J.chain_names(parts.select(F.element_at(F.split("name", " "), 2).alias("name"))).filter(F.length("chain") >= 4)
    return J.names_with_chain(parts, chains)


@query(f"""SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract({host("url")}, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS dom FROM pages WHERE page_id % 9 = 0) l
    WHERE dom <> '' AND ({host("url")} = dom OR ends_with({host("url")}, '.' || dom)))""")
def directory_suffix_join(spark, d):
    pages = N.table(spark, d, "pages").select("page_id", "url")
    listed = pages.filter("page_id % 9 = 0").select(F.regexp_extract(X.url_host("url"), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).filter("domain <> ''").distinct()
    return J.under_domains(pages, "url", listed).select("page_id")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN page_id % 14 = 0 ELSE page_id % 10 = 0 OR regexp_matches(lower(html[1:200000]), '" + "|".join(k.replace(".", "\\.") for k in V.PARKED_KEYWORDS) + "') END AS parked FROM pages")
def parked_pages(spark, d):
    """Parked by the page, by the host that a page led to, or by an alias; nothing is asked where neither answered nor had an alias."""
    i, other = F.col("page_id"), F.array(F.lit("shop.example.com"))
    final = F.when(i % 10 == 0, "www.SedoParking.com").otherwise("shop.example.com")
    alias = F.when(i % 14 == 0, F.array(F.lit("a.example.com"), F.lit("x.ParkingCrew.net"))).when(i % 7 == 0, F.array().cast("array<string>")).otherwise(other)
    return N.table(spark, d, "pages").select("page_id", X.domain_is_parked("html", final, alias, i % 7 != 0).alias("parked"))


@query(f"""SELECT domain, CASE WHEN p % 5 = 0 OR p % 11 = 0 OR p % 13 = 0 OR p % 7 = 0 OR p % 17 = 0 THEN 'hosted' WHEN p % 3 = 0 THEN 'registered_no_web' WHEN p % 2 = 0 THEN 'registered_dns_only'
    WHEN p % 19 = 0 THEN 'dns_error' ELSE 'unregistered_candidate' END AS new_status,
    CASE WHEN p % 5 = 0 OR p % 11 = 0 OR p % 13 = 0 OR p % 3 = 0 OR p % 2 = 0 THEN TRUE WHEN p % 4 IN (0, 3) THEN NULL ELSE TRUE END AS is_registered
    FROM (SELECT {host("url")} AS domain, max(page_id) AS p FROM pages GROUP BY 1)""")
def domain_status(spark, d):
    return D.classify_domains(N.observations(spark, d).drop("html").withColumn("is_parked", F.lit(False))).select("domain", "new_status", "is_registered")


@query("SELECT domain_id, email FROM role_contacts")
def role_emails(spark, d):
    return N.contacts(spark, d).select("domain_id", "email")


@query(r"""SELECT DISTINCT doc_id, 'email' AS contact_type, e AS value FROM (
    SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '[,\s;\n]+'), lambda x: regexp_replace(lower(trim(x)), '^[;,]+|[;,]+$', '', 'g'))) AS e FROM documents WHERE contains(text, '@')) WHERE contains(e, '@')""")
def contact_extract(spark, d):
    docs = N.table(spark, d, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", F.create_map(F.lit("contact:email"), F.col("text")).alias("tags"))
    return P.contacts(docs, "doc_id")


# --- joins


@query("SELECT business_id, b.name, c.name AS city, c.country, region FROM businesses b LEFT JOIN cities c USING (city_id)")
def city_left_join(spark, d):
    c = N.cities(spark, d).select("city_id", F.col("name").alias("city"), "country", "region")
    return N.businesses(spark, d).join(c, "city_id", "left").select("business_id", "name", "city", "country", "region")


def people(spark, d) -> DataFrame:
    """Role contacts under their organization, which stands for its domain."""
    return N.contacts(spark, d).join(N.organizations(spark, d).select("domain_id", "org_id"), "domain_id").select("org_id", "email", "source")


@query("SELECT email, o.name AS organization, domain, status FROM role_contacts JOIN organizations o USING (domain_id) JOIN domains USING (domain_id)")
def contact_org_domain_join(spark, d):
    return people(spark, d).join(N.organizations(spark, d), "org_id").join(N.domains(spark, d), "domain_id").select("email", F.col("name").alias("organization"), "domain", "status")


@query("SELECT domain, coalesce(org_id, sha256('organization|' || domain)) AS org_id, org_id IS NULL AS is_new FROM domains LEFT JOIN organizations USING (domain_id)")
def organization_lookup(spark, d):
    return D.organizations_for(N.domains(spark, d), N.organizations(spark, d)).select("domain", "org_id", "is_new")


@query("SELECT business_id FROM businesses b WHERE EXISTS (SELECT 1 FROM contacts c WHERE c.business_id = b.business_id AND contact_type = 'email')")
def has_contact_semi(spark, d):
    return L.with_contact(N.businesses(spark, d), N.business_contacts(spark, d), "email").select("business_id")


@query(f"SELECT business_id FROM businesses b WHERE EXISTS (SELECT 1 FROM links l WHERE l.business_id = b.business_id AND status IN ({quoted(L.QUALIFIED)}) AND NOT {public('domain')})")
def domain_status_semi(spark, d):
    return L.with_domain_status(N.businesses(spark, d), N.links(spark, d), L.QUALIFIED).select("business_id")


@query(f"SELECT business_id FROM businesses b WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.business_id = b.business_id AND status IN ({quoted(L.ACTIVE)}) AND NOT {public('domain')})")
def active_domain_anti(spark, d):
    return L.without_domain_status(N.businesses(spark, d), N.links(spark, d), L.ACTIVE).select("business_id")


@query("SELECT business_id FROM businesses WHERE business_id NOT IN (SELECT business_id FROM exports WHERE platform = '1-URGENT')")
def unexported_anti(spark, d):
    return L.unexported(N.businesses(spark, d), N.business_exports(spark, d), "1-URGENT").select("business_id")


@query("SELECT business_id FROM businesses WHERE business_id NOT IN (SELECT business_id FROM exports)")
def never_exported_anti(spark, d):
    return L.unexported(N.businesses(spark, d), N.business_exports(spark, d)).select("business_id")


@query("SELECT business_id, lead_score FROM scored WHERE n_emails + n_phones = 0")
def no_contact_queue(spark, d):
    return W.work_queue(L.without_contact(scored(spark, d), N.business_contacts(spark, d)), F.col("website_url").isNull()).select("business_id", _int("lead_score"))


@query("SELECT business_id, coalesce(p.business_id IS NOT NULL, false) AS exported FROM businesses LEFT JOIN (SELECT business_id FROM exports WHERE platform = '2-HIGH') p USING (business_id)")
def exported_flag(spark, d):
    return J.exported_flag(N.businesses(spark, d), N.business_exports(spark, d), "2-HIGH").select("business_id", "exported")


@query("""SELECT b.business_id, coalesce(c.at > s.at, false) AS contact, coalesce(l.at > s.at, false) AS link, coalesce(u.at > s.at, false) AS domain, coalesce(v.at > s.at, false) AS evidence
    FROM businesses b LEFT JOIN last_events s ON s.business_id = b.business_id AND s.kind = 'purchase' LEFT JOIN last_events c ON c.business_id = b.business_id AND c.kind = 'signup' LEFT JOIN last_events l ON l.business_id = b.business_id AND l.kind = 'view'
    LEFT JOIN (SELECT x.business_id, max(y.at) AS at FROM links x JOIN last_events y ON y.business_id = x.domain_id AND y.kind = 'error' WHERE x.business_id IN (SELECT business_id FROM last_events WHERE kind = 'view') GROUP BY 1) u ON u.business_id = b.business_id
    LEFT JOIN last_events v ON v.business_id = b.business_id AND v.kind = 'click'
    WHERE s.at IS NULL OR c.at > s.at OR l.at > s.at OR u.at > s.at OR v.at > s.at""",
    last_events="SELECT user_id AS business_id, event_type AS kind, max(ts) AS at FROM events GROUP BY 1, 2")
def stale_scores(spark, d):
    """Which of contact, link, domain and evidence is newer than the score; each takes its time from events of a type."""
    e = N.table(spark, d, "events")
    last = lambda kind, name, key="business_id": e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias(key)).agg(F.max("ts").alias(name))
    rows = N.businesses(spark, d).select("business_id").join(last("purchase", "scored_at"), "business_id", "left")
    contacts, evidence, domains = last("signup", "created_at"), last("click", "checked_at"), last("error", "updated_at", "domain_id")
    links = last("view", "created_at").join(N.links(spark, d).select("business_id", "domain_id"), "business_id", "left")
    out = S.stale(rows, contacts, links, domains, evidence)
    newer = {"contact": contacts.toDF("business_id", "at"), "link": links.select("business_id", F.col("created_at").alias("at")), "domain": links.join(domains, "domain_id").select("business_id", F.col("updated_at").alias("at")), "evidence": evidence.toDF("business_id", "at")}
    for name, at in newer.items():
        out = out.join(at.groupBy("business_id").agg(F.max("at").alias("_at")), "business_id", "left").withColumn(name, F.coalesce(F.col("_at") > F.col("scored_at"), F.lit(False))).drop("_at")
    return out.select("business_id", *newer)


# --- features, evidence, scores


@query("SELECT business_id, n_emails, n_business, n_phones, n_domains, n_active, n_unknown, emails, phones, domains FROM features")
def business_features(spark, d):
    f = S.business_features(N.businesses(spark, d), N.business_contacts(spark, d), N.links(spark, d))
    n = lambda *c: sum((F.size(x) for x in c), F.lit(0))
    counts = {"n_emails": n("emails"), "n_business": n("business_emails"), "n_phones": n("phones"), "n_domains": n("domains"), "n_active": n("hosted_domains", "parked_domains", "registered_domains"), "n_unknown": n("unknown_domains")}
    return f.select("business_id", *[v.alias(k) for k, v in counts.items()], _csv("emails", ";"), _csv("phones", ";"), _csv("domains", ";"))


@query("SELECT business_id, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM (SELECT business_id, status, count(DISTINCT domain) AS n FROM links GROUP BY 1, 2) GROUP BY 1")
def domain_status_counts(spark, d):
    m = S.status_counts(N.links(spark, d))
    return m.select("business_id", F.array_join(F.transform(F.sort_array(F.map_entries("domain_status_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT domain_id, categories, has_no_website_business, has_phone FROM contact_features")
def contact_features(spark, d):
    f = S.contact_features(N.links(spark, d), N.businesses(spark, d), N.business_contacts(spark, d))
    return f.select("domain_id", _csv("categories"), "has_no_website_business", "has_phone")


@query("SELECT business_id, source_count, CAST(weight * 100 AS INTEGER) AS weight_cents, sources, confidence FROM confidence")
def evidence_confidence(spark, d):
    return E.confidence(N.verifications(spark, d)).select("business_id", "source_count", (F.col("weight") * 100).cast("int").alias("weight_cents"), _csv("sources"), "confidence")


@query("SELECT business_id, lead_score, reason, confidence, n_active > 0 AS has_active_domain FROM scored")
def business_score(spark, d):
    return scored(spark, d).select("business_id", _int("lead_score"), "reason", "confidence", "has_active_domain")


@query("""SELECT email, CASE WHEN status IN ('hosted', 'parked') THEN 0 ELSE least(100, 20 + CASE WHEN status IN ('verified_unhosted', 'enriched') THEN 20 WHEN status IN ('checked', 'mx_missing', 'no_mx') THEN 15
    WHEN status = 'unregistered_candidate' THEN 10 ELSE 0 END + CASE WHEN has_no_website_business THEN 25 ELSE 0 END + CASE WHEN has_phone THEN 20 ELSE 0 END
    + CASE WHEN regexp_matches(categories, '(^|,)(trades|contractors)(,|$)') THEN 25 WHEN regexp_matches(categories, '(^|,)(retail|auto)(,|$)') THEN 10 WHEN categories IS NOT NULL THEN 5 ELSE 0 END) END AS lead_score
    FROM role_contacts JOIN domains USING (domain_id) LEFT JOIN contact_features USING (domain_id)""")
def contact_score(spark, d):
    f = S.contact_features(N.links(spark, d), N.businesses(spark, d), N.business_contacts(spark, d))
    return S.score_contacts(N.contacts(spark, d), N.domains(spark, d), f).select("email", _int("lead_score"))


# --- leads


@query("SELECT business_id, lead_score, confidence FROM scored WHERE website_url IS NULL AND lead_score >= 30 AND n_emails + n_phones > 0 AND n_active = 0")
def eligible_leads(spark, d):
    rows = L.eligible_leads(scored(spark, d), N.business_contacts(spark, d), N.links(spark, d), min_score=30, require_contact=True, exclude_active=True)
    return rows.select("business_id", _int("lead_score"), "confidence")


@query("SELECT business_id, name, lead_score, confidence, reason FROM scored WHERE website_url IS NULL ORDER BY lead_score DESC, created_at, business_id LIMIT 50 OFFSET 50")
def lead_page(spark, d):
    rows = L.eligible_leads(scored(spark, d), N.business_contacts(spark, d), N.links(spark, d))
    return W.page(rows, L.best_first(), 50, 50).select("business_id", "name", _int("lead_score"), "confidence", "reason")


def exported_leads(spark, d) -> tuple[DataFrame, DataFrame]:
    """The best hundred leads for a platform with their cities, and their rows of the ledger."""
    rows = L.eligible_leads(scored(spark, d), N.business_contacts(spark, d), N.links(spark, d), min_score=40)
    out, ledger = L.lead_export(rows, N.business_exports(spark, d), "5-LOW", F.lit("1998-01-01").cast("date"), 100)
    cities = N.cities(spark, d).select("city_id", F.col("name").alias("city"), "country")
    return out.join(cities, "city_id", "left").withColumns({"address": F.lit(None).cast("string"), "source": F.lit("customer"), "source_id": F.col("business_id").cast("string")}), ledger


BEST = """SELECT s.*, coalesce(c.name, '') AS city, coalesce(c.country, '') AS country FROM scored s LEFT JOIN cities c USING (city_id) WHERE website_url IS NULL AND lead_score >= 40
    AND business_id NOT IN (SELECT business_id FROM exports WHERE platform = '5-LOW') ORDER BY lead_score DESC, created_at, business_id LIMIT 100"""


@query("""SELECT name AS business_name, category, '' AS address, city, country, emails, business_emails, free_emails, phones, domains, verified_unhosted_domains, unregistered_domains, registered_domains, unknown_domains,
    hosted_domains, parked_domains, CAST(CAST(lead_score AS DECIMAL(6,2)) AS VARCHAR) AS lead_score, 'customer' AS source, CAST(business_id AS VARCHAR) AS source_id FROM best""", best=BEST)
def lead_export(spark, d):
    return L.lead_sheet(exported_leads(spark, d)[0])


@query("SELECT business_id, '5-LOW' AS platform, '1998-01-01' AS exported_on, 'queued' AS status FROM best", best=BEST)
def lead_ledger(spark, d):
    return exported_leads(spark, d)[1].withColumn("exported_on", F.col("exported_on").cast("string"))


@query("""SELECT name AS "Name", category AS "Category", '' AS "Address", city AS "City", country AS "Country", CAST(lead_score AS INTEGER) AS "Lead Score", emails AS "Emails", business_emails AS "Business Emails", phones AS "Phones",
    replace(domains, ';', ', ') AS "Domains", hosted_domains AS "Hosted Domains", registered_domains AS "Registered Domains" FROM best""", best=BEST)
def refreshed_sheet(spark, d):
    return L.refreshed_sheet(exported_leads(spark, d)[0]).withColumn("Lead Score", F.col("Lead Score").cast("int"))


@query("SELECT business_id, lead_score, total FROM (SELECT *, count(*) OVER () AS total FROM scored JOIN (SELECT city_id, name AS city FROM cities) USING (city_id) WHERE website_url IS NULL AND city ILIKE '%ion_1%' AND confidence <> 'unverified') ORDER BY lead_score DESC, created_at, business_id LIMIT 20 OFFSET 2")
def leads_of_city(spark, d):
    rows = L.eligible_leads(scored(spark, d), N.business_contacts(spark, d), N.links(spark, d), city="ion_1", cities=N.cities(spark, d), min_confidence="low")
    return L.page_with_total(rows, 20, 2).select("business_id", _int("lead_score"), "total")


@query("SELECT business_id, CASE WHEN coalesce(website_url, '') = '' AND EXISTS (SELECT 1 FROM chains WHERE lower(trim(name)) = chain OR (length(chain) >= 4 AND contains(lower(trim(name)), chain))) THEN 0 ELSE lead_score END AS lead_score FROM scored",
    chains="SELECT DISTINCT lower(CASE WHEN business_id % 170 = 0 THEN name[1:4] ELSE name END) AS chain FROM businesses WHERE business_id % 85 = 0")
def chain_scores(spark, d):
    """Scores where names that are, or hold, a chain's count as branded."""
    b = N.businesses(spark, d)
    chains = J.chain_names(b.filter("business_id % 85 = 0").select(F.when(F.col("business_id") % 170 == 0, F.substring("name", 1, 4)).otherwise(F.col("name")).alias("name")))
    branded = F.col("brand").isNotNull() | F.col("in_chain")
    return S.score_businesses(J.in_chain(b, chains), N.business_contacts(spark, d), N.links(spark, d), N.verifications(spark, d), branded).select("business_id", _int("lead_score"))


@query("""SELECT business_id, fill_rank, recycled FROM (SELECT s.business_id, CAST(row_number() OVER (ORDER BY e.business_id IS NOT NULL, lead_score DESC, created_at, s.business_id) AS INTEGER) AS fill_rank,
    e.business_id IS NOT NULL AS recycled FROM scored s LEFT JOIN (SELECT DISTINCT business_id FROM exports) e USING (business_id)
    WHERE website_url IS NULL AND s.business_id NOT IN (SELECT business_id FROM exports WHERE platform = '1-URGENT'))
    WHERE fill_rank <= (SELECT greatest(600 - count(DISTINCT business_id), 0) FROM exports WHERE platform = '1-URGENT') AND fill_rank <= 600""")
def daily_target_fill(spark, d):
    rows = L.eligible_leads(scored(spark, d), N.business_contacts(spark, d), N.links(spark, d))
    return L.daily_fill(rows, N.business_exports(spark, d), "1-URGENT", 600).select("business_id", "fill_rank", "recycled")


@query("SELECT domain, 'Org ' || domain AS organization, email, '' AS first_name, '' AS last_name, '' AS title, source, '' AS lead_score FROM role_contacts JOIN organizations USING (domain_id) JOIN domains USING (domain_id)")
def contact_sheet(spark, d):
    none = F.lit(None).cast("string")
    rows = people(spark, d).join(N.organizations(spark, d), "org_id").join(N.domains(spark, d), "domain_id").withColumn("organization", F.col("name"))
    return L.contact_sheet(rows.withColumns({c: none for c in ("first_name", "last_name", "title", "lead_score")}))


@query("SELECT domain_id * 5 + k AS contact_id, email FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY email) - 1 AS k FROM role_contacts JOIN domains USING (domain_id) WHERE domain_id % 2 = 0) WHERE (domain_id * 5 + k) % 3 <> 0")
def contact_export(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("domain_id").orderBy("email")) - 1
    rows = N.contacts(spark, d).withColumn("contact_id", F.col("domain_id") * 5 + k)
    ledger = rows.filter("contact_id % 3 = 0").select("contact_id", F.lit("today").alias("platform"))
    enriched = N.domains(spark, d).withColumn("status", F.when(F.col("domain_id") % 2 == 0, "enriched").otherwise(F.col("status")))
    return L.contact_export(rows, enriched, ledger, "today").select("contact_id", "email")


@query("""SELECT business_id, d AS domain, max(source) AS source FROM (
    SELECT business_id, 'biz' || business_id || '.example.com' AS d, 'website' AS source FROM businesses WHERE website_url IS NOT NULL
    UNION ALL SELECT business_id, split_part(value, '@', 2), 'email' FROM contacts WHERE contact_type = 'email' AND NOT value LIKE '%@gmail.com') GROUP BY 1, 2""")
def domain_sync_links(spark, d):
    links = N.links(spark, d)
    return D.sync_domains(N.businesses(spark, d), N.business_contacts(spark, d), N.domains(spark, d), links)[1].select("business_id", "domain", "source")


@query(f"""SELECT domain, CASE WHEN p % 3 = 0 THEN 'enriched' ELSE 'mx_missing' END AS status FROM domains JOIN (SELECT {host("url")} AS domain, max(page_id) AS p FROM pages GROUP BY 1) USING (domain) WHERE status = 'verified_unhosted'""")
def role_enrichment(spark, d):
    none = spark.createDataFrame([], "domain_id bigint, email string")
    return D.role_contacts(N.domains(spark, d), N.observations(spark, d).drop("html"), none)[0].select("domain", "status")


@query("""SELECT f.name, category, 'No. ' || business_id AS address, coalesce(c.name, '') AS city, coalesce(c.country, '') AS country, phones AS phone, emails AS email, CASE WHEN business_id % 50 = 0 THEN '' ELSE CAST(business_id % 50 AS VARCHAR) || '.5' END AS lat,
    '' AS lon, 'customer' AS source, CAST(business_id AS VARCHAR) AS source_id FROM features f LEFT JOIN cities c USING (city_id) WHERE website_url IS NULL""")
def no_website_export(spark, d):
    i = F.col("business_id")
    placed = N.businesses(spark, d).withColumns({"address": F.concat(F.lit("No. "), i.cast("string")), "lat": F.when(i % 50 == 0, 0.0).otherwise(i % 50 + 0.5), "lon": F.lit(None).cast("double"), "source": F.lit("customer"), "source_id": i.cast("string")})
    return L.no_website_sheet(placed, N.business_contacts(spark, d).withColumn("contact_id", F.col("value")), N.cities(spark, d))


# --- metrics


@query("SELECT count(*) AS total, count(*) FILTER (website_url IS NULL) AS no_website, count(*) AS scored, count(*) FILTER (website_url IS NULL) AS scored_no_website, 0 AS unscored FROM scored")
def business_totals(spark, d):
    return M.business_totals(scored(spark, d)).withColumn("unscored", F.col("unscored").cast("int"))


@query("SELECT status, count(*) AS n FROM domains GROUP BY 1")
def status_histogram(spark, d):
    return M.histogram(N.domains(spark, d), "status")


@query("SELECT source, result, count(*) AS n FROM verifications GROUP BY 1, 2")
def result_histogram(spark, d):
    return M.histogram(N.verifications(spark, d), "source", "result")


@query("SELECT CAST(round(CAST(lead_score AS DECIMAL(10,2)) / 10) * 10 AS INTEGER) AS bucket, count(*) AS n FROM scored GROUP BY 1")
def score_histogram(spark, d):
    return M.histogram(scored(spark, d).select(X.score_bucket("lead_score").alias("bucket")), "bucket")


@query("""SELECT coalesce(k, 0) AS conclusive_sources, count(*) AS businesses FROM businesses LEFT JOIN (SELECT business_id, count(*) FILTER (result IN ('no_website', 'no_match', 'has_website')) AS k FROM verifications GROUP BY 1) USING (business_id) GROUP BY 1""")
def conclusive_histogram(spark, d):
    return M.conclusive_histogram(N.businesses(spark, d), N.verifications(spark, d))


@query("SELECT source, count(DISTINCT business_id) AS businesses FROM verifications GROUP BY 1 UNION ALL SELECT 'any', count(DISTINCT business_id) FROM verifications")
def coverage(spark, d):
    return M.coverage(N.verifications(spark, d))


@query("SELECT source, count(*) FILTER (result IN ('no_website', 'no_match', 'has_website')) AS conclusive, count(*) FILTER (result NOT IN ('no_website', 'no_match', 'has_website')) AS inconclusive FROM verifications GROUP BY 1")
def conclusive_split(spark, d):
    return M.conclusive_split(N.verifications(spark, d))


@query("SELECT c AS confidence, count(business_id) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('unverified')) AS v(c) LEFT JOIN (SELECT * FROM scored WHERE website_url IS NULL) ON confidence = c GROUP BY 1")
def confidence_distribution(spark, d):
    return M.confidence_distribution(scored(spark, d))


@query("""SELECT count(*) FILTER (lead_score >= 40) AS eligible, count(*) FILTER (lead_score >= 40 AND confidence <> 'unverified') AS processed, count(*) FILTER (lead_score >= 40 AND confidence = 'unverified') AS remaining,
    count(*) FILTER (lead_score IS NULL) AS never_scored FROM scored WHERE website_url IS NULL""")
def eligibility_counts(spark, d):
    return M.eligibility(scored(spark, d), N.verifications(spark, d), 40)


@query("""SELECT count(*) FILTER (scored_at >= m - INTERVAL 600 MINUTE) AS rescored, count(*) FILTER (scored_at >= m - INTERVAL 600 MINUTE AND confidence <> 'unverified') AS verified_and_rescored,
    count(*) FILTER (scored_at IS NULL) AS pending FROM features LEFT JOIN (SELECT user_id, max(ts) AS scored_at FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = business_id, (SELECT max(ts) AS m FROM events)""")
def recent_activity(spark, d):
    e = N.table(spark, d, "events")
    at = e.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("business_id")).agg(F.max("ts").alias("scored_at"))
    now = e.agg(F.max("ts").alias("_now"), F.lit(1).alias("_one"))  # one row
    rows = E.business_confidence(N.businesses(spark, d), N.verifications(spark, d)).join(at, "business_id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one")
    return M.recent_activity(rows, F.col("_now"), 600)


@query("SELECT DISTINCT category FROM businesses")
def distinct_categories(spark, d):
    return M.distinct_names(N.businesses(spark, d), "category")


@query("""SELECT stage, name, n, CASE WHEN lag(n) OVER (ORDER BY stage) > 0 AND n <= lag(n) OVER (ORDER BY stage) THEN round(100 * n / lag(n) OVER (ORDER BY stage), 2) END AS conversion FROM (
    SELECT 0 AS stage, 'total' AS name, count(*) AS n FROM scored UNION ALL SELECT 1, 'no_website', count(*) FROM scored WHERE website_url IS NULL
    UNION ALL SELECT 2, 'verified', count(*) FROM scored WHERE website_url IS NULL AND confidence <> 'unverified'
    UNION ALL SELECT 3, 'confident', count(*) FROM scored WHERE website_url IS NULL AND confidence IN ('high', 'medium')
    UNION ALL SELECT 4, 'exported', count(*) FROM scored WHERE business_id IN (SELECT business_id FROM exports))""")
def funnel(spark, d):
    return M.funnel(scored(spark, d), N.business_exports(spark, d))


@query("SELECT run_id, job_name, status, CAST(started_on AS VARCHAR) AS started_on FROM job_runs ORDER BY job_runs.started_on DESC, run_id DESC LIMIT 20")
def recent_jobs(spark, d):
    return M.recent_jobs(N.job_runs(spark, d), 20).select("run_id", "job_name", "status", F.col("started_on").cast("string").alias("started_on"))


@query("SELECT '1-URGENT' AS platform, 600 AS target, count(DISTINCT business_id) AS exported, greatest(600 - count(DISTINCT business_id), 0) AS remaining, count(DISTINCT business_id) >= 600 AS completed FROM exports WHERE platform = '1-URGENT'")
def daily_target(spark, d):
    return M.daily_target(N.business_exports(spark, d), "1-URGENT", 600)


@query("""SELECT 'domains' AS section, status AS key, count(*) AS value FROM domains GROUP BY 2 UNION ALL SELECT 'exports', platform, count(*) FROM exports GROUP BY 2
    UNION ALL SELECT 'coverage', source, count(DISTINCT business_id) FROM verifications GROUP BY 2 UNION ALL SELECT 'coverage', 'any', count(DISTINCT business_id) FROM verifications
    UNION ALL SELECT 'conclusive', source, count(*) FILTER (result IN ('no_website', 'no_match', 'has_website')) FROM verifications GROUP BY 2
    UNION ALL SELECT 'inconclusive', source, count(*) FILTER (result NOT IN ('no_website', 'no_match', 'has_website')) FROM verifications GROUP BY 2
    UNION ALL SELECT 'confidence', c, count(business_id) FROM (VALUES ('high'), ('medium'), ('low'), ('unverified')) AS v(c) LEFT JOIN (SELECT * FROM scored WHERE website_url IS NULL) ON confidence = c GROUP BY 2
    UNION ALL SELECT 'businesses', k, CASE k WHEN 'total' THEN (SELECT count(*) FROM scored) WHEN 'scored' THEN (SELECT count(*) FROM scored) WHEN 'unscored' THEN 0 ELSE (SELECT count(*) FROM scored WHERE website_url IS NULL) END
    FROM (VALUES ('total'), ('no_website'), ('scored'), ('scored_no_website'), ('unscored')) AS w(k)
    UNION ALL SELECT 'contacts', k, CASE k WHEN 'total' THEN (SELECT count(*) FROM role_contacts) WHEN 'scored' THEN (SELECT count(*) FROM role_contacts WHERE domain_id % 2 = 0) ELSE (SELECT count(*) FROM role_contacts WHERE domain_id % 2 <> 0) END
    FROM (VALUES ('total'), ('scored'), ('unscored')) AS x(k)
    UNION ALL SELECT 'business_exports', k, CASE k WHEN 'total' THEN (SELECT count(*) FROM exports) ELSE (SELECT count(*) FROM exports WHERE platform = '1-URGENT') END FROM (VALUES ('total'), ('queued')) AS y(k)
    UNION ALL SELECT 'contact_exports', k, (SELECT count(*) FROM role_contacts WHERE domain_id % 3 = 0) FROM (VALUES ('total'), ('queued')) AS z(k)
    UNION ALL SELECT 'jobs', row_number() OVER (ORDER BY started_on DESC, run_id DESC) || '|' || job_name || '|' || status || '|' || started_on, CAST(floor(processed) AS BIGINT) FROM (SELECT * FROM job_runs ORDER BY job_runs.started_on DESC, run_id DESC LIMIT 10)""")
def metrics_report(spark, d):
    v, contacts = N.verifications(spark, d), N.contacts(spark, d).withColumn("lead_score", F.when(F.col("domain_id") % 2 == 0, 10))
    ledger = N.business_exports(spark, d).withColumn("status", F.when(F.col("platform") == "1-URGENT", "queued").otherwise("sent"))
    queued = contacts.filter("domain_id % 3 = 0").select("email", F.lit("queued").alias("status"))
    return M.metrics_report(N.businesses(spark, d), v, scored(spark, d), N.domains(spark, d), ledger, contacts, queued, N.job_runs(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (domain_id % 2 = 0) AS scored, count(*) FILTER (domain_id % 2 <> 0) AS unscored FROM role_contacts")
def contact_totals(spark, d):
    return M.contact_totals(N.contacts(spark, d).withColumn("lead_score", F.when(F.col("domain_id") % 2 == 0, 10)))


@query("SELECT count(*) AS total, count(*) FILTER (platform = '1-URGENT') AS queued FROM exports")
def export_totals(spark, d):
    return M.export_totals(N.business_exports(spark, d).withColumn("status", F.when(F.col("platform") == "1-URGENT", "queued").otherwise("sent")))


@query("SELECT CAST(sum(run_id % 7) AS BIGINT) AS websites_discovered, CAST(sum(run_id % 3) AS BIGINT) AS verified FROM job_runs")
def run_summary(spark, d):
    return M.run_summary(N.job_runs(spark, d).select((F.col("run_id") % 7).alias("websites_found"), (F.col("run_id") % 3).alias("verified")))


@query("SELECT DISTINCT name AS city FROM cities WHERE name <> ''")
def distinct_cities(spark, d):
    return M.distinct_names(N.cities(spark, d), "name").select(F.col("name").alias("city"))


@query("""SELECT run_id, job_name, status, CAST(started_on AS VARCHAR) AS started_at, CASE WHEN status <> 'running' THEN CAST(started_on + 1 AS VARCHAR) END AS finished_at,
    CASE WHEN status <> 'running' THEN run_id % 100 ELSE 0 END AS processed, CASE WHEN status = 'failed' THEN 4000 END AS error_length FROM job_runs""")
def job_run_log(spark, d):
    """Runs from a log of their starts and ends; failed ones end with a long error."""
    from prospectra.operators.writers import job_runs

    runs = N.job_runs(spark, d)
    none = F.lit(None).cast("string")
    starts = runs.select("run_id", "job_name", F.lit("running").alias("status"), F.col("started_on").alias("at"), F.lit(None).cast("long").alias("processed"), none.alias("error"))
    ends = runs.filter("status <> 'running'").select("run_id", "job_name", "status", F.date_add("started_on", 1).alias("at"), (F.col("run_id") % 100).alias("processed"), F.when(F.col("status") == "failed", F.repeat(F.lit("error "), 1000)).alias("error"))
    out = job_runs(starts.unionByName(ends))
    return out.select("run_id", "job_name", "status", F.col("started_at").cast("string").alias("started_at"), F.col("finished_at").cast("string").alias("finished_at"), "processed", F.length("error").alias("error_length"))


@query("SELECT job_name, run_id, CAST(started_on AS VARCHAR) AS started_on FROM job_runs QUALIFY row_number() OVER (PARTITION BY job_name, status ORDER BY job_runs.started_on DESC, run_id DESC) = 1")
def latest_checkpoint(spark, d):
    runs = N.job_runs(spark, d).select("job_name", F.col("status").alias("scope"), F.lit("run").alias("checkpoint_key"), F.lpad(F.col("run_id").cast("string"), 12, "0").alias("checkpoint_value"), F.col("started_on").alias("updated_at"), "run_id")
    return W.latest_checkpoint(runs).select("job_name", "run_id", F.col("updated_at").cast("string").alias("started_on"))


# --- evidence matching


def _search_results(spark, d) -> tuple[DataFrame, DataFrame]:
    """Businesses named after their page's host, with the next five pages as results; every third lacks its own page."""
    pages = N.table(spark, d, "pages")
    named = pages.select(F.col("page_id").alias("business_id"), F.regexp_extract(X.url_host("url"), r"^(?:m\.)?([^.]+)", 1).alias("name"), F.lit(1).alias("_one"))
    n = pages.agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    asked = named.join(F.broadcast(n), "_one").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("page_id", (F.col("business_id") + F.col("rank") + F.col("_n") - 2) % F.col("_n"))
    asked = asked.filter((F.col("business_id") % 3 != 0) | (F.col("page_id") != F.col("business_id")))
    found = asked.join(pages.select("page_id", F.regexp_replace("url", r"://m\.", "://").alias("href"), X.page_title("html").alias("title")), "page_id")
    return named.select("business_id", "name"), found.select("business_id", F.lit(1).alias("query_no"), "rank", "href", "title")


@query(rf"""SELECT b.business_id, CASE WHEN r.rank IS NOT NULL THEN 'has_website' ELSE 'no_website' END AS result,
    CASE WHEN r.rank IS NOT NULL THEN regexp_extract(r.url, '^([a-z]+)://', 1) || '://' || regexp_extract(replace(r.url, '://m.', '://'), '://([^/?#]*)', 1) || '/' END AS website
    FROM named b LEFT JOIN (SELECT n.business_id, g.rank, p.url FROM named n, (SELECT unnest(range(1, 6)) AS rank) g, pages p
        WHERE p.page_id = (n.business_id + g.rank + (SELECT count(*) FROM pages) - 2) % (SELECT count(*) FROM pages) AND (n.business_id % 3 <> 0 OR p.page_id <> n.business_id)
        AND (length(n.name) >= 7 AND contains(regexp_extract(regexp_replace({host("url")}, '^m\.', ''), '^([^.]+)', 1), n.name)
            OR length(regexp_extract(regexp_replace({host("url")}, '^m\.', ''), '^([^.]+)', 1)) >= 6 AND contains(n.name, regexp_extract(regexp_replace({host("url")}, '^m\.', ''), '^([^.]+)', 1))
               AND length(regexp_extract(regexp_replace({host("url")}, '^m\.', ''), '^([^.]+)', 1)) >= 0.65 * length(n.name))
        QUALIFY row_number() OVER (PARTITION BY n.business_id ORDER BY g.rank) = 1) r USING (business_id)""",
    named=rf"SELECT page_id AS business_id, regexp_extract({host('url')}, '^(?:m\.)?([^.]+)', 1) AS name FROM pages")
def search_match(spark, d):
    named, results = _search_results(spark, d)
    return E.search_verdicts(named, results).select("business_id", "result", "website")


@query("""SELECT business_id, CASE WHEN NOT there THEN 'no_match' WHEN NOT matches THEN 'poor_match' WHEN k % 2 = 0 THEN 'has_website' ELSE 'no_website' END AS result, CASE WHEN matches AND k % 2 = 0 THEN 'http://place' || k || '.example.com/' END AS website,
    CASE WHEN matches THEN CASE WHEN k % 3 = 0 THEN '+1 ' || k ELSE '+44 ' || k END END AS phone, CASE WHEN matches THEN k % 5 + 0.5 END AS rating, CASE WHEN matches THEN CAST(k AS INTEGER) END AS review_count
    FROM (SELECT b.p_partkey AS business_id, p.p_partkey AS k, p.p_name IS NOT NULL AS there, coalesce(list_contains(string_split(p.p_name, ' '), split_part(b.p_name, ' ', 1)) OR list_contains(string_split(p.p_name, ' '), split_part(b.p_name, ' ', 2)), false) AS matches
        FROM part b LEFT JOIN part p ON p.p_partkey = b.p_partkey + 1)""")
def place_match(spark, d):
    parts = N.table(spark, d, "part")
    named = parts.select(F.col("p_partkey").alias("business_id"), F.col("p_name").alias("name"))
    k = F.col("p_partkey")
    text = lambda before, after="": F.concat(F.lit(before), k.cast("string"), F.lit(after))
    place = F.struct(
        F.col("p_name").alias("name"), F.when(k % 2 == 0, text("http://place", ".example.com/")).alias("website"), F.when(k % 3 == 0, text("+1 ")).otherwise(F.lit("")).alias("national_phone"),
        text("+44 ").alias("international_phone"), (k % 5 + 0.5).alias("rating"), k.cast("int").alias("review_count"),
    )
    places = parts.select((k - 1).alias("business_id"), F.lit(1).alias("rank"), place.alias("place"))
    return E.place_verdicts(named, places)


@query("""SELECT c_custkey AS business_id, 'email' AS contact_type, 'a' || c_custkey || '@' || domain AS value FROM customer JOIN links ON links.business_id = c_custkey JOIN scored USING (business_id)
    WHERE lead_score >= 30 AND c_custkey % 2 = 1""")
def email_finder(spark, d):
    leads = scored(spark, d).select("business_id", "lead_score").join(N.links(spark, d).select("business_id", "domain"), "business_id")
    rows = leads.select("business_id", "domain").withColumn("domain", F.concat(F.col("business_id").cast("string"), F.lit("."), F.col("domain")))
    asked = leads.withColumn("domain", F.concat(F.col("business_id").cast("string"), F.lit("."), F.col("domain")))
    bare = F.regexp_replace("domain", r"^[0-9]+\.", "")
    emails = F.array(F.struct(F.concat(F.lit("A"), F.col("business_id").cast("string"), F.lit("@"), bare).alias("value"), F.when(F.col("business_id") % 2 == 1, 80).alias("confidence")))
    finder = rows.select("domain", emails.alias("emails"))
    return E.found_emails(finder, asked, N.business_contacts(spark, d))


@query("SELECT name, country, pos, domain FROM candidates", **CANDIDATES,
    asked="SELECT upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS name, CASE p_size % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'GB' END AS country FROM part")
def candidate_domains(spark, d):
    parts = N.table(spark, d, "part").select(F.initcap("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "CA").when(F.col("p_size") % 3 == 1, "GB").alias("country"))
    return sites.candidate_domains(parts)


@query("SELECT page_id, name, positive, rejected_by IS NULL AS is_owner, rejected_by FROM judged", **OWNERSHIP,
    named=rf"SELECT page_id, url, html, array_to_string(regexp_split_to_array({TITLE}, '\s+')[1:2], ' ') AS name FROM pages",
    tried="SELECT page_id, name, url, html, true AS positive FROM named UNION ALL SELECT p.page_id, n.name, p.url, p.html, false FROM named n JOIN pages p ON p.page_id = n.page_id + 1")
def page_ownership(spark, d):
    """Names from the first two words of a page's title, and of the page before it for the negatives."""
    pages = N.table(spark, d, "pages").withColumn("_name", F.array_join(F.slice(F.split(X.page_title("html"), r"\s+"), 1, 2), " "))
    own = pages.select("page_id", F.col("_name").alias("name"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), "html", F.lit(True).alias("positive"))
    other = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("_name").alias("name")).join(pages.select("page_id", "url", "html"), "page_id")
    return sites.judge_pages(own.unionByName(other.select("page_id", "name", "url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), "html", F.lit(False).alias("positive")))).select("page_id", "name", "positive", "is_owner", "rejected_by")


@query("SELECT 'node/' || p_partkey AS source_id, p_name AS name, CASE p_size % 5 WHEN 0 THEN 'trades' WHEN 1 THEN 'retail' WHEN 2 THEN 'professional_services' WHEN 3 THEN 'hospitality' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'food' ELSE 'finance' END END AS category, 2 AS contacts FROM part")
def poi_import(spark, d):
    """Parts as elements, to businesses with their contacts' number."""
    tagged = _part_tags(spark, d).select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.lit(25.0).alias("lat"), F.lit(55.0).alias("lon"), F.lit(None).cast("struct<lat: double, lon: double>").alias("center"),
        F.map_concat("tags", F.create_map(F.lit("phone"), F.concat(F.lit("+1 "), F.col("p_partkey").cast("string"), F.lit(" / +2 "), F.col("p_partkey").cast("string")))).alias("tags"))
    rows, contacts = P.import_elements(tagged)
    return rows.join(contacts.groupBy("business_id").agg(F.count(F.lit(1)).alias("contacts")), "business_id", "left").select("source_id", "name", "category", _int("contacts"))


from . import more_queries  # noqa: E402, F401  registers itself
