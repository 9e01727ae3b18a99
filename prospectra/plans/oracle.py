"""The entities of ``sources.entities`` as SQL, to hold the queries against."""

from __future__ import annotations

from prospectra.functions import fixed_values as V


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def host(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower({c}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '')"


def public(d: str) -> str:
    return f"({d} IN ({quoted(V.PUBLIC_MAIL_DOMAINS)}) OR " + " OR ".join(f"starts_with({d}, '{p}')" for p in V.PUBLIC_MAIL_PREFIXES) + ")"


def weight() -> str:
    whens = " ".join(f"WHEN source = '{s}' AND result = '{r}' THEN {w}" for s, results in V.EVIDENCE_WEIGHTS.items() for r, w in results.items())
    return f"CAST(CASE {whens} ELSE {V.UNLISTED_WEIGHT} END AS DECIMAL(4,2))"


STATUS_SETS = {"verified_unhosted": V.VERIFIED_UNHOSTED, "unregistered": V.UNREGISTERED, "registered": V.REGISTERED, "unknown": V.UNKNOWN_STATUS, "hosted": ["hosted"], "parked": ["parked"]}

ENTITIES = {
    "cities": """SELECT n_nationkey AS city_id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'AE' WHEN 1 THEN 'CA' WHEN 2 THEN 'US' END AS country, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "businesses": """SELECT c_custkey AS business_id, CASE WHEN c_custkey % 17 = 0 THEN 'biz' || c_custkey || '.com' ELSE c_name END AS name,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'trades' WHEN 'BUILDING' THEN 'contractors' WHEN 'FURNITURE' THEN 'retail' WHEN 'AUTOMOBILE' THEN 'auto' ELSE 'other' END AS category,
        CASE WHEN c_custkey % 5 = 0 THEN 'http://www.biz' || c_custkey || '.example.com/' END AS website_url, CASE WHEN c_custkey % 23 = 0 THEN 'Brand' END AS brand, c_nationkey AS city_id,
        coalesce(CAST(first_order AS DATE), DATE '1992-01-01') AS created_at
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "contacts": """SELECT c_custkey AS business_id, 'email' AS contact_type,
        CASE WHEN c_custkey % 6 = 0 THEN 'owner' || c_custkey || '@gmail.com' ELSE 'info@biz' || c_custkey || '.example.com' END AS value FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'phone', '+1-555-' || c_custkey FROM customer WHERE c_custkey % 2 = 0""",
    "domains": f"""SELECT min(page_id) AS domain_id, {host("url")} AS domain,
        CASE min(page_id) % 8 WHEN 0 THEN 'hosted' WHEN 1 THEN 'parked' WHEN 2 THEN 'registered_no_web' WHEN 3 THEN 'new' WHEN 4 THEN 'verified_unhosted' ELSE 'unregistered_candidate' END AS status
        FROM pages GROUP BY 2""",
    "links": f"""SELECT c_custkey AS business_id, domain_id, domain, status FROM customer
        JOIN pages ON page_id = c_custkey % (SELECT count(*) FROM pages) JOIN domains ON domain = {host("url")} WHERE c_custkey % 4 <> 0""",
    "verifications": """SELECT user_id AS business_id,
        CASE event_type WHEN 'click' THEN 'domain_guess' WHEN 'view' THEN 'searxng' WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'ddg' WHEN 'error' THEN 'google_search' ELSE 'foursquare' END AS source,
        CASE WHEN value < 10 THEN 'no_results' WHEN value < 30 THEN 'no_website' WHEN value < 60 THEN 'no_match' ELSE 'has_website' END AS result, ts AS checked_at
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "exports": "SELECT o_custkey AS business_id, o_orderpriority AS platform, CAST(min(o_orderdate) AS DATE) AS exported_on FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1, 2",
    "job_runs": """SELECT o_orderkey AS run_id, o_orderpriority AS job_name, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'running' ELSE 'failed' END AS status,
        CAST(o_orderdate AS DATE) AS started_on, o_totalprice AS processed FROM orders""",
    "organizations": "SELECT 'org' || domain_id AS org_id, domain_id, 'Org ' || domain AS name FROM domains WHERE domain_id % 3 <> 0",
    "wanted": """SELECT DISTINCT business_id, d AS domain FROM (SELECT business_id, 'biz' || business_id || '.example.com' AS d FROM businesses WHERE website_url IS NOT NULL
        UNION ALL SELECT business_id, split_part(value, '@', 2) FROM contacts WHERE contact_type = 'email' AND NOT value LIKE '%@gmail.com')""",
    "role_contacts": """SELECT domain_id, p || '@' || domain AS email, 'role' AS source FROM domains, (VALUES ('info'), ('admin'), ('sales'), ('support'), ('contact')) AS v(p)""",
    "confidence": f"""SELECT business_id, count(DISTINCT source) AS source_count, CAST(sum({weight()}) AS DECIMAL(8,2)) AS weight, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
        CASE WHEN sum({weight()}) >= 1.5 THEN 'high' WHEN sum({weight()}) >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM verifications GROUP BY 1""",
    "contact_sets": f"""SELECT business_id, count(DISTINCT value) FILTER (mail) AS n_emails, count(DISTINCT value) FILTER (own) AS n_business, count(DISTINCT value) FILTER (phone) AS n_phones,
        string_agg(DISTINCT value, ';' ORDER BY value) FILTER (own) AS business_emails, string_agg(DISTINCT value, ';' ORDER BY value) FILTER (mail AND NOT own) AS free_emails,
        string_agg(DISTINCT value, ';' ORDER BY value) FILTER (mail) AS emails, string_agg(DISTINCT value, ';' ORDER BY value) FILTER (phone) AS phones
        FROM (SELECT *, contact_type = 'email' AS mail, contact_type = 'phone' AS phone, contact_type = 'email' AND NOT {public("split_part(value, '@', 2)")} AS own FROM contacts) GROUP BY 1""",
    "domain_sets": f"""SELECT business_id, count(DISTINCT domain) AS n_domains, count(DISTINCT CASE WHEN status IN ('hosted', 'parked', {quoted(V.REGISTERED)}) THEN domain END) AS n_active,
        count(DISTINCT CASE WHEN status IN ({quoted(V.UNKNOWN_STATUS)}) THEN domain END) AS n_unknown, string_agg(DISTINCT domain, ';' ORDER BY domain) AS domains,
        {", ".join(f"string_agg(DISTINCT CASE WHEN status IN ({quoted(found)}) THEN domain END, ';' ORDER BY CASE WHEN status IN ({quoted(found)}) THEN domain END) AS {name}_domains" for name, found in STATUS_SETS.items())} FROM links WHERE NOT {public("domain")} GROUP BY 1""",
    "features": """SELECT b.*, coalesce(n_emails, 0) AS n_emails, coalesce(n_business, 0) AS n_business, coalesce(n_phones, 0) AS n_phones, coalesce(n_domains, 0) AS n_domains, coalesce(n_active, 0) AS n_active,
        coalesce(n_unknown, 0) AS n_unknown, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, coalesce(domains, '') AS domains, coalesce(business_emails, '') AS business_emails, coalesce(free_emails, '') AS free_emails,
        """ + ", ".join(f"coalesce({name}_domains, '') AS {name}_domains" for name in STATUS_SETS) + """, coalesce(confidence, 'unverified') AS confidence,
        regexp_matches(replace(lower(name), ' ', ''), '(\\.com|\\.ca|\\.ae|\\.qa|\\.io|\\.co|\\.net|\\.org|\\.biz|\\.info|\\.us|\\.uk|\\.app|\\.dev|\\.shop|\\.store)($|/)') AS domainish
        FROM businesses b LEFT JOIN contact_sets USING (business_id) LEFT JOIN domain_sets USING (business_id) LEFT JOIN confidence USING (business_id)""",
    "scored": """SELECT *, CASE WHEN coalesce(website_url, '') <> '' OR brand IS NOT NULL OR n_active > 0 THEN 0 ELSE
            least(25 + CASE WHEN n_business > 0 THEN 20 WHEN n_emails > 0 THEN 5 ELSE 0 END + CASE WHEN n_phones > 0 THEN 15 ELSE 0 END
            + CASE WHEN category IN ('trades', 'contractors') THEN 20 WHEN category IN ('professional_services', 'retail', 'health', 'food', 'auto') THEN 10 WHEN category <> '' THEN 5 ELSE 0 END,
            CASE WHEN n_unknown > 0 THEN 10 ELSE 100 END, CASE WHEN domainish THEN 15 ELSE 100 END, CASE WHEN n_emails + n_phones = 0 THEN 5 ELSE 100 END,
            CASE confidence WHEN 'unverified' THEN 35 WHEN 'low' THEN 50 ELSE 100 END) END AS lead_score,
        CASE WHEN coalesce(website_url, '') <> '' THEN 'has_website' WHEN brand IS NOT NULL THEN 'branded_chain' WHEN n_active > 0 THEN 'active_domain'
            WHEN n_emails + n_phones = 0 THEN 'no_contacts' WHEN domainish THEN 'name_is_domain' END AS reason FROM features""",
    "contact_features": """SELECT domain_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, bool_or(coalesce(website_url, '') = '') AS has_no_website_business, bool_or(p.business_id IS NOT NULL) AS has_phone
        FROM (SELECT DISTINCT domain_id, business_id FROM links) JOIN businesses USING (business_id) LEFT JOIN (SELECT business_id FROM contacts WHERE contact_type = 'phone') p USING (business_id) GROUP BY 1""",
}


def forms(w: str) -> str:
    """A list of a word and its other number."""
    return f"""list_filter([{w}, CASE WHEN length({w}) <= 4 THEN NULL WHEN ends_with({w}, 'ies') AND length({w}) > 5 THEN {w}[1:length({w}) - 3] || 'y' WHEN regexp_matches({w}, '(ses|xes|zes)$') THEN {w}[1:length({w}) - 2]
        WHEN regexp_matches({w}, '[^s]s$') THEN {w}[1:length({w}) - 1] WHEN ends_with({w}, 'ss') THEN {w} || 's' WHEN ends_with({w}, 'y') THEN NULL WHEN regexp_matches({w}, '(sh|ch|x|z)$') THEN {w} || 'es' ELSE {w} || 's' END], lambda f: f IS NOT NULL)"""


def _words(name: str, less: list[str], least: int = 2) -> str:
    text = f"regexp_replace(replace(lower({name}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g')"
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: length(w) >= {least} AND w NOT IN ({quoted(less)}))"


#: Candidate domains of the names in ``asked`` (name, country), none of which has a word in capitals.
CANDIDATES = {
    "cleaned": f"""SELECT name, country, {_words('name', V.ARTICLES + V.ENTITY_SUFFIXES + V.TRADE_WORDS)} AS brand, {_words('name', V.ENTITY_SUFFIXES + V.TRADE_WORDS)} AS articles, {_words('name', V.ENTITY_SUFFIXES)} AS plain,
        list_filter(regexp_split_to_array(regexp_replace(replace(lower(name), '&', 'and'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2) AS raw FROM (SELECT DISTINCT name, country FROM asked)""",
    "joined_words": """SELECT name, country, kind, w, array_to_string(w, '') AS whole, array_to_string(w[1:2], '') AS two, array_to_string(w[1:3], '') AS three, array_to_string(w[1:4], '-') AS dashed, array_to_string(w[1:2], '-') AS dashed_two
        FROM (SELECT name, country, 'brand' AS kind, brand AS w FROM cleaned UNION ALL SELECT name, country, 'brand', articles FROM cleaned
            UNION ALL SELECT name, country, 'full', plain FROM cleaned WHERE plain <> brand AND plain <> articles UNION ALL SELECT name, country, 'raw', raw FROM cleaned WHERE len(plain) > 0)""",
    "first_bases": """SELECT name, country, whole AS base FROM joined_words WHERE len(w) > 0 AND (kind = 'brand' AND length(whole) BETWEEN 4 AND 40 OR kind = 'full' AND length(whole) BETWEEN 5 AND 40 OR kind = 'raw' AND len(w) >= 2 AND length(whole) BETWEEN 6 AND 35)
        UNION SELECT name, country, w[1] FROM joined_words WHERE kind = 'brand' AND (len(w) = 1 AND length(w[1]) >= 4 OR len(w) = 2 AND length(w[1]) >= 10)
        UNION SELECT name, country, two FROM joined_words WHERE kind <> 'raw' AND len(w) >= 2 AND length(two) BETWEEN 4 AND 30 UNION SELECT name, country, three FROM joined_words WHERE kind = 'brand' AND len(w) >= 3 AND length(three) BETWEEN 5 AND 35
        UNION SELECT name, country, dashed FROM joined_words WHERE kind <> 'raw' AND len(w) >= 2 AND length(dashed) <= 40 UNION SELECT name, country, dashed_two FROM joined_words WHERE kind = 'brand' AND len(w) >= 2""",
    "respelt": """SELECT name, country, base FROM first_bases UNION SELECT name, country, base[1:length(base) - 2] FROM first_bases WHERE length(base) > 6 AND regexp_matches(base, '(ain|een)$')
        UNION SELECT name, country, base[1:length(base) - 1] FROM first_bases WHERE length(base) > 6 AND ends_with(base, 'ain')
        UNION SELECT name, country, base[length(p) + 1:] FROM first_bases, (VALUES ('al-'), ('el-'), ('al'), ('el')) AS v(p) WHERE length(base) > 6 AND starts_with(base, p) AND length(base) > length(p) + 3 AND base[length(p) + 1] <> '-'""",
    "bases": f"""SELECT DISTINCT name, country, regexp_extract(base, '^(.*-)?[^-]*$', 1) || f AS base FROM (SELECT name, country, base, unnest({forms("regexp_extract(base, '([^-]*)$', 1)")}) AS f FROM respelt)""",
    "endings": " UNION ALL ".join(f"SELECT {code} AS country, k, tld FROM (VALUES {', '.join(f'({k}, {quoted([t])})' for k, t in enumerate(tlds))}) AS v(k, tld)" for code, tlds in [*((quoted([c]), t) for c, t in V.COUNTRY_TLDS.items()), ("NULL", V.OTHER_TLDS)]),
    "candidates": f"""SELECT name, b.country, CAST(row_number() OVER (PARTITION BY name, b.country ORDER BY length(base) DESC, base, k) - 1 AS INTEGER) AS pos, base || tld AS domain FROM bases b
        JOIN endings e ON e.country IS NOT DISTINCT FROM CASE WHEN b.country IN ({quoted(list(V.COUNTRY_TLDS))}) THEN b.country END WHERE length(base) BETWEEN 3 AND 40""",
}

TITLE = r"lower(regexp_replace(regexp_extract(html[1:5000], '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')[1:200])"
_META = " || ' ' || ".join(
    f"""regexp_extract(html[1:5000], '(?i)<meta[^>]*{kind}=["'']{value}["''][^>]*content=["'']([^"'']+)', 1) || ' ' || regexp_extract(html[1:5000], '(?i)<meta[^>]*content=["'']([^"'']+)["''][^>]*{kind}=["'']{value}["'']', 1)"""
    for kind, value in (("name", "description"), ("property", "og:title"), ("property", "og:site_name"))
)
_SPLIT = r"'[^\p{L}\p{M}\p{N}\p{Pc}]+'"
_IN = lambda words, w: f"list_has_any({words}, {forms(w)})"
_GENERIC = quoted(V.ENTITY_SUFFIXES + V.TRADE_WORDS + V.LOCATION_WORDS)

#: Ownership of pages that answer with 200 and do not redirect, for rows of ``tried`` (name, url, html and other columns).
OWNERSHIP = {
    "titled": f"SELECT *, {TITLE} AS title, lower({_META}) AS meta, lower(html[1:5000]) AS head, {host('url')} AS h, list_distinct({_words('name', V.PAGE_STOP_WORDS, 3)}) AS words FROM tried",
    "split": f"SELECT *, replace(split_part(h, '.', 1), '-', '') AS base, replace(replace(title, '-', ''), ' ', '') AS squeezed, regexp_split_to_array(title, {_SPLIT}) AS title_words, regexp_split_to_array(meta, {_SPLIT}) AS meta_words, regexp_split_to_array(title || ' ' || meta || ' ' || head, {_SPLIT}) AS text_words FROM titled",
    "matched": f"""SELECT *, list_filter(words, lambda w: {_IN('text_words', 'w')}) AS found, list_filter(words, lambda w: {_IN('title_words', 'w')}) AS found_in_title, list_filter(words, lambda w: {_IN('meta_words', 'w')}) AS found_in_meta,
        squeezed <> '' AND squeezed IN (replace(h, '-', ''), base, replace(replace(h, '-', ''), '.', '')) AS echo, length(base) >= 12 AND contains(title || ' ' || meta || ' ' || head, base) AS based FROM split""",
    "counted": f"SELECT *, len(words) AS n, len(found) AS f, list_filter(found, lambda w: w NOT IN ({_GENERIC})) AS own, len(list_filter(found, lambda w: length(w) >= 5)) AS long_found FROM matched",
    "judged": f"""SELECT *, CASE WHEN length(html) < 500 THEN 'small' WHEN len(list_filter([{quoted(V.PAGE_PARKED_MARKS)}], lambda m: contains(lower(html[1:8000]), m))) > 0 THEN 'parked' WHEN n = 0 THEN NULL WHEN echo AND length(html) < 10000 THEN 'domain_title'
        WHEN NOT based AND f > 0 AND len(own) = 0 THEN 'generic_words' WHEN NOT based AND f = 0 THEN 'no_words'
        WHEN NOT based AND (n >= 4 AND len(own) < 2 OR n = 3 AND len(own) < 2 AND len(list_filter(own, lambda w: length(w) >= 7)) = 0) THEN 'few_words'
        WHEN NOT based AND n = 2 AND (long_found = 0 OR len(list_filter(words, lambda w: length(w) >= 5)) = 2 AND long_found < 2) THEN 'short_words'
        WHEN NOT based AND n = 1 AND NOT list_contains(CASE WHEN echo THEN found_in_meta ELSE found_in_title END, words[1]) THEN 'single_word'
        WHEN title <> '' AND n >= 2 AND len(list_filter(found_in_title, lambda w: w NOT IN ({_GENERIC}))) = 0 THEN 'title' END AS rejected_by FROM counted""",
}


def sql(body: str, **more: str) -> str:
    """A query over the entities it names, directly or through others, and the tables."""
    parts = ENTITIES | more
    ordered: list[str] = []

    def need(text: str, within: tuple[str, ...] = ()) -> None:
        """Names that a text uses, those that they use first."""
        words = {w.strip("(),;.").split(".")[0] for w in text.replace("(", " ").replace(")", " ").split()}
        for name in parts:
            if name in words and name not in ordered and name not in within:
                need(parts[name], (*within, name))
                ordered.append(name)

    need(body)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in ordered) + " " if ordered else "") + body
