"""Further registered queries: predicates on URLs and names, places, incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import text as X
from prospectra.operators import domains as D
from prospectra.operators import evidence as E
from prospectra.operators import leads as L
from prospectra.operators import scoring as S
from prospectra.operators import sites
from prospectra.operators import windows as W
from prospectra.operators import writers as Wr
from prospectra.sources import entities as N
from prospectra.sources import poi as P
from prospectra.streaming import jobs

from . import passes
from .oracle import CANDIDATES, ENTITIES, OWNERSHIP, host
from .queries import _csv, _int, _part_tags, _search_results, query, scored

PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
PARTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"


@query(rf"""SELECT page_id, len({PARTS}) = 0 OR (len({PARTS}) = 1 AND length({PARTS}[1]) <= 20) AS is_root,
    len({PARTS}) >= 4 OR regexp_matches({PATH}, '[0-9]{{4}}[/-][0-9]{{2}}[/-][0-9]{{2}}') OR len(list_filter({PARTS}, lambda s: length(s) - length(replace(s, '-', '')) >= 5)) > 0
    OR (len({PARTS}) = 3 AND length({PARTS}[3]) >= 30) AS is_article,
    regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '://([^/?#:]*)', 1) || '/' AS root_url FROM pages""")
def url_predicates(spark, d):
    return N.table(spark, d, "pages").select("page_id", X.is_root_url("url").alias("is_root"), X.looks_like_article("url").alias("is_article"), X.to_root_url("url").alias("root_url"))


@query("SELECT page_id, lower(trim(regexp_extract(html[1:5000], '(?is)<title[^>]*>(.*?)</title>', 1)))[1:200] AS title FROM pages")
def page_titles(spark, d):
    return N.table(spark, d, "pages").select("page_id", X.page_title("html").alias("title"))


@query(f"""SELECT page_id, x = y OR (contains(CASE WHEN length(x) <= length(y) THEN y ELSE x END, CASE WHEN length(x) <= length(y) THEN x ELSE y END)
    AND (least(length(x), length(y)) >= 0.6 * greatest(length(x), length(y)) OR (starts_with(CASE WHEN length(x) <= length(y) THEN y ELSE x END, CASE WHEN length(x) <= length(y) THEN x ELSE y END) AND least(length(x), length(y)) >= 10))) AS related
    FROM (SELECT p.page_id, replace(split_part({host("p.url")}, '.', 1), '-', '') AS x, replace(split_part({host("q.url")}, '.', 1), '-', '') AS y FROM pages p JOIN pages q ON q.page_id = p.page_id + 1)""")
def related_domain_pairs(spark, d):
    """Each page's host with the next page's, as if the one had led to the other."""
    pages = N.table(spark, d, "pages").select("page_id", X.url_host("url").alias("a"))
    return pages.join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b")), "page_id").select("page_id", X.related_domains("a", "b").alias("related"))


@query("""SELECT business_id, b.name || ' ' || c.name || '|"' || CASE WHEN business_id % 17 = 0 AND length('biz' || business_id) >= 3 THEN 'biz' || business_id || ' com' ELSE split_part(b.name, '#', 2) || ' customer' END || '" ' || c.name || '|"' || b.name || '" ' || c.name AS queries
    FROM businesses b JOIN cities c USING (city_id)""")
def search_query_texts(spark, d):
    c = N.cities(spark, d).select("city_id", F.col("name").alias("city"))
    return N.businesses(spark, d).join(c, "city_id").select("business_id", F.array_join(X.search_queries("name", "city"), "|").alias("queries"))


@query("""SELECT DISTINCT w AS word, w || CASE WHEN length(w) <= 4 OR ends_with(w, 'y') THEN '' WHEN regexp_matches(w, '(sh|ch|x|z)$') THEN ',' || w || 'es' WHEN regexp_matches(w, '(ses|xes|zes)$') THEN ',' || w[1:length(w) - 2]
    WHEN regexp_matches(w, '[^s]s$') THEN ',' || w[1:length(w) - 1] ELSE ',' || w || 's' END AS forms FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part)""")
def plural_forms(spark, d):
    words = N.table(spark, d, "part").select(F.split("p_name", " ")[1].alias("word")).distinct()
    return words.select("word", F.array_join(X.plural_forms("word"), ",").alias("forms"))


@query("""SELECT CAST(least(floor((c_custkey % 97 / 10.0) / 2.5), 3) * 4 + least(floor((c_custkey % 89 / 10.0) / 2.5), 3) AS BIGINT) AS tile, count(*) AS n FROM customer
    WHERE c_custkey % 97 / 10.0 BETWEEN 0 AND 10 AND c_custkey % 89 / 10.0 BETWEEN 0 AND 10 GROUP BY 1""")
def tile_counts(spark, d):
    at = N.table(spark, d, "customer").select((F.col("c_custkey") % 97 / 10.0).alias("lat"), (F.col("c_custkey") % 89 / 10.0).alias("lon"))
    return at.select(P.tile_of(0.0, 0.0, 10.0, 10.0, 4).alias("tile")).filter("tile IS NOT NULL").groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS business_id, 'phone' AS contact_type, '+1-555-' || c_custkey AS value FROM customer WHERE c_custkey % 2 = 1")
def contact_backfill(spark, d):
    """Contacts in tags that the table does not hold yet."""
    i = F.col("c_custkey").cast("string")
    tags = N.table(spark, d, "customer").select(F.col("c_custkey").alias("business_id"), F.create_map(F.lit("contact:phone"), F.concat(F.lit("tel:+1-555-"), i)).alias("tags"))
    return Wr.absent(P.contacts(tags, "business_id"), N.business_contacts(spark, d), ["business_id", "contact_type", "value"])


@query(r"""SELECT n.page_id AS business_id, 'e1,e2' AS engines, count(*) AS results, count(*) FILTER (rank < 4) AS outside_directories
    FROM pages n, (SELECT unnest(range(1, 6)) AS rank) g, pages p WHERE p.page_id = (n.page_id + g.rank + (SELECT count(*) FROM pages) - 2) % (SELECT count(*) FROM pages)
    AND (n.page_id % 3 <> 0 OR p.page_id <> n.page_id) GROUP BY 1""")
def engine_coverage(spark, d):
    _, results = _search_results(spark, d)
    marked = results.withColumn("engines", F.when(F.col("rank") % 2 == 0, F.array(F.lit("e1"))).otherwise(F.array(F.lit("e2"), F.lit("e1"))))
    marked = marked.withColumn("href", F.when(F.col("rank") == 5, "https://m.yelp.com/biz/x").when(F.col("rank") == 4, "https://www.facebook.com/x").otherwise(F.col("href")))
    return E.engine_coverage(marked).select("business_id", _csv("engines"), "results", "outside_directories")


@query("""SELECT event_id AS business_id, CASE event_type WHEN 'click' THEN 'has_website' WHEN 'view' THEN 'no_website' ELSE 'not_sure' END AS result,
    CASE WHEN event_type = 'click' THEN 'http://e' || event_id || '/' END AS website FROM events""")
def judged_verdicts(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "click", "has_website").when(kind == "view", "no_website").otherwise(kind)
    site = F.concat(F.lit("http://e"), F.col("event_id").cast("string"), F.lit("/"))
    return E.judged_verdicts(N.table(spark, d, "events").select(F.col("event_id").alias("business_id"), F.to_json(F.struct(status.alias("status"), site.alias("website"))).alias("verdict")))


@query("""SELECT b.business_id, coalesce(website_url, w) AS website_url FROM businesses b LEFT JOIN (SELECT business_id, 'http://' || source || '/' AS w FROM verifications WHERE result = 'has_website'
    QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY checked_at DESC, source DESC) = 1) USING (business_id)""")
def apply_websites(spark, d):
    site = F.when(F.col("result") == "has_website", F.concat(F.lit("http://"), "source", F.lit("/")))
    return E.apply_websites(N.businesses(spark, d), N.verifications(spark, d).withColumn("website", site)).select("business_id", "website_url")


def _branded():
    return F.col("brand").isNotNull()


@query("SELECT business_id, lead_score, confidence, reason FROM scored", verifications=f"SELECT * FROM ({ENTITIES['verifications']}) WHERE source <> 'searxng'")
def reset_source(spark, d):
    _, out = passes.reset_source(N.businesses(spark, d), N.business_contacts(spark, d), N.links(spark, d), N.verifications(spark, d), "searxng", _branded())
    return out.select("business_id", _int("lead_score"), "confidence", "reason")


def _observed(spark, d):
    """What was observed of the pages' domains and of half of those that businesses name, which are hosted."""
    pages = N.observations(spark, d).drop("html").withColumn("is_parked", F.col("observation") % 9 == 0)
    named = N.businesses(spark, d).filter("business_id % 10 = 0").select(F.concat(F.lit("biz"), F.col("business_id").cast("string"), F.lit(".example.com")).alias("domain"), F.lit(1).cast("long").alias("observation"), F.lit(True).alias("has_a"))
    return pages.unionByName(named, allowMissingColumns=True)


#: Domains once those that businesses name are there and what was new is classified, and links with their statuses.
CHECKED = {
    "seen": f"SELECT {host('url')} AS domain, max(page_id) AS p FROM pages GROUP BY 1",
    "checked": """SELECT domain, CASE WHEN status <> 'new' THEN status WHEN p IS NULL THEN CASE WHEN domain IN (SELECT 'biz' || business_id || '.example.com' FROM businesses WHERE business_id % 10 = 0) THEN 'hosted' ELSE 'rdap_error' END
        WHEN p % 9 = 0 THEN 'parked' WHEN p % 5 = 0 OR p % 11 = 0 OR p % 13 = 0 OR p % 7 = 0 OR p % 17 = 0 THEN 'hosted' WHEN p % 3 = 0 THEN 'registered_no_web'
        WHEN p % 2 = 0 THEN 'registered_dns_only' WHEN p % 19 = 0 THEN 'dns_error' ELSE 'unregistered_candidate' END AS status
        FROM (SELECT domain, status FROM domains UNION ALL SELECT DISTINCT domain, 'new' FROM wanted WHERE domain NOT IN (SELECT domain FROM domains)) LEFT JOIN seen USING (domain)""",
    "old_links": ENTITIES["links"],
    "links": "SELECT business_id, domain, status FROM (SELECT business_id, domain FROM old_links UNION SELECT business_id, domain FROM wanted) JOIN checked USING (domain)",
}


@query("SELECT domain, status FROM checked", **CHECKED)
def validated_domains(spark, d):
    return _validated(spark, d)["domains"].select("domain", "status")


@query("SELECT business_id, lead_score, reason, domains FROM scored", **CHECKED)
def validate_domains(spark, d):
    """Scores after the domains that businesses name are synced and classified."""
    return _validated(spark, d)["scored"].select("business_id", _int("lead_score"), "reason", _csv("domains", ";"))


def _validated(spark, d):
    return passes.validate_domains(N.businesses(spark, d), N.business_contacts(spark, d), N.domains(spark, d), N.links(spark, d), _observed(spark, d), N.verifications(spark, d), _branded())


@query("""SELECT 'after' AS page, event_id FROM (SELECT event_id FROM events, (SELECT ts AS t, event_id AS e FROM events WHERE event_id = 100) WHERE ts > t OR (ts = t AND event_id > e) ORDER BY ts, event_id LIMIT 100)
    UNION ALL SELECT 'start', event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100)""")
def keyset_page(spark, d):
    """The page after a cursor, and the one that a cursor which does not read gives: the first."""
    e = N.table(spark, d, "events")
    own = X.cursor("ts", "event_id")  # a cursor tells seconds; the row that it names has them all
    at = e.filter("event_id = 100").select("ts", X.parse_cursor(own)["key"].cast("long").alias("key"), X.parse_cursor(F.lit("no cursor"))["at"].alias("none")).first()
    pages = {"after": W.after_cursor(e, "ts", "event_id", at["ts"], at["key"]), "start": W.after_cursor(e, "ts", "event_id", at["none"], None)}
    some = [x.orderBy("ts", "event_id").limit(100).select(F.lit(name).alias("page"), "event_id") for name, x in pages.items()]
    return some[0].unionByName(some[1])


@query("SELECT domain, n IS NOT NULL AS has_crawl_data, coalesce(n, 0) AS record_count FROM domains LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = domain_id")
def crawl_summary(spark, d):
    names = N.domains(spark, d).select("domain", "domain_id")
    lines = N.table(spark, d, "events").select(F.col("user_id").alias("domain_id"), F.col("ts").alias("timestamp")).join(names, "domain_id").select("domain", "timestamp")
    return P.crawl_summary(names.select("domain"), lines).select("domain", "has_crawl_data", "record_count")


@query("SELECT event_id, 'leads_' || strftime(ts, '%Y%m%d') AS platform, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || event_id AS cursor FROM events")
def time_texts(spark, d):
    return N.table(spark, d, "events").select("event_id", X.platform_for_day("ts", "leads").alias("platform"), X.iso_time("ts").alias("at"), X.cursor("ts", "event_id").alias("cursor"))


@query("SELECT name, country FROM (SELECT n_name || '_x' AS name, NULL AS country FROM nation UNION SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'AE' WHEN 1 THEN 'CA' WHEN 2 THEN 'US' END FROM nation WHERE n_nationkey < 0)")
def missing_cities(spark, d):
    """Areas whose city is not there: none of the known ones, all of the renamed ones."""
    from prospectra.operators.joins import cities_for

    known = N.cities(spark, d)
    renamed = known.select(F.concat("name", F.lit("_x")).alias("name"), F.lit(None).cast("string").alias("country"), "region")
    return cities_for(known.select("name", "country", "region").unionByName(renamed), known).select("name", "country")


@query("SELECT business_id, name FROM scored WHERE n_phones = 0 ORDER BY website_url IS NOT NULL, lead_score DESC, created_at, business_id LIMIT 25")
def no_phone_queue(spark, d):
    rows = L.without_contact(scored(spark, d), N.business_contacts(spark, d), "phone")
    return W.work_queue(rows, F.col("website_url").isNull()).limit(25).select("business_id", "name")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 1 AND split_part(p_name, ' ', 2) = 'ring' THEN 'shop_of_rings' WHEN p_size % 5 = 3 THEN 'stay' WHEN p_size % 5 = 4 AND p_partkey % 2 = 0 THEN 'coffee' END AS category FROM part")
def first_matching_filter(spark, d):
    """Crafts match the first filter, which names no category, and so never the third; most shops match none."""
    filters = [("any_craft", {"craft": "*"}), ("shop_of_rings", {"shop": "ring"}), ("maker", {"craft": "ring"}), ("stay", {"tourism": None}), ("coffee", {"amenity": "cafe"}), ("any_cafe", {"amenity": "cafe"})]
    return _part_tags(spark, d).select("p_partkey", P.match_category(filters).alias("category"))


def _scores_of(spark, d):
    """Scores of some businesses: their ids reach every table below the aggregations."""

    def scores(ids, verifications):
        of = lambda rows: rows.join(ids, "business_id", "left_semi")
        tables = [of(t) for t in (N.businesses(spark, d), N.business_contacts(spark, d), N.links(spark, d), verifications)]
        return S.score_businesses(*tables, _branded()).select("business_id", _int("lead_score"), "confidence")

    return scores


@query("SELECT business_id, lead_score, confidence FROM scored WHERE business_id IN (SELECT business_id FROM verifications)")
def stream_rescore(spark, d):
    """Scores of the businesses that a stream of evidence touches, as its batches leave them."""
    folder = jobs.run_folder(spark)
    source = f"{folder}/evidence"
    N.verifications(spark, d).write.parquet(source)
    stream = jobs.new_files(spark, source, N.verifications(spark, d).schema)
    scores = _scores_of(spark, d)
    jobs.rescore_stream(stream, lambda ids: scores(ids, N.verifications(spark, d)), f"{folder}/scores", f"{folder}/progress").awaitTermination()
    return W.latest(spark.read.parquet(f"{folder}/scores"), ["business_id"], "batch").select("business_id", "lead_score", "confidence")


@query("SELECT business_id, lead_score, confidence FROM scored WHERE business_id IN (SELECT business_id FROM verifications)",
    verifications="SELECT page_id AS business_id, 'ddg' AS source, 'no_website' AS result FROM pages WHERE page_id IN (SELECT business_id FROM businesses)")
def stream_verify(spark, d):
    """Search results as a stream: each batch becomes evidence, and what it touches is scored anew."""
    folder = jobs.run_folder(spark)
    _, results = _search_results(spark, d)
    named = N.businesses(spark, d)
    results.join(named, "business_id", "left_semi").write.parquet(f"{folder}/found")
    scores, found = _scores_of(spark, d), jobs.new_files(spark, f"{folder}/found", results.schema)

    def verdicts(batch):
        return Wr.evidence_row("ddg", E.search_verdicts(named.join(batch, "business_id", "left_semi"), batch), F.lit("1998-01-01").cast("timestamp_ntz"))

    jobs.verify_stream(found, verdicts, f"{folder}/evidence", scores, f"{folder}/scores", f"{folder}/progress").awaitTermination()
    return W.latest(spark.read.parquet(f"{folder}/scores"), ["business_id"], "batch").select("business_id", "lead_score", "confidence")


@query("SELECT user_id AS business_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def stream_insert(spark, d):
    """Evidence inserted by a stream that runs twice; the second run finds nothing new."""
    folder = jobs.run_folder(spark)
    N.verifications(spark, d).select("business_id", "source", "result").write.parquet(f"{folder}/in")
    schema = "business_id long, source string, result string"
    for progress in ("a", "b"):
        jobs.insert_stream(jobs.new_files(spark, f"{folder}/in", schema), f"{folder}/table", ["business_id", "source"], f"{folder}/{progress}").awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT business_id, 'website' AS source FROM businesses WHERE website_url IS NOT NULL UNION ALL SELECT business_id, 'email' FROM contacts WHERE contact_type = 'email' AND NOT value LIKE '%@gmail.com' AND business_id % 5 <> 0")
def business_domains(spark, d):
    return D.business_domains(N.businesses(spark, d), N.business_contacts(spark, d)).select("business_id", "source")


@query("""SELECT business_id, category, lead_score, n_domains AS domain_count, n_active > 0 AS has_active_domain, domains FROM scored""")
def score_reasons(spark, d):
    r = scored(spark, d).select("business_id", _int("lead_score"), S.score_reasons())
    return r.select("business_id", "score_reasons.category", "lead_score", F.col("score_reasons.domain_count").alias("domain_count"), "score_reasons.has_active_domain", _csv("score_reasons.domains", ";").alias("domains"))


@query("""SELECT b.business_id, CASE WHEN n IS NULL THEN 'no_candidates' WHEN website IS NOT NULL THEN 'has_website' ELSE 'no_match' END AS result, website, coalesce(n, 0) AS candidate_count FROM asked b
    LEFT JOIN (SELECT name, country, count(*) AS n FROM candidates GROUP BY ALL) c ON c.name = b.name AND c.country IS NOT DISTINCT FROM b.country
    LEFT JOIN (SELECT name, country, url AS website FROM judged WHERE rejected_by IS NULL QUALIFY row_number() OVER (PARTITION BY name, country ORDER BY length(split_part(domain, '.', 1)) DESC, pos, url) = 1) w ON w.name = b.name AND w.country IS NOT DISTINCT FROM b.country""",
    **CANDIDATES, **OWNERSHIP,
    labelled=rf"SELECT page_id, html, regexp_extract({host('url')}, '^(?:m\.)?([^.]+)', 1) AS label FROM pages",
    asked="SELECT page_id AS business_id, upper(label[1]) || label[2:] AS name, CASE WHEN page_id % 2 = 0 THEN 'CA' END AS country FROM labelled",
    live="SELECT label || '.com' AS domain, 'http://' || label || '.com/' AS url, replace(html, '<title>', '<title>' || label || ' ') AS html FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY page_id) = 1",
    tried="SELECT name, country, pos, domain, url, html FROM candidates JOIN live USING (domain)")
def name_to_site(spark, d):
    """Businesses named by the words of a page's host, tried against sites of one-label domains with that page's text."""
    label = F.regexp_extract(X.url_host("url"), r"^(?:m\.)?([^.]+)", 1)
    pages = N.table(spark, d, "pages").select("page_id", label.alias("label"), "html")
    named = pages.select(F.col("page_id").alias("business_id"), F.initcap("label").alias("name"), F.when(F.col("page_id") % 2 == 0, "CA").alias("country"))
    titled = F.regexp_replace("html", "<title>", F.concat(F.lit("<title>"), F.col("label"), F.lit(" ")))
    live = W.keep_first(pages, ["label"], "page_id").select(F.concat(F.lit("http://"), "label", F.lit(".com/")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status_code"), titled.alias("html"))
    return sites.name_to_site(named, live)


@query("SELECT business_id FROM businesses WHERE business_id NOT IN (SELECT business_id FROM verifications WHERE source = 'searxng')")
def unverified_queue(spark, d):
    return E.unverified_by(N.businesses(spark, d), N.verifications(spark, d), "searxng").select("business_id")


@query("""SELECT business_id, b.name || ' ' || c.name || '|' || b.name || ' website|' || b.name || ' ' || category || CASE WHEN c.country IS NOT NULL THEN ' ' || c.country ELSE '' END AS context, b.name || ' ' || c.name AS place
    FROM businesses b JOIN cities c USING (city_id)""")
def context_query_texts(spark, d):
    c = N.cities(spark, d).select("city_id", F.col("name").alias("city"), "country")
    none = F.lit(None).cast("string")
    return N.businesses(spark, d).join(c, "city_id").select("business_id", F.array_join(X.context_queries("name", "city", "category", "country"), "|").alias("context"), X.place_query("name", none, "city").alias("place"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) END AS key FROM events""")
def parsed_cursors(spark, d):
    """Cursors written and read again; every fifth is broken and reads as none."""
    text = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, "no time|1").otherwise("1998-01-01T00:00:00")).otherwise(X.cursor("ts", "event_id"))
    read = X.parse_cursor(text)
    return N.table(spark, d, "events").select("event_id", F.date_format(read["at"], "yyyy-MM-dd HH:mm:ss").alias("at"), read["key"].alias("key"))


@query("""SELECT b.p_partkey AS business_id, list_contains(string_split(p.p_name, ' '), split_part(b.p_name, ' ', 1)) OR list_contains(string_split(p.p_name, ' '), split_part(b.p_name, ' ', 2)) AS matches
    FROM part b JOIN part p ON p.p_partkey = b.p_partkey + 1""")
def title_match(spark, d):
    """A part's name against the next part's as a page title: both have two words, one of which is half."""
    parts = N.table(spark, d, "part").select(F.col("p_partkey").alias("business_id"), F.col("p_name").alias("name"))
    titles = parts.select((F.col("business_id") - 1).alias("business_id"), F.col("name").alias("title"))
    return parts.join(titles, "business_id").select("business_id", X.title_matches_name("title", F.lit("http://x.example/"), "name").alias("matches"))


@query("""SELECT domain_id, p_partkey AS area FROM (SELECT p_partkey, p_size - 10 AS south, p_size + 10 AS north FROM part WHERE p_partkey % 100 = 0) JOIN (SELECT domain_id, domain_id % 50 AS lat FROM domains) ON lat BETWEEN south AND north""")
def places_in_areas(spark, d):
    """Points in latitude bands: bands and points meet by whole degrees, then the box is checked."""
    areas = N.table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("area"), (F.col("p_size") - 10).alias("south"), (F.col("p_size") + 10).alias("north")).withColumns({"west": F.lit(-1), "east": F.lit(1)})
    points = N.domains(spark, d).select("domain_id", (F.col("domain_id") % 50).cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    return P.in_areas(points, areas).select("domain_id", "area")


@query("""SELECT p_partkey AS business_id, CASE WHEN strong OR titled THEN 'has_website' ELSE 'no_website' END AS result, CASE WHEN strong THEN 'http://' || h || '/' WHEN titled THEN 'http://site' || p_partkey || '.org/' END AS website
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN b || '-' || a || '-shop.com' ELSE b || 'works-online.net' END AS h, p_partkey % 4 = 0 AND length(a) >= 4 AND length(b) >= 4 OR p_partkey % 4 = 1 AS strong, p_partkey % 4 = 2 AND same AS titled
        FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, coalesce(p_name = lead(p_name) OVER (ORDER BY p_partkey), false) AS same FROM part))""")
def search_rules(spark, d):
    """Hosts that hold two of a name's words, or one long one, then titles on root pages, and directories, which never win."""
    i, a, b = F.col("p_partkey"), F.col("_w")[0], F.col("_w")[1]
    parts = N.table(spark, d, "part").withColumn("_w", F.split("p_name", " "))
    after = parts.select((i - 1).alias("p_partkey"), F.col("p_name").alias("_next"))
    rows = parts.join(after, "p_partkey", "left").withColumn("_kind", i % 4)
    kind = lambda k: F.col("_kind") == k
    named = rows.select(i.alias("business_id"), F.when(kind(1), F.concat(F.initcap(a), F.lit(" "), b, F.lit("works"))).otherwise(F.initcap("p_name")).alias("name"))
    href = F.when(kind(0), F.concat(F.lit("http://"), b, F.lit("-"), a, F.lit("-shop.com/about/us"))).when(kind(1), F.concat(F.lit("http://www."), b, F.lit("works-online.net/a/b")))
    href = href.when(kind(2), F.concat(F.lit("http://site"), i.cast("string"), F.lit(".org/"))).otherwise(F.concat(F.lit("https://www.facebook.com/"), a, b))
    own = rows.select(i.alias("business_id"), F.lit(1).alias("query_no"), F.lit(2).alias("rank"), href.alias("href"), F.upper("_next").alias("title"))
    first = rows.select(i.alias("business_id"), F.lit(1).alias("query_no"), F.lit(1).alias("rank"), F.lit("https://www.yelp.com/biz").alias("href"), F.col("p_name").alias("title"))
    found = E.search_verdicts(named, own.unionByName(first)).select("business_id", "result", "website")
    return found.withColumn("website", F.regexp_replace("website", "://www[.]", "://"))


from . import file_queries, pass_queries, table_queries  # noqa: E402, F401  register themselves
