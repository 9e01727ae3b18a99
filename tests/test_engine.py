"""Scores, leads, exports, writers and streams on small tables, and every query against SQL."""

import datetime as dt
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__
from prospectra.operators import domains as D
from prospectra.operators import evidence as E
from prospectra.operators import joins as J
from prospectra.operators import leads as L
from prospectra.operators import scoring as S
from prospectra.operators import sites
from prospectra.operators import writers as Wr
from prospectra.plans import passes
from prospectra.plans import queries as Q
from prospectra.sources import poi as P
from prospectra.sources.elements import read_elements
from prospectra.streaming import jobs

SMALL = "/root/testdata/sf0.001"
BUSINESS = "business_id long, name string, category string, website_url string, brand string, created_at date"
CONTACT = "business_id long, contact_type string, value string"
LINK = "business_id long, domain_id long, domain string, status string"
EVIDENCE = "business_id long, source string, result string, website string, checked_at timestamp"
LEDGER = "business_id long, platform string, exported_on date"


def same(x):
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = Q.QUERIES[name](spark, SMALL).toPandas(), db.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got) == same(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["business_id", "name", "lead_score", "confidence", "reason"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def leads_fixture(spark):
    """Seven bakeries: no contact, parked, two ties, an unscored one, one that is too low, one with a website."""
    old, young = dt.date(2023, 5, 1), dt.date(2023, 6, 1)
    values = [
        (11, "Rye Corner", 72, None, old, "high", 1), (12, "Oven Street", 70, None, old, "low", 1), (13, "Two Loaves", 65, None, young, "medium", 2), (14, "Crumb Lane", 65, None, old, "low", 1),
        (15, "Seeds", None, None, old, "high", 1), (16, "Day Old", 20, "", old, "unverified", 2), (17, "Baguette Online", 80, "http://b.example", old, "high", 2),
    ]
    scored = spark.createDataFrame(values, "business_id long, name string, lead_score int, website_url string, created_at date, confidence string, city_id int")
    contacts = spark.createDataFrame([(i, "phone", str(i)) for i in (12, 13, 14, 15, 16, 17)], CONTACT)
    links = spark.createDataFrame([(12, 7, "oven.example", "parked"), (13, 8, "loaves.example", "enriched"), (14, 9, "gmail.com", "hosted")], LINK)
    cities = spark.createDataFrame([(1, "North Haven"), (2, "Southport")], "city_id int, name string")
    return scored, contacts, links, cities


def names(df):
    return [r["name"] for r in df.orderBy(*L.best_first()).collect()]


def test_eligibility_comes_before_the_limit(spark):
    scored, contacts, links, cities = leads_fixture(spark)
    leads = lambda **how: L.eligible_leads(scored, contacts, links, **how)
    assert names(leads()) == ["Rye Corner", "Oven Street", "Crumb Lane", "Two Loaves", "Day Old"]
    assert names(leads(min_score=60, require_contact=True, exclude_active=True).orderBy(*L.best_first()).limit(1)) == ["Crumb Lane"]
    assert names(leads(require_qualified=True)) == ["Two Loaves"]
    assert names(leads(min_confidence="medium")) == ["Rye Corner", "Two Loaves"] and names(leads(verified_only=True, min_score=66)) == ["Rye Corner", "Oven Street"]
    assert names(leads(city="SOUTH", cities=cities)) == ["Two Loaves", "Day Old"]
    assert names(L.eligible_leads(scored.withColumn("city", F.lit("Here")), contacts, links, city="her", min_score=71)) == ["Rye Corner"]
    page = L.page_with_total(leads(), 2, 1).orderBy(*L.best_first()).collect()
    assert [(r["name"], r["total"]) for r in page] == [("Oven Street", 5), ("Crumb Lane", 5)]


def test_export_fills_its_limit(spark, tmp_path):
    scored, contacts, links, _ = leads_fixture(spark)
    ledger, day = spark.createDataFrame([], LEDGER), dt.date(2023, 7, 1)
    for wanted in (["Crumb Lane", "Two Loaves"], ["Day Old"], []):
        found, new = L.lead_export(L.eligible_leads(scored, contacts, links, require_contact=True, exclude_active=True), ledger, "mail", F.lit(day), 2)
        assert names(found) == wanted
        assert sorted(r["status"] for r in new.collect()) == ["queued"] * len(wanted)
        ledger = spark.createDataFrame(ledger.collect() + new.select("business_id", "platform", "exported_on").collect(), LEDGER)
    again, _ = L.lead_export(L.eligible_leads(scored, contacts, links), ledger, "letters", F.lit(day), 10, fresh_only=True)
    assert names(again) == ["Rye Corner", "Oven Street"]


def test_new_domains_count_in_the_same_pass(spark):
    """A business without a website whose address is on a new domain that turns out to be hosted is no lead."""
    b = spark.createDataFrame([(1, "Acme", "trades", None, None, dt.date(2024, 1, 1)), (2, "Beta", "trades", None, None, dt.date(2024, 1, 1))], BUSINESS)
    c = spark.createDataFrame([(1, "email", "a@acme.com"), (2, "email", "b@beta.com"), (2, "phone", "1")], CONTACT)
    seen = spark.createDataFrame([("acme.com", 1, True), ("beta.com", 1, False)], "domain string, observation long, has_a boolean")
    seen = seen.withColumns({x: F.lit(False) for x in ("has_aaaa", "has_cname", "has_mx", "has_ns", "has_http", "has_tcp", "dns_error", "is_parked")}).withColumn("rdap_status", F.lit(404))
    v = spark.createDataFrame([(i, "searxng", "no_website", None, None) for i in (1, 2)], EVIDENCE)
    domains = spark.createDataFrame([], "domain_id long, domain string, status string")
    got = passes.validate_domains(b, c, domains, spark.createDataFrame([], LINK), seen, v)
    assert rows(got["scored"].select("business_id", "lead_score", "reason")) == [(1, 0, "active_domain"), (2, 80, None)]
    assert rows(got["domains"].select("domain", "status")) == [("acme.com", "hosted"), ("beta.com", "unregistered_candidate")]
    assert got["new_links"].count() == 2 and got["domains"].filter("domain_id < 0").count() == 2


def test_places_give_phones(spark):
    b = spark.createDataFrame([(1, "Red Lion"), (2, "Blue Boar"), (3, "Green Man")], "business_id long, name string")
    place = "business_id long, rank int, place struct<name: string, website: string, national_phone: string, international_phone: string, rating: double, review_count: int>"
    places = spark.createDataFrame([(1, 1, ("The Red Lion", None, "", "+44 1", 4.5, 9)), (2, 1, ("Elsewhere", None, "2", None, None, None)), (3, 1, ("Green Man Pub", "http://g", "3", None, None, None))], place)
    known = spark.createDataFrame([(3, "phone", "3")], CONTACT)
    assert rows(passes.enrich_from_places(b, known, places)) == [(1, "phone", "+44 1"), (3, "phone", "3")]


def test_repeated_rows_and_first_elements(spark):
    urls = spark.createDataFrame([("http://a.b.com/", {"k": "v"}), ("http://a.b.com/", {"k": "v"}), ("http://xb.com/", {"k": "v"})], "url string, tags map<string,string>")
    assert J.under_domains(urls, "url", spark.createDataFrame([("b.com",)], "domain string")).count() == 2
    e = spark.createDataFrame([("node", 1, {"name": n, "phone": f"+{i}"}) for i, n in enumerate("CAB")] * 2, "type string, id long, tags map<string,string>")
    e = e.withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0), "center": F.lit(None).cast("struct<lat: double, lon: double>")}).repartition(4)
    b, c = P.import_elements(e)
    assert [r["name"] for r in b.collect()] == ["A"] and [r["value"] for r in c.collect()] == ["+1"]


def test_null_keys_never_collide(spark, tmp_path):
    new, path = spark.createDataFrame([(None, "a"), (1, "b"), (1, "a")], "id int, v string"), str(tmp_path / "t")
    assert Wr.insert_absent(new, path, ["id"]) == 2 and Wr.insert_absent(new, path, ["id"]) == 1
    assert rows(spark.read.parquet(path)) == [(1, "a"), (None, "a"), (None, "a")]


def test_empty_tables_score_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert S.score_businesses(none(BUSINESS), none(CONTACT), none(LINK), none(EVIDENCE)).count() == 0


@pytest.mark.parametrize(
    ("found", "level"),
    [([("domain_guess", "no_match"), ("searxng", "no_website")], "high"), ([("domain_guess", "no_match")], "medium"), ([("domain_guess", "no_match"), ("llm", "not_sure")], "medium"), ([("ddg", "no_results")], "low"), ([("google_search", "blocked")], "low"), ([("foursquare", "poor_match")], "low")],
)
def test_confidence(spark, found, level):
    v = spark.createDataFrame([(1, s, r) for s, r in found], "business_id long, source string, result string")
    assert E.confidence(v).first()["confidence"] == level


def test_score_rules(spark):
    day = dt.date(2024, 1, 1)
    b = spark.createDataFrame([(1, "A", "trades", None, None, day), (2, "B.com", "trades", None, None, day), (3, "C", "food", "http://c", None, day), (4, "D", "", None, "x", day), (5, "E", None, None, None, day), (6, "F", "trades", None, None, day)], BUSINESS)
    c = spark.createDataFrame([(1, "email", "a@a.com"), (1, "phone", "1"), (2, "email", "b@b.com"), (6, "email", "f@gmail.com"), (6, "phone", "6")], CONTACT)
    links = spark.createDataFrame([(6, 1, "f.com", "parked")], LINK)
    v = spark.createDataFrame([(1, "searxng", "has_website"), (1, "llm", "no_website"), (2, "llm", "no_website")], "business_id long, source string, result string")
    got = {r["business_id"]: (int(r["lead_score"]), r["reason"]) for r in S.score_businesses(b, c, links, v, F.col("brand").isNotNull()).collect()}
    assert got == {1: (80, None), 2: (15, "name_is_domain"), 3: (0, "has_website"), 4: (0, "branded_chain"), 5: (5, "no_contacts"), 6: (0, "active_domain")}


def test_score_invariants(spark):
    s = Q.scored(spark, SMALL)
    bad = (F.col("lead_score") < 0) | (F.col("lead_score") > 80) | (F.col("lead_score") != F.floor("lead_score"))
    bad = bad | (~F.col("has_email") & ~F.col("has_phone") & (F.col("lead_score") > 5)) | ((F.col("confidence") == "unverified") & (F.col("lead_score") > 35))
    assert s.filter(bad).count() == 0
    assert s.select(S.score_reasons()).count() == s.count()


def test_poi_import(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "N", "shop": "x", "phone": "tel:+1 / ⁦+2⁩ or none", "contact:email": "mailto:A@b.com; bad"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "M", "addr:street": "S", "addr:city": "C"}}, {"type": "node", "id": 3, "tags": {"shop": "x"}}]}')
    b, c = P.import_elements(read_elements(spark, str(tmp_path / "p.json")))
    assert rows(b.select("source_id", "name", "category", "address", "lat")) == [("node/1", "N", "retail", None, 1.0), ("way/2", "M", "other", "S, C", 3.0)]
    assert rows(c.select("contact_type", "value")) == [("email", "a@b.com"), ("phone", "+1"), ("phone", "+2")]
    first = [("any_shop", {"shop": "*"}), ("plumber", {"craft": "plumber"})]
    tags = spark.createDataFrame([({"shop": "x", "craft": "plumber"},), ({"craft": "plumber"},)], "tags map<string,string>")
    assert [r[0] for r in tags.select(P.match_category(first)).collect()] == [None, "plumber"]
    assert P.tiles(0, 0, 1, 1, 2, spark).count() == 4
    with pytest.raises(ValueError):
        P.tiles(1, 0, 1, 1, 2, spark)


def test_rdap_registrar(spark):
    doc = '{"entities": [{"roles": ["abuse"]}, {"roles": ["registrar"], "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "Names Inc"]]]}]}'
    assert spark.createDataFrame([(doc,)], "d string").select(P.registrar_of(F.col("d"))).first()[0] == "Names Inc"


def test_domain_records(spark):
    checks = spark.createDataFrame([("a.com", "www", "A", True, False, None), ("a.com", "www", "MX", True, False, None), ("b.com", "apex", "MX", True, False, None), ("c.com", "apex", "A", False, True, None)], "domain string, host_kind string, record string, found boolean, failed boolean, target string")
    got = {r["domain"]: r["s"] for r in D.fold_record_checks(checks).withColumns({"is_parked": F.lit(False), "has_http": F.lit(False), "has_tcp": F.lit(False)}).withColumn("s", D.domain_status()).collect()}
    assert got == {"a.com": "hosted", "b.com": "registered_no_web", "c.com": "dns_error"}


def test_chain_in_the_middle_of_a_word(spark):
    names = spark.createDataFrame([("MyPie Minister7",), ("Other",), ("abc",)], "name string")
    chains = J.chain_names(spark.createDataFrame([("Pie Minister",), (" abc ",), ("",)], "name string"))
    assert rows(J.names_with_chain(names, chains)) == [("MyPie Minister7", "pie minister"), ("abc", "abc")]


def test_writers_are_safe_to_repeat(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "t")
    assert Wr.insert_absent(new, path, ["id"]) == 2
    assert Wr.insert_absent(new, path, ["id"]) == 0
    changed = Wr.updated(spark.read.parquet(path), spark.createDataFrame([(1, "z")], "id int, v string"), "id")
    assert rows(changed.select("id", "v")) == [(1, "z"), (2, "b")]
    ledger = spark.createDataFrame([(1, "p", dt.date(2024, 1, 1))], LEDGER)
    Wr.append_ledger(ledger, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).filter("platform = 'p'").count() == 1
    Wr.write_csv(changed, str(tmp_path / "csv"))
    assert P.list_exports(spark, str(tmp_path / "csv")).count() >= 1


def test_streams_equal_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "business_id long, v string")
    new.write.parquet(source)
    jobs.insert_stream(jobs.new_files(spark, source, new.schema), target, ["business_id"], str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], new.schema).write.mode("append").parquet(source)
    jobs.insert_stream(jobs.new_files(spark, source, new.schema), target, ["business_id"], str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.read.parquet(target)) == [(1, "a"), (2, "b"), (3, "c")]
    whole = Q.scored(spark, SMALL)
    jobs.rescore_stream(jobs.new_files(spark, source, new.schema), lambda ids: whole.join(ids, "business_id").select("business_id", "lead_score"), str(tmp_path / "scores"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "scores")).select("business_id", "lead_score")) == rows(whole.filter("business_id IN (1, 2, 3)").select("business_id", "lead_score"))


def test_geocoded_area(spark):
    hits = spark.createDataFrame([(["1.5", "2.5", "3.5", "4.5"], {"state": "S", "country": "C", "country_code": "cc"})], "boundingbox array<string>, address map<string,string>")
    assert rows(P.geocode_area(hits)) == [("S", "cc", 1.5, 3.5, 2.5, 4.5)]


def test_place_files(spark, tmp_path):
    (tmp_path / "areas.json").write_text('{"x": {"name": "X", "country": "AE", "bbox": [1, 2, 3, 4]}}')
    (tmp_path / "cats.json").write_text('{"all": {"label": "All", "filters": [{"category": "any_shop", "tags": {"shop": "*"}}, {"category": "b", "tags": {"craft": "b"}}]}}')
    (tmp_path / "domains.csv").write_text("domain\nhttps://www.A.com/x\na.com\nnone\n")
    assert rows(P.read_areas(spark, str(tmp_path / "areas.json")).select("area", "name", "country")) == [("x", "X", "AE")]
    assert rows(P.read_categories(spark, str(tmp_path / "cats.json")).select("group", "pos", "category")) == [("all", 0, "any_shop"), ("all", 1, "b")]
    assert rows(P.read_domain_list(spark, str(tmp_path / "domains.csv"), header=True)) == [("a.com",)]


def test_search_verdicts_take_names_before_titles(spark):
    b = spark.createDataFrame([(1, "Harbour Bakery"), (2, "Red Lion Inn"), (3, "Nothing Found Here"), (4, "Only Directories")], "business_id long, name string")
    r = spark.createDataFrame(
        [
            (1, 1, 1, "https://www.facebook.com/harbour", "Harbour Bakery"), (1, 1, 2, "https://other.com/", "Harbour Bakery"), (1, 2, 1, "https://www.harbourbakery.com/a/b", "x"),
            (2, 1, 1, "https://x.com/", "Red Lion Inn"), (2, 1, 2, "https://stay.net/", "The Red Lion"), (4, 1, 1, "https://yelp.com/only", "Only Directories"),
        ],
        "business_id long, query_no int, rank int, href string, title string",
    )
    got = {x["business_id"]: (x["result"], x["website"]) for x in E.search_verdicts(b, r).collect()}
    assert got == {1: ("has_website", "https://www.harbourbakery.com/"), 2: ("has_website", "https://stay.net/"), 3: ("no_results", None), 4: ("no_website", None)}


def test_found_emails(spark):
    leads = spark.createDataFrame([(1, 40, "gmail.com"), (1, 40, "a.com"), (1, 40, "b.com"), (2, 10, "a.com")], "business_id long, lead_score int, domain string")
    finder = spark.createDataFrame([("a.com", [("X@a.com ", 80), ("y@a.com", 20), ("z@a.com", None)]), ("b.com", [("q@b.com", 99)])], "domain string, emails array<struct<value string, confidence int>>")
    known = spark.createDataFrame([], CONTACT)
    assert rows(E.found_emails(finder, leads, known)) == [(1, "email", "x@a.com")]


def test_role_contacts(spark):
    domains = spark.createDataFrame([(1, "a.com", "checked"), (2, "b.com", "verified_unhosted"), (3, "c.com", "hosted"), (4, "d.com", "checked")], "domain_id long, domain string, status string")
    seen = spark.createDataFrame([("a.com", 1, False), ("a.com", 2, True), ("b.com", 1, False), ("d.com", 1, True)], "domain string, observation long, has_mx boolean")
    known = spark.createDataFrame([(4, f"{p}@d.com") for p in ("info", "admin", "sales", "support", "contact")], "domain_id long, email string")
    statuses, made = D.role_contacts(domains, seen, known)
    assert rows(statuses.select("domain", "status")) == [("a.com", "enriched"), ("b.com", "mx_missing"), ("d.com", "no_contacts")]
    assert made.count() == 5


def test_sheets_and_snapshots(spark, tmp_path):
    columns = ["name", "category", "address", "city", "country", "source", "source_id"]
    sets = ["emails", "business_emails", "phones", "domains", "verified_unhosted_domains", "unregistered_domains", "registered_domains", "unknown_domains", "hosted_domains", "parked_domains"]
    row = [("A, \"B\"", None, None, "X", None, "s", "1", 7, *([["b", "a"]] * 2 + [["2"]] + [[]] * 7))]
    leads = spark.createDataFrame(row, ", ".join([*(f"{c} string" for c in columns), "lead_score int", *(f"{c} array<string>" for c in sets)]))
    assert len(L.lead_sheet(leads).columns) == 19 and len(L.refreshed_sheet(leads).columns) == 12
    for _ in range(2):  # written anew each time
        Wr.refresh_sheet(leads, str(tmp_path / "sheet"))
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "sheet")).collect()
    assert [(r["Name"], r["Category"], r["Lead Score"], r["Emails"], r["Phones"]) for r in got] == [('A, "B"', None, "7", "a, b", "2")]
    Wr.write_metrics(spark.createDataFrame([("s", "k", 1)], "section string, key string, value long"), str(tmp_path / "metrics"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "metrics")).collect()] == ['{"section":"s","key":"k","value":1}']
    (tmp_path / "files").mkdir()
    for k, name in enumerate(("old.csv", "new.csv", "note.txt")):
        (tmp_path / "files" / name).write_text("x" * (k + 1))
        os.utime(tmp_path / "files" / name, (1000 + k, 1000 + k))
    assert [(r["name"], r["size"]) for r in P.list_exports(spark, str(tmp_path / "files")).collect()] == [("new.csv", 2), ("old.csv", 1)]


def test_job_runs(spark):
    log = spark.createDataFrame([(1, "a", "running", 1, None, None), (1, "a", "failed", 1, 3, "e" * 5000), (2, "b", "running", 4, None, None)], "run_id int, job_name string, status string, at int, processed int, error string")
    assert [(r["run_id"], r["status"], r["started_at"], r["finished_at"], r["processed"], r["error"] and len(r["error"])) for r in Wr.job_runs(log).orderBy("run_id").collect()] == [(1, "failed", 1, 1, 3, 4000), (2, "running", 4, None, 0, None)]


def test_found_websites_make_due(spark):
    b = spark.createDataFrame([(1, "", 5), (2, "http://has", 5), (3, None, 5)], "business_id long, website_url string, scored_at int")
    v = spark.createDataFrame([(1, "llm", "http://old", 1), (1, "ddg", "http://new", 2), (2, "ddg", "http://x", 1), (3, "ddg", None, 1)], "business_id long, source string, website string, checked_at int")
    assert rows(E.apply_websites(b, v).select("business_id", "website_url", "scored_at")) == [(1, "http://new", None), (2, "http://has", 5), (3, None, 5)]


@pytest.mark.parametrize(
    ("tags", "category"),
    [
        ({"craft": "x", "shop": "y"}, "trades"), ({"office": "construction_company"}, "contractors"), ({"company": "construction"}, "contractors"), ({"amenity": "pub"}, "food"), ({"healthcare": "y"}, "health"), ({"amenity": "dentist"}, "health"),
        ({"amenity": "school"}, "education"), ({"amenity": "atm"}, "finance"), ({"amenity": "place_of_worship"}, "religious"), ({"amenity": "car_wash"}, "auto"), ({"shop": "x", "office": "y"}, "retail"), ({"tourism": "x"}, "hospitality"),
        ({"leisure": "x"}, "recreation"), ({"office": "x"}, "professional_services"), ({"industrial": "x"}, "industrial"), ({"amenity": "bench"}, "other"), ({"craft": ""}, "other"),
    ],
)
def test_every_category(spark, tags, category):
    assert spark.createDataFrame([(tags,)], "tags map<string,string>").select(P.classify()).first()[0] == category


def test_websites_of_tags(spark):
    tags = [({"website": "", "contact:website": "b", "url": "c"},), ({"url": "c"},), ({"website": "a", "url": "c"},), ({},)]
    assert [r[0] for r in spark.createDataFrame(tags, "tags map<string,string>").select(P.website()).collect()] == ["b", "c", "a", None]


def test_name_to_site_takes_https_then_the_longest(spark):
    filler = "x " * 400
    page = f"<html><head><title>Alder Garages Leeds</title></head><body>alder garages leeds {filler}</body></html>"
    b = spark.createDataFrame([(1, "Alder Garages", "CA"), (2, "Nobody Here", "CA"), (3, "", None)], "business_id long, name string, country string")
    urls = ["http://aldergarages.ca/", "https://alder-garages.ca/", "https://aldergarage.ca/"]
    pages = spark.createDataFrame([(u, None, 200, page) for u in urls], "url string, final_url string, status_code int, html string")
    got = {r["business_id"]: (r["result"], r["website"]) for r in sites.name_to_site(b, pages).collect()}
    assert got == {1: ("has_website", "https://alder-garages.ca/"), 2: ("no_match", None), 3: ("no_candidates", None)}
