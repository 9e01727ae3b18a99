"""Steps of a pass make each table once, whatever the number of its readers."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from prospectra.operators import domains as D
from prospectra.operators import evidence as E
from prospectra.operators import joins as J
from prospectra.operators import scoring as S
from prospectra.operators import sites
from prospectra.operators import writers as Wr
from prospectra.plans import passes
from prospectra.plans.steps import Steps
from prospectra.sources import poi as P

CONTACT = "business_id long, contact_type string, value string"


@pytest.fixture
def kept(spark):
    """(keep, the tables that it has written)."""
    steps, seen = Steps(spark), {}

    def keep(frame, name):
        seen[name] = steps.keep(frame, name)
        return seen[name]

    return keep, seen


def test_candidates_of_names_are_made_once(spark, kept):
    keep, seen = kept
    page = "<html><head><title>Alder Garages Leeds</title></head><body>alder garages leeds " + "x " * 400 + "</body></html>"
    b = spark.createDataFrame([(1, "Alder Garages", "CA"), (2, "Nobody Here", "CA"), (3, "", None)], "business_id long, name string, country string")
    pages = spark.createDataFrame([("https://aldergarages.ca/", None, 200, page)], "url string, final_url string, status_code int, html string")
    got = sites.name_to_site(b, pages, keep)
    assert rows(got) == rows(sites.name_to_site(b, pages)) and {r["business_id"]: r["result"] for r in got.collect()} == {1: "has_website", 2: "no_match", 3: "no_candidates"}
    assert set(seen) == {"candidates", "candidate_pages"} and seen["candidates"].count() == 3
    assert "array_sort" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_dealt_to_all_partitions(spark):
    names = spark.range(2000).select(F.concat(F.lit("Shop number "), "id").alias("name"), F.lit(None).cast("string").alias("country"))
    assert sites.candidate_lists(names).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_layers_write_only_what_they_add(spark, kept):
    keep, seen = kept
    scored = spark.createDataFrame([(k, f"n{k}", None, None, 50.0, None) for k in range(4)], "business_id long, name string, country string, website_url string, lead_score double, created_at date")
    old = spark.createDataFrame([(k, "ddg", "no_website", None, None) for k in range(2)], "business_id long, source string, result string, website string, checked_at timestamp")
    judged = spark.createDataFrame([(k, '{"status": "no_website"}') for k in range(1, 4)], "business_id long, verdict string")
    out = passes.verify_in_layers(scored, old, {"llm": judged}, F.lit(None).cast("timestamp"), keep)
    assert sorted((r["business_id"], r["source"]) for r in out.collect()) == [(0, "ddg"), (1, "ddg"), (1, "llm"), (2, "llm"), (3, "llm")]
    assert seen["evidence_llm"].count() == 3


def test_domains_that_businesses_name_are_found_once(spark, kept):
    keep, seen = kept
    b = spark.createDataFrame([(1, "http://www.a.com/"), (2, None), (3, "none")], "business_id long, website_url string")
    c = spark.createDataFrame([(1, "email", "x@a.com"), (2, "email", "y@b.org"), (2, "email", "z@gmail.com"), (3, "email", "bad"), (3, "phone", "q@c.com")], CONTACT)
    domains, links = spark.createDataFrame([("a.com",)], "domain string"), spark.createDataFrame([(1, "a.com")], "business_id long, domain string")
    new, made = D.sync_domains(b, c, domains, links, keep)
    assert rows(seen["wanted_domains"]) == [(1, "a.com", "website"), (2, "b.org", "email")]
    assert [r["domain"] for r in new.collect()] == ["b.org"] and rows(made.select("business_id", "domain")) == [(2, "b.org")]


def test_elements_are_read_once(spark, kept):
    keep, seen = kept
    e = spark.createDataFrame([("node", i, 1.0, 2.0, None, {"name": f"N{i}", "phone": f"+{i}55"}) for i in (0, 1, 1)], P.ELEMENT[7:-1])
    b, c = P.import_elements(e, keep=keep)
    assert seen["imported"].count() == 2 and rows(b) == rows(P.import_elements(e)[0]) and c.count() == 2
    held = spark.createDataFrame([(-1, "phone", "x")], CONTACT)
    assert Wr.absent(c.union(c), held, CONTACT.replace(" long", "").replace(" string", "").split(", ")).count() == 2


def test_features_stay_while_evidence_is_added(spark):
    b = spark.createDataFrame([(1, "A", "trades", None), (2, "B", "", "http://b.com")], "business_id long, name string, category string, website_url string")
    c = spark.createDataFrame([(1, "phone", "1"), (1, "email", "a@own.com")], CONTACT)
    links = spark.createDataFrame([(1, "d.com", "hosted"), (1, "d.com", "hosted"), (2, "e.com", None)], "business_id long, domain string, status string")
    v = spark.createDataFrame([(1, "ddg", "no_website"), (1, "ddg", "no_website"), (1, None, "x")], "business_id long, source string, result string")
    assert rows(S.score_features(S.business_features(b, c, links), v)) == rows(S.score_businesses(b, c, links, v))
    (one,) = E.confidence(v).collect()
    assert one["source_count"] == 1 and one["sources"] == ["ddg"] and dict(E.confidence(v).dtypes)["source_count"] == "bigint"


def test_only_pieces_that_chains_have_are_counted(spark):
    names = spark.createDataFrame([("aaaaaaaa burger",), ("Plain",), ("abc",), (None,)], "name string")
    chains = spark.createDataFrame([("aaaa",), ("burger",), ("abc",)], "chain string")
    got = J.names_with_chain(names.filter("name IS NOT NULL"), chains)
    assert rows(got) == [("aaaaaaaa burger", "aaaa"), ("aaaaaaaa burger", "burger"), ("abc", "abc")]
    assert "transform(sequence(1, greatest(((length(_lower" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_phones_of_places_are_found_once(spark, kept):
    keep, seen = kept
    b = spark.createDataFrame([(1, "Alder Garages"), (2, "Other")], "business_id long, name string")
    known = spark.createDataFrame([(2, "phone", "2")], CONTACT)
    place = "place struct<name: string, website: string, national_phone: string, international_phone: string, rating: double, review_count: int>"
    places = spark.createDataFrame([(k, 1, (n, None, str(k), None, None, None)) for k, n in ((1, "Alder Garages"), (2, "Other"))], f"business_id long, rank int, {place}")
    out = passes.enrich_from_places(b, known, places, lambda phones: keep(phones, "phones"))
    assert rows(out) == [(1, "phone", "1"), (2, "phone", "2")] and seen["phones"].count() == 2
