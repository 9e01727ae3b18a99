"""Text functions against known cases."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from prospectra.functions import text as X
from prospectra.operators import sites


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "domain"),
    [
        ("https://www.Example.com/a?b", "example.com"), ("info@Shop.ae", "shop.ae"), ("shop.ae:8080/x", "shop.ae"), ("  WWW.a.b. ", "a.b"), ("nodots", None), ("a b.com", None),
        ("http://u@h.com/", "u@h.com"), ("h.com?q=1", "h.com?q=1"), ("http://a b.com/x", None), ("", None), ("foo_bar.com", "foo_bar.com"),
    ],
)
def test_normalize_domain(spark, raw, domain):
    assert one(spark, X.normalize_domain("raw"), raw=raw) == domain


@pytest.mark.parametrize(("d", "is_public"), [("gmail.com", True), ("GMAIL.co", True), ("yahoo.fr", True), ("shop.com", False), ("mail.ru", True), ("mailru.com", False), ("rogers.com", True)])
def test_public_mail(spark, d, is_public):
    assert one(spark, X.is_public_mail_domain("d"), d=d) is is_public


@pytest.mark.parametrize(
    ("domain", "name", "held"),
    [
        ("harbourbakery.com", "Harbour Bakery", True), ("pinecrestgarage.com", "Pinecrest Garages", True), ("lakesidecandle.com", "Candle Corner Gifts", False),
        ("oslo-fabrics.com", "Ray Fabric", False), ("upholsteryhouse.ca", "Finch Upholstery Studio", True), ("", "x", False),
    ],
)
def test_domain_holds_name(spark, domain, name, held):
    assert one(spark, X.domain_holds_name("domain", "name"), domain=domain, name=name) is held


@pytest.mark.parametrize(("word", "forms"), [("pinecrests", ["pinecrests", "pinecrest"]), ("pinecrest", ["pinecrest", "pinecrests"]), ("bakery", ["bakery"]), ("boxes", ["boxes", "box"]), ("deliveries", ["deliveries", "delivery"]), ("cars", ["cars"]), ("brush", ["brush", "brushes"])])
def test_plural_forms(spark, word, forms):
    assert one(spark, X.plural_forms("word"), word=word) == forms


@pytest.mark.parametrize(
    ("a", "b", "related"),
    [("dima.com", "ddv.de", False), ("loveyourshoes.ca", "www.loveyourshoes.ca", True), ("brand.com", "brand.co.uk", True), ("thechildren.com", "montrealchildrenshospital.ca", False), ("colborne.com", "colbornefoodbotics.com", False)],
)
def test_related_domains(spark, a, b, related):
    assert one(spark, X.related_domains("a", "b"), a=a, b=b) is related


def test_urls(spark):
    url = "https://me:pw@www.Shop.example.com:8080/a/b-c?q#f"
    assert one(spark, X.url_host("u"), u=url) == "shop.example.com"
    assert one(spark, X.to_root_url("u"), u="https://www.shop.com/a/b") == "https://www.shop.com/"
    assert one(spark, X.is_root_url("u"), u="https://shop.com/about") is True
    assert one(spark, X.is_root_url("u"), u="https://shop.com/a/b") is False
    assert one(spark, X.is_directory_url("u"), u="https://m.facebook.com/x") is True
    assert one(spark, X.is_directory_url("u"), u="https://notfacebook.com/x") is False
    assert one(spark, X.is_directory_url("u"), u="nothing") is True
    assert one(spark, X.looks_like_article("u"), u="https://a.com/2024/01/02/x") is True
    assert one(spark, X.looks_like_article("u"), u="https://a.com/about") is False


def test_names(spark):
    assert one(spark, X.looks_like_domain("n"), n="iRepair.ca") is True
    assert one(spark, X.looks_like_domain("n"), n="Repair Camp") is False
    assert one(spark, X.normalize_name("n"), n=" Tim's  Café & Bar ") == "tim caf bar"
    assert one(spark, X.search_queries("n", "c"), n="The Red Lion Inn", c="Leeds") == ["The Red Lion Inn Leeds", '"lion inn red" Leeds', '"The Red Lion Inn" Leeds']
    assert one(spark, X.place_matches_name("p", "n"), p="Lion Inn", n="The Red Lion") is True
    assert one(spark, X.score_bucket("s"), s=45) == 50


def test_pages(spark):
    html = "<html><TITLE lang=x>\n My Shop </TITLE><meta content='the shop' property='og:title'></html>"
    assert one(spark, X.page_title("h"), h=html) == "my shop"
    assert one(spark, X.page_meta("h"), h=html) == "the shop"
    assert one(spark, X.page_is_parked("h"), h="<p>Buy This Domain</p>") is True
    assert one(spark, X.has_word(X.words_of("t"), F.lit("garages")), t="an alder-garage, shop") is True
    assert one(spark, X.has_word(X.words_of("t"), F.lit("spa")), t="lots of space") is False
    assert one(spark, X.has_word(X.words_of("t"), F.lit("caf")), t="café") is False


def test_candidates(spark):
    names = spark.createDataFrame([("The Copper Kettle", "CA"), ("Osprey Cleaning", None), ("", None)], "name string, country string")
    found = {}
    for name, _, domain in rows(sites.candidate_domains(names).select("name", "pos", "domain")):
        found.setdefault(name, set()).add(domain)
    assert {"thecopperkettle.ca", "copperkettle.ca", "copper-kettles.com"} <= found["The Copper Kettle"]
    assert "ospreycleaning.com" in found["Osprey Cleaning"]
    assert "" not in found


def test_page_ownership(spark):
    filler = "x " * 400
    page = lambda title, body: f"<html><head><title>{title}</title></head><body>{body} {filler}</body></html>"
    pairs = spark.createDataFrame(
        [
            (1, "Alder Garages", "http://aldergarages.com/", "http://aldergarages.com/", 200, page("Alder Garages in Leeds", "welcome to alder garages")),
            (2, "Alder Garages", "http://aldergarages.com/", "http://other.com/", 200, page("Alder Garages", "")),
            (3, "Alder Garages", "http://aldergarages.com/", "http://aldergarages.com/", 404, ""),
            (4, "Alder Garages", "http://aldergarages.com/", "http://aldergarages.com/", 200, page("Alder Garages", "this domain is for sale")),
            (5, "Zebra", "http://zebra.com/", "http://zebra.com/", 200, page("Something else", "zebra here")),
            (6, "Village Shop", "http://villageshop.com/", "http://villageshop.com/", 200, page("The village", "village things")),
        ],
        "id int, name string, url string, final_url string, status_code int, html string",
    )
    got = {r["id"]: r["rejected_by"] for r in sites.judge_pages(pairs).collect()}
    assert got == {1: None, 2: "redirect", 3: "status", 4: "parked", 5: "single_word", 6: "generic_words"}


@pytest.mark.parametrize(
    ("html", "host", "cnames", "answered", "parked"),
    [
        ("Buy this domain", "", [], True, True), ("Buy this domain", "", [], False, False), (None, "x.parkingcrew.net", [], True, True), (None, "", ["a.PARKINGCREW.net"], False, True), ("<p>shop</p>", "shop.com", ["cdn.net"], True, False),
        ("x" * 200_001 + "buy this domain", "", [], True, False),
    ],
)
def test_parked_domains(spark, html, host, cnames, answered, parked):
    assert spark.createDataFrame([(html, host, cnames, answered)], "h string, f string, c array<string>, a boolean").select(X.domain_is_parked("h", "f", "c", "a")).first()[0] is parked


def test_titles_and_cursors(spark):
    assert one(spark, X.title_matches_name("t", "u", "n"), t="The Lion, Leeds", u="http://x.com/", n="Red Lion") is True
    assert one(spark, X.title_matches_name("t", "u", "n"), t="Nothing", u="http://redlionleeds.com/", n="Red Lion Leeds") is True
    assert one(spark, X.title_matches_name("t", "u", "n"), t="Nothing", u="http://x.com/", n="Red Lion") is False
    assert one(spark, X.place_query("n", "a", "c"), n="Inn", a="", c="York") == "Inn York"
    assert one(spark, X.scope("s"), s=" ") == "__global__"


def test_more_page_rules(spark):
    filler = "x " * 400
    page = lambda title, body: f"<html><head><title>{title}</title></head><body>{body} {filler}</body></html>"
    url = "http://redlioninnyork.com/"
    cases = [
        ("small", "Red Lion", url, url, "<title>Red Lion</title>"), ("domain_title", "Red Lion Inn", url, url, page("redlioninnyork.com", "red lion inn")), ("no_words", "Zebra Crossing", "http://z.com/", "http://z.com/", page("Other", "nothing")),
        ("few_words", "Zebra Walrus Ocelot Heron", "http://z.com/", "http://z.com/", page("Zebra", "zebra and nothing more")), ("title", "Golden Anchor", "http://z.com/", "http://z.com/", page("Welcome", "golden anchor")),
        (None, "", "http://z.com/", "http://z.com/", page("Anything", "at all")), (None, "Golden Anchor", "http://z.com/", "http://z.com/", page("The Golden Anchor", "golden anchor")),
    ]
    pairs = spark.createDataFrame([(k, n, u, f, 200, h) for k, (_, n, u, f, h) in enumerate(cases)], "id int, name string, url string, final_url string, status_code int, html string")
    got = {r["id"]: r["rejected_by"] for r in sites.judge_pages(pairs).collect()}
    assert got == {k: c[0] for k, c in enumerate(cases)}
