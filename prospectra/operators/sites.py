"""From a name to its site: candidate domains, the pages found there, and whether a page is the business's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions import text as X

from .windows import keep_first

NO_TEXT = "array<string>"


def _within(value: Column, least: int, most: int, when: Column | None = None) -> Column:
    fits = F.length(value).between(least, most)
    return F.when(fits if when is None else fits & when, value)


def _brand_bases(words: Column) -> Column:
    """Joined and hyphenated beginnings of a name's words."""
    first, size = F.get(words, F.lit(0)), F.size(words)
    start = lambda k, sep: F.array_join(F.slice(words, 1, k), sep)
    alone = ((size == 1) & (F.length(first) >= 4)) | ((size == 2) & (F.length(first) >= 10))
    return F.array_compact(F.array(
        _within(F.array_join(words, ""), 4, 40), F.when(alone, first), _within(start(2, ""), 4, 30, size >= 2), _within(start(3, ""), 5, 35, size >= 3),
        _within(start(4, "-"), 0, 40, size >= 2), F.when(size >= 2, start(2, "-")),
    ))


def _full_bases(words: Column, differs: Column) -> Column:
    size = F.size(words)
    start = lambda k, sep: F.array_join(F.slice(words, 1, k), sep)
    found = F.array(_within(F.array_join(words, ""), 5, 40), _within(start(2, ""), 4, 30, size >= 2), _within(start(4, "-"), 0, 40, size >= 2))
    return F.when(differs & (size > 0), F.array_compact(found)).otherwise(F.array().cast(NO_TEXT))


def _acronym_bases(name: Column) -> Column:
    """A short word in capitals with what follows it."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    shouted = lambda w: (w == F.upper(w)) & (w != F.lower(w)) & F.length(w).between(2, 5)
    rest = lambda k: X.clean_name_words(F.array_join(F.slice(words, k + 2, F.size(words)), " "), "brand")
    pair = lambda w, r: F.when(shouted(w) & (F.size(r) > 0), F.array(F.concat(F.lower(w), F.array_join(r, "")), F.concat(F.lower(w), F.get(r, F.lit(0))))).otherwise(F.array().cast(NO_TEXT))
    return F.flatten(F.transform(words, lambda w, k: pair(w, rest(k))))


def _respelt(base: Column) -> Column:
    """Other spellings of transliterated names: endings cut, the article in front dropped."""
    cut = lambda k: F.substr(base, F.lit(1), F.length(base) - k)
    long = F.length(base) > 6
    bare = lambda p: F.when(long & F.startswith(base, F.lit(p)) & (F.length(base) > len(p) + 3) & (F.substr(base, F.lit(len(p) + 1), F.lit(1)) != "-"), F.substr(base, F.lit(len(p) + 1)))
    return F.array_compact(F.array(
        base, F.when(long & base.rlike("(ain|een)$"), cut(2)), F.when(long & F.endswith(base, F.lit("ain")), cut(1)), *[bare(p) for p in ("al-", "el-", "al", "el")],
    ))


def _numbers(bases: Column) -> Column:
    """Singular and plural of each base, of a hyphenated one's last part; a base is cut once, whatever the number of rules."""
    cut = F.transform(bases, lambda b: F.struct(F.regexp_extract(b, "^(.*-)?[^-]*$", 1).alias("head"), F.regexp_extract(b, "([^-]*)$", 1).alias("last")))
    return F.flatten(F.transform(cut, lambda c: F.transform(X.plural_forms(c["last"]), lambda w: F.concat(c["head"], w))))


def tlds_for(country: Column) -> Column:
    out = X.words_array(V.OTHER_TLDS)
    for code, tlds in V.COUNTRY_TLDS.items():
        out = F.when(country == code, X.words_array(tlds)).otherwise(out)
    return out


def candidate_lists(names: DataFrame) -> DataFrame:
    """(``name``, ``country``, ``domains``) for each distinct name and country.

    Longer bases come first, bases of equal length by text, each with its country's endings in
    their order. Names are small and their candidates much work, so they are dealt to all partitions,
    however few bytes they are.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = names.select("name", "country").distinct().repartition(parts, F.xxhash64("name", "country"))
    name = F.coalesce("name", F.lit(""))
    raw = F.filter(F.split(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 2)
    rows = rows.withColumns({"_brand": X.clean_name_words(name, "brand"), "_articles": X.clean_name_words(name, "articles"), "_all": X.clean_name_words(name, "all"), "_raw": raw})
    raw_joined = F.array_compact(F.array(_within(F.array_join("_raw", ""), 6, 35, F.size("_raw") >= 2)))
    full = _full_bases(F.col("_all"), (F.col("_all") != F.col("_brand")) & (F.col("_all") != F.col("_articles")))
    some = (F.size("_brand") > 0) | (F.size("_articles") > 0) | (F.size("_all") > 0)
    bases = F.when(some, F.array_distinct(F.concat(_brand_bases(F.col("_brand")), _brand_bases(F.col("_articles")), full, raw_joined, _acronym_bases(name))))
    rows = rows.withColumn("_bases", F.coalesce(bases, F.array().cast(NO_TEXT)))
    rows = rows.withColumn("_bases", F.array_distinct(F.flatten(F.transform("_bases", _respelt))))
    rows = rows.withColumn("_bases", F.array_distinct(_numbers(F.col("_bases"))))
    kept = F.filter("_bases", lambda b: F.length(b).between(3, 40))
    ordered = F.array_sort(F.transform(kept, lambda b: F.struct((-F.length(b)).alias("least"), b.alias("base"))))
    domains = F.flatten(F.transform(ordered, lambda b: F.transform(tlds_for(F.col("country")), lambda t: F.concat(b["base"], t))))
    return rows.select("name", "country", F.array_distinct(domains).alias("domains"))


def candidate_domains(names: DataFrame) -> DataFrame:
    """(``name``, ``country``, ``pos``, ``domain``) for each distinct name and country, in the order of ``candidate_lists``."""
    return _each_candidate(candidate_lists(names))


def _each_candidate(lists: DataFrame) -> DataFrame:
    """A row for each candidate. The lists are exploded from an expression: for a plain column Spark adds a filter on its size, which would make them twice."""
    return lists.select("name", "country", F.posexplode(F.array_distinct("domains")).alias("pos", "domain"))


#: What a page is told from: where it is found, how it was reached, what it holds.
PAGE = ["url", "final_url", "status_code", "html"]


def with_page_key(rows: DataFrame) -> DataFrame:
    """Rows with ``_page``, a digest of all that a page is told from."""
    text = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in PAGE]
    return rows.withColumn("_page", F.sha2(F.concat_ws("\n", *[F.sha2(t, 256) for t in text]), 256))


def page_facts(pages: DataFrame, page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(facts, words) of pages: one row a page of what rules ask of it alone, and one for each of its distinct words.

    Pages are parsed here, once each, whatever the number of names that are tried on them; facts are
    flags and numbers, ``words`` an index of (page, ``word``, ``in_title``, ``in_meta``).
    """
    plain = lambda c: F.replace(F.lower(F.col(c)), F.lit("-"), F.lit(""))
    p = pages.select(page, *PAGE).withColumns({"_host": X.url_host("url"), "_final": X.url_host("final_url"), "_title": X.page_title("html"), "_meta": X.page_meta("html"), "_head": F.lower(F.substring("html", 1, 5000))})
    p = p.withColumns({"_base": F.substring_index(plain("_host"), ".", 1), "_text": F.concat_ws(" ", "_title", "_meta", "_head"), "_squeezed": F.replace(plain("_title"), F.lit(" "), F.lit(""))})
    size = F.length("html")
    redirected = (F.col("_host") != F.col("_final")) & (F.col("_host") != "") & (F.col("_final") != "")
    echo = (F.col("_squeezed") != "") & ((F.col("_squeezed") == plain("_host")) | (F.col("_squeezed") == F.col("_base")) | (F.col("_squeezed") == F.replace(plain("_host"), F.lit("."), F.lit(""))))
    rejected = [
        ("status", F.coalesce(F.col("status_code"), F.lit(0)) != 200),
        ("redirect", redirected & ~X.related_domains("_host", "_final")),
        ("small", F.coalesce(size, F.lit(0)) < 500),
        ("parked", X.page_is_parked("html")),
    ]
    facts = p.select(
        page, F.col("_host").alias("host"), _first_of(rejected).alias("page_rejected_by"), redirected.alias("redirected"), echo.alias("echo"), (echo & (size < 10_000)).alias("bare_echo"),
        ((F.length("_base") >= 12) & F.contains("_text", F.col("_base"))).alias("based"), (F.col("_title") != "").alias("titled"),
    )
    words = p.select(page, X.words_of("_title").alias("_t"), X.words_of("_meta").alias("_m"), F.explode(X.words_of("_text")).alias("word"))
    return facts, words.select(page, "word", F.array_contains("_t", F.col("word")).alias("in_title"), F.array_contains("_m", F.col("word")).alias("in_meta"))


def _first_of(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails, null if none does."""
    out = F.lit(None).cast("string")
    for rule, failed in reversed(rules):
        out = F.when(F.coalesce(failed, F.lit(False)), rule).otherwise(out)
    return out


def owned_pages(pairs: DataFrame, facts: DataFrame, words: DataFrame, page: str = "page_id") -> DataFrame:
    """``is_owner`` and ``rejected_by`` for pairs of a ``name`` and a page.

    Rules run in order and the first that fails names itself: answer, redirect, size, parked
    marks, then words of the name on the page, by how many words the name has, then in its title.
    Pairs meet facts by the page's key, and the words of their name meet the page's in an equi join:
    no page, and no list of its words, goes through a join.
    """
    generic = X.words_array(V.ENTITY_SUFFIXES + V.TRADE_WORDS + V.LOCATION_WORDS)
    clean = F.regexp_replace(F.replace(F.lower(F.col("name")), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    of_name = F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(V.PAGE_STOP_WORDS)))
    p = pairs.join(facts, page, "left").withColumn("_words", of_name)
    asked = p.filter("page_rejected_by IS NULL").select(page, "name", "_words").distinct().select(page, "name", F.explode("_words").alias("_own"))
    forms = asked.withColumn("word", F.explode(X.plural_forms("_own")))
    kept = lambda when: F.collect_set(F.when(when, F.col("_own")))
    met = forms.join(words, [page, "word"]).groupBy(page, "name").agg(F.collect_set("_own").alias("_found"), kept(F.col("in_title")).alias("_titled"), kept(F.col("in_meta")).alias("_in_meta"))
    none = F.array().cast(NO_TEXT)
    p = p.join(met, [page, "name"], "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("_found", "_titled", "_in_meta")}).withColumn("_own", F.array_except("_found", generic))
    n = F.size("_words")
    count = lambda c, least=1: F.size(F.filter(c, lambda w: F.length(w) >= least))
    found, own = F.size("_found"), F.size("_own")
    only = F.get("_words", F.lit(0))
    by_words = ~F.col("based")
    rules = [
        ("", n == 0),  # nothing to check the page by: it passes
        ("domain_title", F.col("bare_echo")),
        ("generic_words", by_words & (found > 0) & (own == 0)),
        ("no_words", by_words & (found == 0)),
        ("few_words", by_words & (((n >= 4) & (own < 2)) | ((n == 3) & (own < 2) & (count("_own", 7) == 0)))),
        ("redirect_words", by_words & (n >= 3) & F.col("redirected") & ((found < 2) | (count("_own", 5) == 0))),
        ("short_words", by_words & (n == 2) & ((count("_found", 5) == 0) | ((count("_words", 5) == 2) & (count("_found", 5) < 2)))),
        ("single_word", by_words & (n == 1) & ~F.array_contains(F.when(F.col("echo"), F.col("_in_meta")).otherwise(F.col("_titled")), only)),
        ("title", F.col("titled") & (n >= 2) & (F.size(F.array_except("_titled", generic)) == 0)),
    ]
    out = p.withColumn("rejected_by", X.blank_to_null(F.coalesce("page_rejected_by", _first_of(rules))))
    return out.withColumn("is_owner", F.col("rejected_by").isNull()).select(*pairs.columns, "is_owner", "rejected_by")


def judge_pages(pairs: DataFrame) -> DataFrame:
    """``owned_pages`` for rows that hold their page themselves (``name`` and the columns of a page); each different page is parsed once."""
    rows = with_page_key(pairs)
    facts, words = page_facts(rows.dropDuplicates(["_page"]), "_page")
    return owned_pages(rows.drop(*PAGE), facts, words, "_page").drop("_page")


def name_to_site(businesses: DataFrame, pages: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``result``, ``website`` and ``candidate_count`` of each business by trying its candidate domains.

    Of the pages that pass, https goes before http, then the longest base, then the candidates' order.
    With ``keep``, which writes a table and reads it, candidates and their pages are made once.
    """
    keep = keep or (lambda rows, name: rows)
    lists = keep(candidate_lists(businesses), "candidates")
    counts = lists.select("name", "country", F.nullif(F.size("domains").cast("long"), F.lit(0).cast("long")).alias("candidate_count"))
    live = with_page_key(pages.select("url", F.coalesce("final_url", "url").alias("final_url"), "status_code", "html"))
    facts, words = page_facts(live, "_page")
    found = live.select("_page", "url", X.url_host("url").alias("domain"))
    pairs = keep(_each_candidate(lists).join(found, "domain"), "candidate_pages")
    owned = owned_pages(pairs, facts.distinct(), words, "_page").filter("is_owner")
    scheme = F.when(F.startswith("url", F.lit("https:")), 0).otherwise(1)
    best = keep_first(owned, ["name", "country"], scheme, F.desc(F.length(F.substring_index("domain", ".", 1))), "pos", "url").select("name", "country", F.col("url").alias("website"))
    same = lambda other: F.col("b.name").eqNullSafe(F.col(f"{other}.name")) & F.col("b.country").eqNullSafe(F.col(f"{other}.country"))
    rows = businesses.alias("b").join(counts.alias("c"), same("c"), "left").join(best.alias("w"), same("w"), "left")
    result = F.when(F.col("c.candidate_count").isNull(), "no_candidates").when(F.col("w.website").isNotNull(), "has_website").otherwise("no_match")
    return rows.select("b.business_id", result.alias("result"), "w.website", F.coalesce("c.candidate_count", F.lit(0)).alias("candidate_count"))
