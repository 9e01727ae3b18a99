"""Functions from columns to columns on names, domains, addresses and URLs. Nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_of(values: list[str]) -> str:
    """A regular expression for any of the plain texts."""
    return "|".join("\\Q" + v + "\\E" for v in values)


def words_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end; ``trim`` takes spaces alone."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


# --- domains and addresses


def normalize_domain(raw: Column | str) -> Column:
    """The bare domain of a URL, an address or a host; null if nothing like a domain is left.

    Each step names the one before it once, so that the expression stays small wherever it is used.
    """
    v = F.regexp_replace(F.lower(strip(raw)), r"(?s)^(?!.*://)[^@]*@", "")
    v = F.regexp_replace(v, r"(?s)^(?=.*://)(?![a-z][a-z0-9+.-]*://).*\z", "")
    v = F.regexp_replace(v, r"(?s)^[a-z][a-z0-9+.-]*://([^/?#]*).*\z", "$1/")
    host = F.regexp_replace(F.substring_index(v, "/", 1), r"\.+\z", "")
    host = F.substring_index(F.regexp_replace(host, r"^www\.", ""), ":", 1)
    return blank_to_null(F.regexp_extract(host, r"(?U)^[^\s.]*\.\S*\z", 0))


def email_domain(email: Column | str) -> Column:
    """The domain of an address; null without an @."""
    return normalize_domain(F.regexp_extract(_col(email), r"(?s)^.*@.*\z", 0))


def is_public_mail_domain(domain: Column | str) -> Column:
    return F.lower(strip(domain)).rlike(f"^(?:(?:{_any_of(V.PUBLIC_MAIL_DOMAINS)})\\z|{_any_of(V.PUBLIC_MAIL_PREFIXES)})")


def url_host(url: Column | str) -> Column:
    """The host of a URL in lower case without www, user and port; empty if there is none."""
    authority = F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", ""), r"^www\.", "")


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def path_segments(url: Column | str) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def host_suffixes(host: Column | str) -> Column:
    """a.b.c as [a.b.c, b.c, c]: a host is under a domain if one of them equals it."""
    parts = F.split(_col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def is_directory_url(url: Column | str) -> Column:
    """Whether the host is a directory or under one; true also for a URL without a host."""
    host = url_host(url)
    return (host == "") | F.arrays_overlap(host_suffixes(host), words_array(V.DIRECTORY_DOMAINS))


def is_root_url(url: Column | str) -> Column:
    """No path, or one part of at most 20 characters."""
    s = path_segments(url)
    return (F.size(s) == 0) | ((F.size(s) == 1) & (F.length(F.get(s, F.lit(0))) <= 20))


def to_root_url(url: Column | str) -> Column:
    return F.concat(F.regexp_extract(_col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), F.lit("://"), F.regexp_extract(_col(url), r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("/"))


def looks_like_article(url: Column | str) -> Column:
    s, path = path_segments(url), F.concat(F.lit("/"), F.array_join(path_segments(url), "/"), F.lit("/"))
    hyphens = lambda x: F.length(x) - F.length(F.replace(x, F.lit("-"), F.lit("")))
    marked = F.lower(path).rlike("/(blog|article|news|post|story|review|archives|magazine|press|media|column)/|/supplier")
    long_slug = F.exists(s, lambda x: (hyphens(x) >= 5) | ((F.length(x) >= 60) & (hyphens(x) >= 3)))
    dated = path.rlike(r"[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}")
    return (F.size(s) > 0) & (dated | marked | (F.size(s) >= 4) | long_slug | ((F.size(s) == 3) & (F.length(F.get(s, F.lit(2))) >= 30)))


def role_emails(domain: Column | str) -> Column:
    return F.array(*[F.concat(F.lit(f"{p}@"), _col(domain)) for p in V.ROLE_PREFIXES])


def role_prefix(email: Column | str) -> Column:
    """The part before the @ if it is a role's, else null."""
    p = F.lower(F.substring_index(_col(email), "@", 1))
    return F.when(F.contains(_col(email), F.lit("@")) & p.isin(V.ROLE_PREFIXES), p)


def related_domains(a: Column | str, b: Column | str) -> Column:
    """Same base, or one inside the other with 60 % of its length, or a beginning of 10 or more."""
    base = lambda d: F.replace(F.lower(F.substring_index(F.regexp_replace(_col(d), r"^www\.", ""), ".", 1)), F.lit("-"), F.lit(""))
    x, y = base(a), base(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    inside = F.contains(long, short) & ((F.length(short) >= F.length(long) * 0.6) | (F.startswith(long, short) & (F.length(short) >= 10)))
    return F.coalesce((x == "") | (y == "") | (x == y) | inside, F.lit(True))


# --- names


def looks_like_domain(name: Column | str) -> Column:
    n = F.replace(F.lower(_col(name)), F.lit(" "), F.lit(""))
    return F.coalesce(n.rlike("(" + _any_of(V.NAME_TLDS) + ")($|/)"), F.lit(False))


def normalize_name(name: Column | str) -> Column:
    n = F.regexp_replace(F.lower(strip(name)), r"['`]s?\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"[^a-z0-9\s]", " "), r"\s+", " "))


def name_words(name: Column | str) -> Column:
    """Distinct words of a name without those that say nothing."""
    return F.array_except(F.filter(F.split(normalize_name(name), " "), lambda w: w != ""), words_array(V.NAME_STOP_WORDS))


def domain_holds_name(domain: Column | str, name: Column | str) -> Column:
    """Whether a domain is likely that of a business with this name, by four rules."""
    base = F.replace(F.lower(F.substring_index(_col(domain), ".", 1)), F.lit("-"), F.lit(""))
    plain = F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]", "")
    found = F.filter(name_words(name), lambda w: (F.length(w) >= 4) & F.contains(base, w))
    only = F.get(found, F.lit(0))
    rules = [
        (F.length(plain) >= 7) & F.contains(base, plain),
        (F.length(base) >= 6) & F.contains(plain, base) & (F.length(base) >= 0.65 * F.length(plain)),
        F.size(found) >= 2,
        (F.size(found) == 1) & ~only.isin(V.GENERIC_BUSINESS_TERMS) & (F.length(only) >= 7),
    ]
    held = rules[0] | rules[1] | rules[2] | rules[3]
    return F.coalesce((_col(domain) != "") & (_col(name) != "") & held, F.lit(False))


def title_matches_name(title: Column | str, url: Column | str, name: Column | str) -> Column:
    """At least half of the name's words are in the title, or the domain holds the name."""
    words = name_words(name)
    shared = F.size(F.array_intersect(words, name_words(F.coalesce(_col(title), F.lit("")))))
    return (F.size(words) > 0) & ((shared >= F.greatest(F.lit(1.0), F.size(words) * 0.5)) | domain_holds_name(url_host(url), name))


def place_matches_name(place: Column | str, name: Column | str) -> Column:
    """At least half of the business's words are in the place's name."""
    words = lambda c: F.array_except(F.filter(F.split(F.lower(_col(c)), r"(?U)\s+"), lambda w: w != ""), words_array(V.PLACE_STOP_WORDS))
    mine = words(name)
    return F.coalesce((F.size(mine) > 0) & (F.size(F.array_intersect(mine, words(place))) >= 0.5 * F.size(mine)), F.lit(False))


def search_queries(name: Column | str, city: Column | str) -> Column:
    """Name and city; the three longest words quoted; the whole name quoted. Equal length goes by text."""
    n = _col(name)
    place = F.coalesce(F.concat(F.lit(" "), blank_to_null(city)), F.lit(""))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'), place)
    longest = F.array_sort(name_words(n), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    short = F.when(F.size(longest) >= 2, quoted(F.array_join(F.slice(longest, 1, 3), " ")))
    return F.array_distinct(F.array_compact(F.array(F.concat(n, place), short, quoted(n))))


def context_queries(name: Column | str, city: Column | str, category: Column | str, country: Column | str) -> Column:
    n = _col(name)
    place = F.coalesce(F.concat(F.lit(" "), blank_to_null(city)), F.lit(""))
    context = F.when(blank_to_null(category).isNotNull(), F.concat_ws(" ", n, _col(category), blank_to_null(country)))
    return F.array_distinct(F.array_compact(F.array(F.concat(n, place), F.concat(n, F.lit(" website")), context)))


def place_query(name: Column | str, address: Column | str, city: Column | str) -> Column:
    return F.concat_ws(" ", blank_to_null(name), F.coalesce(blank_to_null(address), blank_to_null(city)))


def clean_name_words(name: Column | str, level: str) -> Column:
    """Words of two letters or more: ``brand`` without articles and trade words, ``articles`` without trade words, ``all`` without legal forms."""
    dropped = {"brand": V.ARTICLES + V.ENTITY_SUFFIXES + V.TRADE_WORDS, "articles": V.ENTITY_SUFFIXES + V.TRADE_WORDS, "all": V.ENTITY_SUFFIXES}[level]
    text = F.regexp_replace(F.replace(F.lower(F.coalesce(_col(name), F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(dropped))


def plural_forms(base: Column | str) -> Column:
    """A word and its plural or singular, where there is a plain rule for it."""
    b = _col(base)
    cut = lambda k: F.substr(b, F.lit(1), F.length(b) - k)
    other = (
        F.when(F.length(b) <= 4, None)
        .when(F.endswith(b, F.lit("ies")) & (F.length(b) > 5), F.concat(cut(3), F.lit("y")))
        .when(b.rlike("(ses|xes|zes)$"), cut(2))
        .when(b.rlike("[^s]s$"), cut(1))
        .when(F.endswith(b, F.lit("ss")), F.concat(b, F.lit("s")))
        .when(F.endswith(b, F.lit("y")), None)
        .when(b.rlike("(sh|ch|x|z)$"), F.concat(b, F.lit("es")))
        .otherwise(F.concat(b, F.lit("s")))
    )
    return F.array_compact(F.array(b, other))


def words_of(text: Column | str) -> Column:
    """Distinct whole words of a text."""
    return F.array_distinct(F.split(_col(text), r"(?U)\W+"))


def has_word(words: Column | str, word: Column) -> Column:
    """Whether a word of [a-z0-9] or its other number is among the whole words of a text."""
    return F.arrays_overlap(plural_forms(word), _col(words))


# --- pages


def page_title(html: Column | str) -> Column:
    found = F.regexp_extract(F.substring(_col(html), 1, 5000), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.lower(F.substring(strip(found), 1, 200))


def page_meta(html: Column | str) -> Column:
    """Description and the two og names, whichever way their attributes stand."""
    head = F.substring(_col(html), 1, 5000)
    found = []
    for kind, value in (("name", "description"), ("property", "og:title"), ("property", "og:site_name")):
        tag = rf"""{kind}=["']{value}["']"""
        found.append(F.regexp_extract(head, rf"""(?i)<meta[^>]*{tag}[^>]*content=["']([^"']+)""", 1))
        found.append(F.regexp_extract(head, rf"""(?i)<meta[^>]*content=["']([^"']+)["'][^>]*{tag}""", 1))
    return F.lower(F.concat_ws(" ", *[blank_to_null(f) for f in found]))


def page_is_parked(html: Column | str) -> Column:
    return F.lower(F.substring(_col(html), 1, 8000)).rlike(_any_of(V.PAGE_PARKED_MARKS))


def domain_is_parked(html: Column | str, final_host: Column | str, cnames: Column | str, answered: Column | str) -> Column:
    """Parked by its hosts or its page; asked only where HTTP answered or there is an alias."""
    hosts = _any_of(V.PARKED_HOSTS)
    aliased = F.exists(F.coalesce(_col(cnames), F.array().cast("array<string>")), lambda c: F.lower(c).rlike(hosts))
    by_page = F.lower(F.substring(F.coalesce(_col(html), F.lit("")), 1, 200_000)).rlike(_any_of(V.PARKED_KEYWORDS))
    by_host = F.lower(F.coalesce(_col(final_host), F.lit(""))).rlike(hosts)
    asked = F.coalesce(_col(answered), F.lit(False)) | (F.size(F.coalesce(_col(cnames), F.array().cast("array<string>"))) > 0)
    return asked & (by_host | aliased | by_page)


# --- small ones


def platform_for_day(day: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(_col(day), "yyyyMMdd"))


def scope(value: Column | str) -> Column:
    return F.coalesce(blank_to_null(strip(value)), F.lit("__global__"))


def score_bucket(score: Column | str) -> Column:
    return (F.round(_col(score).cast("decimal(10,2)") / 10) * 10).cast("int")


def confidence_rank(level: Column | str) -> Column:
    c = _col(level)
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def iso_time(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def cursor(ts: Column | str, key: Column | str) -> Column:
    return F.concat_ws("|", iso_time(ts), _col(key).cast("string"))


def parse_cursor(value: Column | str) -> Column:
    """(time, key) of a cursor; null, and so a fresh start, if it does not read as one."""
    parts = F.split(_col(value), r"\|")
    ts = F.try_to_timestamp(F.get(parts, F.lit(0)))
    return F.when((F.size(parts) == 2) & ts.isNotNull(), F.struct(ts.alias("at"), F.get(parts, F.lit(1)).alias("key")))
