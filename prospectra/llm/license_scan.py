"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Every window of a text as long as a template is compared with it; line ends do not count. The
versions and the words that part a family's licences must agree besides, so that a licence is not
taken for a variant of it. A page with a licence file's name, with the notice in its title or first
heading, or one that is mostly the notice, covers its directory; other pages take the licence of a
notice of their own, else that of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .license_texts import DENYING, IDENTIFIED, NAMES, PARTING, SAME, TEXTS, family

#: Least cosine of a notice.
LEAST_COSINE = 0.7
#: Terms on both sides of a window in which no word may stand that makes it another licence of the family.
AROUND = 4
#: Templates of fewer terms are notices: their words must all be there, in their order, but for these.
SHORT, LOOSE = 12, frozenset({"the", "international", "unported", "universal", "license", "licensed", "under", "version", "gnu"})
#: Share of a page's terms that makes it a licence file.
MOSTLY = 0.5
#: Last parts of paths that name licence files (fixed values).
FILE_NAMES = re.compile(r"(?:^|/)(?:licen[cs]e|copying|notice|unlicense|readme)[^/]*$", re.I)
_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_GLUED = re.compile(r"\b([al]?gpl|mpl|epl|apache|bsd)[ -]?v?([0-9])")
_NC, _ND, _IS = re.compile(r"\bnon[\s-]+commercial\b"), re.compile(r"\bno[\s-]*deriv(?:ative)?s\b"), re.compile(r"\blicen[cs]e\s*[:=]\s*(?=\w)")
_TAG = re.compile(r"<(?!!--)[^>]*>|<!--|-->")
_HEADS = re.compile(r"<(title|h1)[^>]*>(.*?)</\1>", re.I | re.S)
_NUMBER = re.compile(r"v?([0-9]+)(?:\.0)?$")


def plain(html: str) -> str:
    """Text without tags; comments count as text."""
    return _TAG.sub(" ", html) if "<" in html else html


def _same(term: str) -> str:
    if m := _NUMBER.match(term):
        return m[1]
    return SAME.get(term, term[1:] if term[0] == "v" and term[1:2].isdigit() else term)


def raw_terms(text: str) -> list[str]:
    text = text.lower()
    if "no attribution" in text:
        text = text.replace("no attribution", "0")
    if "gpl" in text or "mpl" in text or "epl" in text or "bsd" in text or "apache" in text:
        text = _GLUED.sub(r"\1 \2", text)
    # words of a licence's name are one term; "commercial" and "derivatives" alone part no licences
    if "commercial" in text:
        text = _NC.sub("noncommercial", text)
    if "deriv" in text:
        text = _ND.sub("noderivatives", text)
    if "se:" in text or "se=" in text or "se :" in text or "se =" in text:
        text = _IS.sub(" licenseis ", text)
    return _TERM.findall(text)


def terms(text: str) -> list[str]:
    """Words in lower case, versions without leading v and trailing .0, words that mean the same as one."""
    return [_same(t) for t in raw_terms(text)]


def templates() -> list[tuple[str, list[str]]]:
    """(licence, terms): the notice of each name, then headers and texts, then what names a licence by its identifier."""
    named = [(spdx, terms(f"Licensed under the {name}")) for spdx, names in NAMES.items() for name in names]
    return named + [(spdx, terms(text)) for spdx, text in TEXTS] + [(spdx, terms(form.format(spdx))) for form in IDENTIFIED for spdx in NAMES]


def document_frequencies(pages: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Number of pages, and of those with each term of a template; counted over all whole texts."""
    vocabulary = frozenset(t for _, found in templates() for t in found)
    raw = vocabulary | SAME.keys()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, Counter()
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                seen = set(raw_terms(plain(text or "")))
                found.update({_same(t) for t in seen if t in raw or t[0] in "v0123456789"} & vocabulary)
        yield pd.DataFrame({"term": ["", *found], "n": [n, *found.values()]})

    counted = pages.select(F.col(text_col).alias("text")).mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by_term = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term of a template
    return by_term.pop("", 0), by_term


class Matcher:
    """Best template of a text by cosine of TF times IDF; a term of no template weighs as one never seen."""

    def __init__(self, pages: int, df: dict[str, int]):
        self.templates = templates()
        self.idf = {t: log((pages + 1) / (df.get(t, 0) + 1)) + 1 for _, found in self.templates for t in found}
        self.unseen = log(pages + 1) + 1
        self.place = {t: k for k, t in enumerate(self.idf)}
        self.raw = frozenset(self.idf) | SAME.keys()
        self.weights, squares = [], np.zeros((len(self.templates), len(self.idf)))
        versions: dict[str, set[str]] = {}
        for k, (spdx, found) in enumerate(self.templates):
            w = {t: n * self.idf[t] for t, n in Counter(found).items()}
            length = sum(x * x for x in w.values()) ** 0.5
            self.weights.append({t: x / length for t, x in w.items()})
            for t, x in self.weights[-1].items():
                squares[k, self.place[t]] = x * x
            versions.setdefault(family(spdx), set()).update(re.findall(r"[0-9][0-9.]*", spdx.replace(".0", "")))
        self.squares = squares
        # what a window must hold, what it must not hold, and what must not stand around it
        self.must, self.must_not, self.not_around = [], [], []
        for spdx, found in self.templates:
            parting, own = PARTING.get(family(spdx), frozenset()), set(found)
            numbers = versions[family(spdx)]
            words = own & (parting | numbers) if len(found) >= SHORT else own - LOOSE if len(found) > 4 else own - {"the"}
            self.must.append(dict.fromkeys(t for t in found if t in words))
            self.must_not.append((numbers - own) if len(found) < 60 else set())
            self.not_around.append(parting - own)

    def windows(self, found: list[str], k: int) -> np.ndarray:
        """Cosine of template k with each window of its length, or with the whole text if that is shorter."""
        w, size = self.weights[k], min(len(self.templates[k][1]), len(found))
        idf = np.array([self.idf.get(t, self.unseen) for t in found])
        sliding = lambda x: (c := np.append(0.0, x.cumsum()))[size:] - c[:-size]
        dot, square = sliding(idf * np.array([w.get(t, 0.0) for t in found])), sliding(idf * idf)
        # a term that stands n times in a window has n * n there: each two places in one window add twice its square
        _, named = np.unique(np.array(found), return_inverse=True)
        order = np.argsort(named, kind="stable")
        both = np.zeros(len(found) + 1)
        for lag in range(1, len(found)):
            a, b = order[:-lag], order[lag:]
            near = (named[a] == named[b]) & (b - a < size)
            if not near.any():
                break
            a, b = a[near], b[near]
            np.add.at(both, np.maximum(b - size + 1, 0), 2 * idf[a] ** 2)
            np.add.at(both, a + 1, -2 * idf[a] ** 2)
        return dot / np.sqrt(np.maximum(square + both.cumsum()[: len(square)], 1e-12))

    def _holds(self, window: list[str], k: int) -> bool:
        if len(self.templates[k][1]) >= SHORT:
            return self.must[k].keys() <= set(window)
        rest = iter(window)
        return all(t in rest for t in self.must[k])  # in order

    def _denied(self, found: list[str], start: int, size: int, k: int) -> bool:
        """Whether a short notice follows a word that turns it into its opposite."""
        if len(self.templates[k][1]) >= SHORT:
            return False
        first = next((at for at in range(start, start + size) if found[at] in self.must[k]), start)
        verb = max((at for at in range(max(0, first - 4), first) if found[at] == "licensed"), default=first)
        return not DENYING.isdisjoint(found[max(0, verb - 2) : verb])

    def notices(self, text: str) -> list[tuple[float, int, float]]:
        """(cosine, -index of the template, share of the text's terms) of all notices of a whole text, closest first.

        Of windows that overlap the closest counts, then the first template; a licence counts once.
        """
        raw = raw_terms(text)
        seen = {_same(t) for t in set(raw) if t in self.raw or t[0] in "v0123456789"} & self.idf.keys()
        present = np.zeros(len(self.idf))
        present[[self.place[t] for t in seen]] = 1
        # no window comes closer than the part of the template that the text has at all
        possible = np.flatnonzero(self.squares @ present >= LEAST_COSINE**2 - 1e-9)
        found, fits = None, []
        for k in possible.tolist():
            if not self.must[k].keys() <= seen:
                continue
            found = found or [_same(t) for t in raw]
            cosines, size = self.windows(found, k), min(len(self.templates[k][1]), len(found))
            for start in np.flatnonzero(cosines >= LEAST_COSINE).tolist():
                window = found[start : start + size]
                around = found[max(0, start - AROUND) : start + size + AROUND]
                if self._holds(window, k) and self.must_not[k].isdisjoint(window) and self.not_around[k].isdisjoint(around) and not self._denied(found, start, size, k):
                    fits.append((-float(cosines[start]), k, start, start + size))
        out, taken, named = [], [], set()
        for cosine, k, start, stop in sorted(fits):
            if self.templates[k][0] not in named and all(stop <= a or start >= b for a, b in taken):
                out.append((-cosine, -k, (stop - start) / len(found)))
                taken.append((start, stop))
                named.add(self.templates[k][0])
        return out

    def text(self, text: str) -> tuple[float, int, float]:
        """The closest notice of a whole text."""
        return next(iter(self.notices(text)), (0.0, 0, 0.0))


def detected(pages: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html") -> DataFrame:
    """``id``, ``path``, ``notice`` (index of a template or null), ``others`` (those of further notices), ``cosine`` and ``licence_file`` of every page."""
    text_batches(pages.sparkSession)
    n, df = document_frequencies(pages, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(n, df)
        for batch in batches:
            best, files, others = [], [], []
            for html, path in zip(batch["text"], batch["path"], strict=True):
                every = matcher.notices(plain(html or ""))
                best.append(every[0] if every else (0.0, 0, 0.0))
                others.append([-k for _, k, _ in every[1:]])
                named = bool(FILE_NAMES.search(re.sub(r"[?#].*", "", path or "", flags=re.S).rstrip("/")))
                files.append(best[-1][0] > 0 and (named or best[-1][2] >= MOSTLY or any(matcher.text(plain(m[2]))[0] > 0 for m in _HEADS.finditer(html))))
            yield pd.DataFrame({
                "id": batch["id"].astype("Int64"), "path": batch["path"],
                "notice": pd.array([-k if c > 0 else None for c, k, _ in best], "Int32"),
                "others": others, "cosine": [round(c, 9) for c, _, _ in best], "licence_file": np.array(files, bool),
            })

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, path string, notice int, others array<int>, cosine double, licence_file boolean")


def _ancestors(dirs: DataFrame) -> DataFrame:
    """(``dir_key``, ``depth``, ``key``): each directory with itself and all above it, by SHA-256 of their paths.

    A path's digests are of its beginnings, one going on from the other, so that time and rows go
    with its length; no beginning is written out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, own in zip(batch["dir"], batch["dir_key"], strict=True):
                digest, keys = hashlib.sha256(), []
                for k, part in enumerate(path.split("/")):
                    digest.update(("/" if k else "").encode() + part.encode())
                    keys.append(digest.copy().hexdigest())
                for at in range(0, len(keys), 10_000):
                    some = keys[at : at + 10_000]
                    yield pd.DataFrame({"dir_key": own, "depth": np.arange(at + 1, at + 1 + len(some), dtype="int32"), "key": some})

    return dirs.mapInPandas(run, "dir_key string, depth int, key string")


def license_scan(pages: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html") -> DataFrame:
    """``page_id``, ``license``, ``cosine``, ``found_in`` (file, own notice, ancestor or none), ``license_dir``, ``also`` (the page's further licences, in order of their names).

    Directories are host and path without the last part; scheme, query and fragment are dropped,
    and a page at the root of a host stands in the host's directory. Of several notices of a page
    the closest counts, then the first template; of several licence files in a directory the closest
    notice, then the smallest id. Null paths have no directory, null and empty texts no notice; ids
    may be null or repeat. An empty table gives none; other columns are ignored.
    """
    found = stored(detected(pages, id_col, path_col, text_col), "notices")
    bare = F.regexp_replace(F.regexp_replace(F.lower("path"), "^[a-z][a-z0-9+.-]*://", ""), "[?#].*$", "")
    url, path = F.col("path").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.regexp_replace(bare, "/+$", "")
    found = found.withColumn("dir", F.when(url & ~F.contains(path, F.lit("/")), path).otherwise(F.regexp_replace(path, "/?[^/]*$", "")))
    names = F.array(*[F.lit(name) for name, _ in templates()])
    licence = lambda c: F.when(c.isNotNull(), F.element_at(names, c + 1))
    # directories first, each once; then pages look up their directory
    found = found.withColumn("dir_key", F.sha2("dir", 256))
    owners = found.filter("licence_file AND dir IS NOT NULL").groupBy("dir", "dir_key").agg(F.min_by("notice", F.struct(-F.col("cosine"), F.col("id"))).alias("dir_notice"))
    above = _ancestors(found.filter("dir IS NOT NULL").select("dir", "dir_key").distinct())
    nearest = (
        above.join(owners.select(F.col("dir_key").alias("key"), F.col("dir").alias("license_dir"), "dir_notice"), "key")
        .groupBy("dir_key").agg(F.max_by(F.struct("license_dir", "dir_notice"), "depth").alias("_own")).select("dir_key", "_own.*")
    )
    # as a table: both sides of the join are then plain shuffles, and a directory of many pages is split
    out = found.join(stored(nearest, "nearest"), "dir_key", "left")
    how = F.when(F.col("notice").isNotNull() & F.col("licence_file"), "file").when(F.col("notice").isNotNull(), "own notice").when(F.col("dir_notice").isNotNull(), "ancestor").otherwise("none")
    return out.select(F.col("id").alias("page_id"), licence(F.coalesce("notice", "dir_notice")).alias("license"), "cosine", how.alias("found_in"), F.when(how == "ancestor", F.col("license_dir")).alias("license_dir"), F.sort_array(F.transform("others", lambda k: F.element_at(names, k + 1))).alias("also"))
