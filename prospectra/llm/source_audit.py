"""How the sources of a language diverge in their terms, priced over hash-consed segment trees.

The kept terms of a language are dealt into blocks, in a block ordered by how frequent they are. A
source's counts in a block are the leaves of a segment tree; equal subtrees, of whatever source,
block and place, are one node. Two sources are compared by descending their trees together: equal
pairs of nodes are met once, with how often they occur, and so is each pair of counts at the end.
A task prices some blocks, Spark adds up what blocks give. All arithmetic is in integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_batches

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
#: Counts (sources times terms) of a block; more sources make shorter blocks. Decides the work only.
BLOCK_COUNTS = 1 << 14
#: Counts that a task turns into trees at once, and pairs of nodes that it follows at once; bound its memory.
TREE_COUNTS, STEP_PAIRS = 1 << 18, 1 << 21
#: Terms that a worker counts before it sends them on, and terms of one batch that it sends.
HELD_TERMS, SENT_TERMS = 300_000, 50_000

#: Bytes of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing: every byte of a character beyond ASCII is one of the last.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``term``, ``n``, ``docs``) of every group and term, and of every group an empty term with none."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for (lang, source), some in n.items():
                own, terms = seen[lang, source], list(some)
                for at in range(0, len(terms), SENT_TERMS):
                    part = terms[at : at + SENT_TERMS]
                    columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([some[t] for t in part], pa.int64()), pa.array([own[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            n.clear()
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source")), batch["text"], strict=True):
                group = lang, source
                if group not in n:
                    n[group], seen[group] = Counter({b"": 0}), Counter()
                found = _TERM.findall(text.as_buffer().to_pybytes().lower())
                n[group].update(found)
                seen[group].update(set(found))
            if sum(map(len, n.values())) > HELD_TERMS:
                yield from held()
        yield from held()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sent = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact for any count."""
    over = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.floor(F.call_function("div", over(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), over(total + terms))).cast("long")


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Like ``shares``, by long division in steps of 1,000, so that nothing leaves 64 bits; ``total`` has the terms in it."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


class Forest:
    """Segment trees over rows of counts, one level a list: the node at each place, and each node's two children."""

    def __init__(self, counts: np.ndarray):
        self.counts, ids = np.unique(counts, return_inverse=True)
        self.roots, self.children = ids.reshape(counts.shape), []
        while self.roots.shape[1] > 1:
            size = np.int64(self.roots.max() + 1)
            made, ids = np.unique(self.roots[:, ::2] * size + self.roots[:, 1::2], return_inverse=True)
            self.children.append(np.column_stack([made // size, made % size]))
            self.roots = ids.reshape(len(counts), -1)
        self.roots = self.roots.ravel()

    def met(self, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(``which``, count, count, times) of the leaves that meet when trees ``x`` and ``y`` are descended together, each different pair of nodes once."""
        times = np.ones(len(x), "i8")
        which, x, y, times = _merged(which, self.roots[x], self.roots[y], times)
        for children in reversed(self.children):
            which, times = np.tile(which, 2), np.tile(times, 2)
            x, y = children[x].T.ravel(), children[y].T.ravel()
            which, x, y, times = _merged(which, x, y, times)
        return which, self.counts[x], self.counts[y], times


def _merged(which: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    wide, deep = np.int64(x.max(initial=0) + 1), np.int64(y.max(initial=0) + 1)
    key = (which * wide + x) * deep + y
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, "i8")
    return which[order[first]], x[order[first]], y[order[first]], np.add.reduceat(times[order], first) if len(first) else times


def pair_prices(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Price of every ordered pair of sources over some blocks.

    ``counts`` (sources, blocks, terms) holds -1 beyond a block's terms; terms are a power of two.
    ``totals`` has each source's occurrences and kept terms.
    """
    sources, blocks, terms = counts.shape
    forest, out = Forest(counts.reshape(-1, terms)), np.zeros((sources, sources), "i8")
    left, right = np.triu_indices(sources, 1)
    step = max(1, STEP_PAIRS // (blocks * terms))
    for at in range(0, len(left), step):
        i, j = left[at : at + step], right[at : at + step]
        trees = np.arange(blocks)
        which, a, b, times = forest.met(np.repeat(np.arange(len(i)), blocks), (i[:, None] * blocks + trees).ravel(), (j[:, None] * blocks + trees).ravel())
        real = a >= 0
        which, a, b, times = which[real], a[real], b[real], times[real]
        p, q = _shares(a, totals[i[which]]), _shares(b, totals[j[which]])
        for x, y, rows, cols in ((p, q, i, j), (q, p, j, i)):
            np.add.at(out, (rows[which], cols[which]), (x - y) * (x - y) // y * times)
    return out


def _priced(blocks: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``item``, ``value``) from rows in order of language, block and place; a block begins with its sources."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, names, totals, held, rows = None, [], [], [], []
        sums: np.ndarray | None = None

        def close_block() -> None:
            if rows:
                held.append(np.array(rows, "i8"))
                rows.clear()

        def price_held() -> None:
            nonlocal sums
            if held:
                terms = 1 << int(max(x[:, 1].max() for x in held) - 1).bit_length()
                counts = np.full((len(names), len(held), terms), -1, "i8")
                for k, x in enumerate(held):
                    counts[:, k, : x[:, 1].max()] = 0
                    counts[x[:, 0], k, x[:, 1] - 1] = x[:, 2]
                priced = pair_prices(counts, np.array(totals, "i8"))
                sums = priced if sums is None else sums + priced
                held.clear()

        def close_lang() -> Iterator[pd.DataFrame]:
            nonlocal sums
            close_block()
            price_held()
            if sums is not None:
                for k, name in enumerate(names):
                    yield pd.DataFrame({"lang": here[0], "source": name, "item": names, "value": sums[k]}).drop(index=k)
            sums = None

        number: dict[str, int] = {}
        for batch in batches:
            for lang, block, place, source, n in zip(batch["lang"], batch["block"].tolist(), batch["place"].tolist(), batch["source"], batch["n"].tolist(), strict=True):
                if here != (lang, block):
                    if here is None or here[0] != lang:
                        yield from close_lang()
                        names, totals, number = [], [], {}
                    else:
                        close_block()
                        if sum(len(names) * int(x[:, 1].max()) for x in held) > TREE_COUNTS:
                            price_held()
                    here = lang, block
                if place:
                    rows.append((number[source], place, n))
                elif source not in number:
                    number[source] = len(names)
                    names.append(source)
                    totals.append(n)
        yield from close_lang()

    return blocks.select("lang", "block", "place", "source", "n").mapInPandas(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair, term), ``item``, ``value``, ``rank`` of the sources of every language.

    A language keeps the terms of at least three of its documents. A share p of a term in a group
    with N occurrences of V kept terms is 1 + floor(10^9 (count + 1) / (N + V)), the price of p
    against q is floor((p - q)^2 / q). Rows ``pair`` hold a group's price against each other source
    of its language, over all kept terms; rows ``term`` the ``top`` dearest terms that are more
    frequent in the group than in the language. Ties go by item in UTF-8 order.
    Null texts, languages and sources are empty ones. Every group that occurs is priced, without
    terms too; a language with one source has no pairs. Repeated rows count as often as they come;
    an empty table gives none; other columns are ignored.
    """
    counts = stored(term_counts(docs), "terms")
    whole = Window.partitionBy("lang", "term")
    kept = (
        counts.filter("term != ''")
        .withColumns({"total": F.sum("n").over(whole), "_docs": F.sum("docs").over(whole), "_one": F.row_number().over(whole.orderBy("source")) == 1})
        .filter(F.col("_docs") >= LEAST_DOCUMENTS)
        .select("lang", "source", "term", "n", "total", "_one")
    )
    kept = stored(kept, "kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("_one").cast("long")).alias("ones"))
    groups = counts.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").na.fill(0, ["n", "ones"])
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("ones").alias("kept_terms"), F.count(F.lit(1)).alias("sources"))
    # a row for each group; Spark broadcasts the table only where its files are small
    groups = stored(groups.select("lang", "source", "n").join(langs, "lang"), "groups")

    sized = kept.join(groups.select("lang", "source", F.col("n").alias("group_n"), "lang_n", "kept_terms", "sources"), ["lang", "source"])
    p, q = shares(F.col("n"), F.col("group_n"), F.col("kept_terms")), shares(F.col("total"), F.col("lang_n"), F.col("kept_terms"))
    dear = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = dear.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    # blocks of terms; each begins with the sources of its language (place 0), with or without terms in it
    parts = lambda: F.greatest(F.lit(1), F.ceil(F.col("kept_terms") * F.col("sources") / F.lit(BLOCK_COUNTS))).cast("long")
    cells = sized.select("lang", F.pmod(F.xxhash64("term"), parts()).alias("block"), "source", "term", "total", "n")
    several = groups.filter("sources > 1 AND kept_terms > 0")
    heads = several.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), parts() - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("total"), (F.col("n") + F.col("kept_terms")).alias("n"))
    in_block = Window.partitionBy("lang", "block").orderBy(F.desc_nulls_first("total"), F.asc_nulls_first("term"))
    placed = heads.unionByName(cells.join(several.select("lang").distinct(), "lang", "left_semi")).withColumn("place", F.dense_rank().over(in_block) - 1)
    priced = _priced(placed.sortWithinPartitions("lang", "block", "place")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source")
    others = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source != item")
    pairs = others.join(priced, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("rank", F.row_number().over(by_value))

    found = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for x, part in ((pairs, "pair"), (terms, "term"))]
    return found[0].unionByName(found[1])
