"""Vector codes, source divergence and quality against brute force, with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prospectra.llm import quality, queries, source_audit, vector_codes

SMALL = "/root/testdata/sf0.001"
SHORT = "/root/testdata/sf0.01"


def plain_codes(rows, entries=256, rounds=4):
    """Lloyd rounds over (id, label, vector) in plain integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    v = np.array([[int(np.floor(x * 1024)) for x in r[2]] for r in rows], "i8").reshape(len(rows), -1)
    width, codes, errors, books = v.shape[1] // 4, [], 0, []
    for k in range(4):
        x = v[:, k * width : (k + 1) * width]
        book = x[:entries].copy()
        for step in range(rounds + 1):
            far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            best = far.argmin(axis=1)
            if step < rounds:
                for e in set(best.tolist()):
                    book[e] = x[best == e].sum(axis=0) // (best == e).sum()
        codes.append(best)
        errors = errors + far.min(axis=1)
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[1]] += int(e)
    return sorted((repr(r[0]), "".join(f"{c[i]:02x}" for c in codes), int(errors[i]), by_label[r[1]], digest) for i, r in enumerate(rows))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("clash")).repartition(3)


def found(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def clustered(n, seed=1, dim=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dim))
    return [(i, i % 3, [float(np.float32(x)) for x in middles[i % 7] + rng.normal(size=dim) * 0.01 * (i % 5 > 0)]) for i in range(n)]


@pytest.mark.parametrize("entries", [256, 5, 1])
def test_vector_codes(spark, entries):
    rows = clustered(700) + [(9001, None, [0.0] * 8), (9002, None, [0.0] * 8), (9002, None, [0.0] * 8), (None, 1, [1.0] * 8), (9003, 7, [-0.25, 0.5] * 4)]
    odd = [(9100, 1, None), (9101, 1, [1.0] * 7 + [None]), (9102, 1, [float("nan")] * 8), (9103, 1, [float("inf")] + [0.0] * 7), (9104, 1, [1.0] * 4), (9105, 1, [])]
    assert found(vector_codes.vector_codes(vectors(spark, rows + odd), entries=entries)) == plain_codes(rows, entries)


def test_vector_codes_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_COMPONENTS", 8 * 50)
    monkeypatch.setattr(vector_codes, "STEP_PAIRS", 100)
    rows = clustered(600, seed=4) + [(10_000 + i, None, [0.5] * 8) for i in range(300)]
    assert found(vector_codes.vector_codes(vectors(spark, rows))) == plain_codes(rows)


def test_vector_codes_of_nothing(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, 1, None)])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, 1, [1.0] * 6), (2, 1, [1.0] * 8)])).count() == 0  # six is no multiple of four
    assert [r["error"] for r in vector_codes.vector_codes(vectors(spark, [(2, 1, []), (1, 1, [])])).collect()] == [0, 0]
    huge = vector_codes.vector_codes(vectors(spark, [(1, 1, [3e38] * 8), (2, 1, [-3e38] * 8)]), entries=1, rounds=0).collect()
    assert sorted(r["error"] for r in huge) == [0, 8 * (2 * vector_codes.LARGEST) ** 2]


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(3)
    middles = rng.integers(-900, 900, (12, 4))
    points = np.repeat(middles, 400, axis=0) + rng.integers(-3, 4, (4800, 4))
    book = vector_codes.Codebook(np.vstack([middles, middles[:2], [[5000] * 4]]))
    tree = vector_codes.Tree.of(points, 32)
    whole, left = vector_codes.descend(tree, book)
    assert sum(int((tree.stop[n] - tree.start[n]).sum()) for n, _ in whole) > 4000 and sum(map(len, [x for x, _ in left])) < 200
    sums = np.zeros((15, 5), "i8")
    vector_codes.assigned(tree, book, sums)
    best = ((points[:, None, :] - book.entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert sums[:, 0].tolist() == np.bincount(best, minlength=15).tolist()
    assert all((sums[e, 1:] == points[best == e].sum(axis=0)).all() for e in range(15))
    again = vector_codes.Tree.unpacked(tree.packed(), 4)
    assert all((getattr(again, name) == getattr(tree, name)).all() for name in ("order", "points", "start", "stop", "child", "low", "high", "sums"))


# --- source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(docs, top):
    """(lang, source, part, item, value, rank) from (text, lang, source) in plain integers."""
    n, df, groups = {}, Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        n.setdefault((lang, source), Counter()).update(terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in df.items() if x == lang and k >= 3)
        sources = sorted(s for x, s in groups if x == lang)
        counts = {s: [n[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p = {s: share(c) for s, c in counts.items()}
        q = share([sum(c[k] for c in counts.values()) for k in range(len(kept))])
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(t, (a - b) ** 2 // b) for t, a, b, c in zip(kept, p[s], q, counts[s], strict=True) if c and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_docs():
    rng = random.Random(8)
    words = ["the", "Of", "naïve", "ÉA", "x", "日本", "a1b", "don't", "🙂", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    docs = [(" ".join(rng.choice(words[: rng.choice([5, 40, 129])]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s1", "s2", "S3", None])) for _ in range(200)]
    docs += [(None, "en", "empty"), ("", "fr", "one"), ("rare words here", "fr", "two"), (None, None, None), ("the " * 5000, "en", "long"), ("the the", "xx", "s1"), ("the of", "xx", "s1"), ("THE", "xx", "s1")]
    return docs + docs[:20]


@pytest.mark.parametrize("block", [1 << 14, 64])
def test_source_divergence(spark, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK_COUNTS", block)
    docs = audit_docs()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, n int").repartition(3)
    got = source_audit.source_divergence(df, top=7)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(docs, 7)
    assert source_audit.source_divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("steps", [1 << 21, 16])
def test_pair_prices(monkeypatch, steps):
    monkeypatch.setattr(source_audit, "STEP_PAIRS", steps)
    rng = np.random.default_rng(9)
    counts, totals = rng.integers(0, 3, (6, 5, 16)), rng.integers(50, 900, 6)
    counts[:, 2, 11:] = -1
    share = lambda s: 1 + 10**9 * (counts[s][counts[s] >= 0] + 1) // totals[s]
    want = [[int(((share(i) - share(j)) ** 2 // share(j)).sum()) if i != j else 0 for j in range(6)] for i in range(6)]
    assert source_audit.pair_prices(counts, totals).tolist() == want


def test_equal_subtrees_are_one_node():
    counts = np.tile(np.array([0, 0, 3, 0, 0, 0, 3, 0]), (5, 40))[:, : 1 << 8]
    forest = source_audit.Forest(counts)
    assert len(forest.counts) == 2 and [len(c) for c in forest.children] == [2, 1, 1, 1, 1, 1, 1, 1]
    which, a, b, times = forest.met(np.zeros(1, "i8"), np.array([0]), np.array([1]))
    assert [(int(x), int(y), int(n)) for x, y, n in zip(a, b, times, strict=True)] == [(0, 0, 192), (3, 3, 64)] and set(which) == {0}


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (7, 9), (10**12, 3 * 10**13 + 7), (2**40, 2**43 + 1), (0, 10**15), (999, 1000)]
    want = [1 + 10**9 * (c + 1) // (n + 1) for c, n in cases]
    assert source_audit._shares(np.array([c for c, _ in cases], "i8"), np.array([n + 1 for _, n in cases], "i8")).tolist() == want
    df = spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate(cases)], "k int, c long, n long").select("k", source_audit.shares(F.col("c"), F.col("n"), F.lit(1).cast("long")).alias("p"))
    assert [r["p"] for r in df.orderBy("k").collect()] == want


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_source_audit"])
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    asked = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in asked.description]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, SMALL).select(names).collect()) == sorted(asked.fetchall())


# --- quality


def test_hinge_descent_finds_the_least():
    """The dual's conditions hold: margins over 1 have no weight, margins under 1 have all of it."""
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(80)]
    y = np.array([1.0 if (3 in r) ^ (rng.random() < 0.2) else -1.0 for r in rows])
    ratios, cost = rng.normal(size=30), 0.5
    w = quality.fit_hinge(rows, y, ratios, cost, passes=3000)
    x = np.array([[ratios[k] if k in r else 0.0 for k in range(30)] + [1.0] for r in rows])

    def loss(w):
        return w @ w / 2 + cost * np.maximum(0, 1 - y * (x @ w)).sum()

    least = loss(w)
    assert all(least <= loss(w + rng.normal(size=31) * size) + 1e-6 for size in (1e-4, 1e-3, 1e-2, 0.1) for _ in range(50))


def test_ratios():
    n1, n0 = np.array([10.0, 0, 1, 50]), np.array([0.0, 10, 1, 5])
    got = quality.log_ratios(n1, n0, 90, 10)
    assert got[0] > 0 > got[1] and got[2] == 0 and got[3] == pytest.approx(np.log(50.9 / 90 * 10 / 5.1))
    assert not quality.log_ratios(n1, n0, 90, 0).any()


def test_shapes():
    words = {"The": "Aa", "the": "a", "NOW": "A", "the&&&": "a&", "THE!!": "A!", "the,": "a,", "|": "|", "1,234": "0,0", "École.": "Aa.", "ÉCOLE": "A", "iPhone": "aAa", "a日本b": "a", "日本": "a", "ß": "a", "...": ".", "": ""}
    assert {w: quality.shape(w) for w in words} == words
    assert len(quality.Reader().features(None)) == len(quality.Reader().features(" \n")) == 0


def test_remembered_shapes_are_bounded(monkeypatch):
    monkeypatch.setattr(quality, "REMEMBERED_BYTES", 5_000)
    reader = quality.Reader()
    text = " ".join(f"word{i}" for i in range(500)) + " " + "x" * 10_000
    once = reader.features(text)
    assert len(reader.known) < 40 and "x" * 10_000 not in reader.known and (once == reader.features(text)).all()


def marked_docs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiklmno") for _ in range(5))
    docs, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randint(3, 60))]
        bad = i % 6 == 0
        if bad:
            words = [w for x in words for w in (x, x)] if i % 4 else [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    docs += [(900, None), (901, ""), (902, "x" * 60_000), (None, "plain words here"), (3, docs[3][1]), (3, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "lang": F.lit("en")}).repartition(3), spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = marked_docs(spark)
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(500) if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["predicted"] == int(i % 6 != 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert got[900]["score"] == got[901]["score"] and got[None]["held_out"] is False


def test_quality_learns_no_held_out_label(spark):
    docs, labels = marked_docs(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((repr(r["doc_id"]), r["score"]) for r in quality.quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_without_labels(spark):
    docs, labels = marked_docs(spark)
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r["score"] > 0.9 for r in quality.quality(docs, labels.filter("quality = 1")).collect())
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SHORT}/labels.parquet")
    scored = queries.QUERIES["op13_quality"](spark, SHORT).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
