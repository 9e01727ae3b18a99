"""The pipeline's stages, one after another, against plain Python over all they get."""

import hashlib
from collections import Counter
from math import floor

import numpy as np
import public_tokenizers as tok
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prospectra.llm import mixing, toxicity
from prospectra.llm.common import stored, table

SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near_components(texts):
    """Least index that each text hangs together with by Jaccard similarities of 0.8 or more between sets of five-word shingles, from all pairs."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    near = [[j for j, y in enumerate(sets) if bool(x) == bool(y) and 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    root = list(range(len(texts)))
    while (least := [min(root[j] for j in js) for js in near]) != root:
        root = least
    return root


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SMALL), "stage")
        out.append((name, docs.orderBy("doc_id").collect(), made.orderBy("doc_id").collect()))
        docs = made
    return out


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).collect()}
    assert after == [r for r in before if scores[r["doc_id"]] < toxicity.THRESHOLD] and len(after) < len(before)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SMALL, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    assert np.mean([(i in kept) == (toxic == 0) for i, toxic in labels.items()]) > 0.93


def test_exact_stage(stages):
    _, before, after = stages[1]
    last = {lowered(r["text"]): r for r in before}  # in order of ids
    assert after == sorted(last.values(), key=lambda r: r["doc_id"])


def test_near_stage(stages):
    _, before, after = stages[2]
    root = near_components([r["text"] for r in before])
    assert after == [r for k, r in enumerate(before) if root[k] == k]


def test_mixing_stage(spark, stages):
    """Rows come back whole, each about as often as its rate says, so that the domains' tokens have the shares of the targets."""
    _, before, after = stages[3]
    docs, labels = spark.createDataFrame(before, table(spark, SMALL, "documents").schema), table(spark, SMALL, "labels")
    rows = stored(mixing.posteriors(docs, mixing.fit_domains(docs, labels)), "posteriors")
    steps, _, _ = mixing.fit_rates(rows, mixing.TARGETS, anchor="high")
    rates = {r["doc_id"]: r["rate"] for r in rows.withColumn("rate", mixing.rate_after(steps)).collect()}
    times = Counter(r["doc_id"] for r in after)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert all(floor(rate) <= times[i] <= floor(rate) + 1 for i, rate in rates.items())
    assert abs(sum(times.values()) - sum(rates.values())) < 4 * len(rates) ** 0.5
    weights = {r["doc_id"]: r for r in rows.collect()}
    tokens = {d: sum(r["n_tokens"] * r[f"p_{d}"] for r in weights.values()) for d in mixing.DOMAINS}
    mixed = {d: sum(weights[i]["n_tokens"] * weights[i][f"p_{d}"] * rate for i, rate in rates.items()) for d in mixing.DOMAINS}
    assert mixed["high"] == pytest.approx(tokens["high"], rel=0.02)
    assert mixed["low"] / mixed["high"] == pytest.approx(mixing.TARGETS["low"] / mixing.TARGETS["high"], rel=0.1)


def test_bpe_stage(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for r in before:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], r["text"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = [(r["doc_id"], r["text"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])) for r in after]
    assert sorted(got, key=lambda x: x[0]) == sorted(want, key=lambda x: x[0])


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[-1][2]))
