"""Registered queries and the pipeline over the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prospectra.llm import queries
from prospectra.llm.common import stored

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_exact_dedup_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(db.execute(queries.ORACLE_SQL["op8_exact_dedup"]).fetchall())
    got = queries.QUERIES["op8_exact_dedup"](spark, SMALL).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SMALL), f"test_{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert docs.select("doc_id").distinct().count() == docs.count() <= n
            n = docs.count()
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def odd_documents(spark):
    """Nulls, repeats, empty texts and columns named like those that the last stage makes."""
    base = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    odd = [(None, None, None), (None, "no id", "en"), (900, "", "en"), (901, " ", None), (902, "a b", "en"), (902, "a b", "en"), (903, "x" * 50_000, "en"), (904, base[0][1], "en"), (905, None, "en")]
    values = [(i, t, lang, 7, "clash") for i, t, lang in base + odd]
    return spark.createDataFrame(values, "doc_id long, text string, lang string, n_tokens int, ids string").repartition(3)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_documents(spark, k):
    docs, (name, stage) = odd_documents(spark), corpus_pipeline.STAGES[k]
    once = stored(stage(spark, docs, SMALL), f"odd_{k}")
    again = stored(stage(spark, docs, SMALL), f"odd_{k}")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, again.collect()))
    texts = {r["text"] for r in once.collect()}
    if name == "bpe":
        assert once.count() == docs.count()
        assert {r["source_n_tokens"] for r in once.collect()} == {7} and {r["source_ids"] for r in once.collect()} == {"clash"}
    else:
        assert once.columns == docs.columns
    if name == "exact dedup":
        assert once.count() == docs.select(F.coalesce(F.lower("text"), F.lit(""))).distinct().count()
    if name == "simhash near-dedup":
        assert {"no id", "x" * 50_000, "a b"} <= texts
    empty = stage(spark, docs.limit(0), SMALL)
    assert empty.count() == 0 and empty.columns == once.columns


def test_pipeline_leaves_other_results_alone(spark):
    held = {name: queries.QUERIES[name](spark, SMALL) for name in ("op8_exact_dedup", "op10_simhash")}
    first = corpus_pipeline.run(spark, SMALL)
    second = corpus_pipeline.run(spark, SMALL)
    assert first.count() == second.count() > 0
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert {df.count() for df in held.values()} == {n}
