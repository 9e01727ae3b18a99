"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each call of a stage stores the tables that it makes on its way in a folder of its own. The next
stage of the same pipeline empties it: by then the result that reads them has been written. Results
of other queries, and of another run, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from prospectra.llm.common import emptied, scope, stored, table
from prospectra.llm.exact_dedup import drop_exact_copies
from prospectra.llm.mixing import mix
from prospectra.llm.rank_bpe import encode_documents
from prospectra.llm.simhash import keep_one_of_each
from prospectra.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of the stages whose results have been handed out: one list for each run, and one for stages called by themselves.
_made: ContextVar[list[str]] = ContextVar("made", default=[])  # noqa: B039


def _stage(work: Stage) -> Stage:
    """The stage with a folder of its own, which begins by emptying those of the stages before it."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _made.get()
        while made:
            emptied(spark, made.pop())
        with scope() as name:
            made.append(name)
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled rows that are not held out."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest id stays."""
    return drop_exact_copies(docs)


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or by way of others, the one with the smallest id stays."""
    return keep_one_of_each(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says; the tokens of the ``high`` domain stay as many as they are."""
    return mix(docs, table(spark, sf_dir, "labels"))


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, the token ids, their number and the digests of ids and decoded text.

    A column of documents with the name of one of these comes back as ``source_<name>``.
    """
    own = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    carry = {c: f"source_{c}" if c in own else c for c in docs.columns if c != "doc_id"}
    return encode_documents(docs.withColumnsRenamed(carry), ids=True, carry=tuple(carry.values()))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_exact_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]
#: No SQL: the first, third and fourth stage fit models or iterate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the run has stored besides them is emptied as it goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    mine = _made.set([])
    try:
        for k, (_, stage) in enumerate(STAGES):
            result = stage(spark, docs, sf_dir)
            with scope() as name:
                docs = stored(result, f"stage_{k}")
            if before:
                emptied(spark, before)
            before = name
        for name in _made.get():
            emptied(spark, name)
    finally:
        _made.reset(mine)
    return docs
