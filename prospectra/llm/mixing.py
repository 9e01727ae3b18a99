"""Mixing to target weights with soft membership.

A classifier fitted on the labelled rows gives each document a posterior over domains. Rates of
at least zero, one for each document, are fitted by projected gradient steps so that the expected
tokens of each domain meet its target. A step moves every rate by the document's posterior times
one number for each domain, so all state is a short list of such numbers: a round is one pass of
sums over the documents and nothing is shuffled but those sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .linear import fit_softmax
from .token_store import DEFAULT_VOCABULARY, WholeEncoder, chunked, load

DOMAINS = ("high", "low", "toxic")
#: Shares of the expected tokens.
TARGETS = {"high": 0.9, "low": 0.08, "toxic": 0.02}
#: Labelled rows that fit the classifier; more are thinned by a hash of their text.
TRAINING_ROWS = 6_000
#: Words are named by so many bits of a hash.
WORD_BITS = 18
#: A fit ends when the targets are met to this share of all tokens,
ENOUGH = 1e-7
#: or, where no rates meet them, when so many rounds in a row have each brought the sum of squares down by less than this share.
PATIENCE, LEAST_GAIN = 5, 1e-3
#: A Newton step that brings the sum of squares down by less than this share is taken back.
NEWTON_GAIN = 0.05

_BINS = 12
_SHAPES = 5
_ODD = r"[#$%&*|<>{}=+~^\\]"
_EDGE = ".,;:?!\"'()"
DIM = (1 << WORD_BITS) + _SHAPES * _BINS


def domain_of_labels() -> Column:
    """Index into DOMAINS of a labelled row; null where the labels do not tell."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


class Features:
    """Tokens, hashed distinct words and the shape of texts: length, repeats, odd signs, capitals, word length."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        self.encoder = load(vocabulary)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens of each text; then (text, feature id) of all features, in order of texts."""
        coded, stops = chunked(texts)
        words, index, count = coded.dictionary, coded.indices.to_numpy().astype("i8"), len(texts)
        text, size = np.repeat(np.arange(count), np.diff(stops, prepend=0)), max(len(words), 1)
        if (empty := pc.index(words, "").as_py()) >= 0:
            text, index = text[index != empty], index[index != empty]
        total = lambda by_word: np.bincount(text, by_word.to_numpy(zero_copy_only=False).astype("f8")[index] if len(index) else None, count)
        distinct = _sorted_set(text * size + index)
        text_of = distinct // size
        bare = pc.utf8_trim(pc.utf8_lower(words), _EDGE).to_numpy(zero_copy_only=False)
        names = (hash_array(bare, categorize=False) & np.uint64((1 << WORD_BITS) - 1)).astype("i8")
        hashed = _sorted_set(text_of << WORD_BITS | names[distinct - text_of * size])
        n = np.bincount(text, minlength=count)
        some, length = np.maximum(n, 1), pc.utf8_length(texts.fill_null("")).to_numpy()
        shape = [
            np.frexp(n)[1] / 20, np.bincount(text_of, minlength=count) / some, total(pc.count_substring_regex(words, _ODD)) / some,
            total(pc.utf8_is_upper(words)) / some, length / some / 16,
        ]
        bins = [(1 << WORD_BITS) + k * _BINS + np.minimum(_BINS - 1, x * _BINS).astype("i8") for k, x in enumerate(shape)]
        rows = np.concatenate([hashed >> WORD_BITS, *[np.arange(count)] * _SHAPES])
        order = np.argsort(rows, kind="stable")
        tokens = self.encoder.encode(texts)[1] if isinstance(self.encoder, WholeEncoder) else total(pa.array(self.encoder.sizes(words))).astype("i8")
        return tokens, rows[order], np.concatenate([hashed & ((1 << WORD_BITS) - 1), *bins])[order]


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """Weights of the domain classifier. Rows without labels, and labels without rows, are not used."""
    text_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("_id"), domain_of_labels().alias("y")).filter(F.col("_id").isNotNull() & F.col("y").isNotNull()).groupBy("_id").agg(F.max("y").alias("y"))
    share = min(1.0, TRAINING_ROWS / max(1, labels.count()))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marked, "_id")
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(vocabulary)
        for batch in batches:
            _, text, ids = features(batch.column("text"))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), batch.column("y")], ["ids", "y"])

    sample = rows.select("text", "y").mapInArrow(run, "ids binary, y int").collect()
    return fit_softmax([np.frombuffer(r["ids"], "<u4") for r in sample], None, np.array([r["y"] for r in sample], "int64"), DIM, len(DOMAINS), l2=1e-3, steps=60, rate=0.1)


def posteriors(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` of the vocabulary, ``p_<domain>`` and the carried columns of every row, over its whole text."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype("f4"))  # DIM + 1 rows, whatever the input
    texts = carry.index(text_col) if text_col in carry else None
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_carry_{k}") for k, c in enumerate(carry)], *([] if texts is not None else [F.col(text_col).alias("_text")]))
    text_name, passed = ("_text" if texts is None else f"_carry_{texts}"), [f for f in rows.schema if f.name != "_text"]
    made = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, features = sent.value, Features(vocabulary)
        for batch in batches:
            tokens, text, ids = features(batch.column(text_name))
            z = np.column_stack([np.bincount(text, w[ids, k], batch.num_rows) for k in range(len(DOMAINS))]) + w[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), pa.array(tokens), *(pa.array(x) for x in p.T)], [*(f.name for f in passed), *made])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed), "n_tokens long", *(f"p_{d} double" for d in DOMAINS)]))


def rate_after(steps: list[list[float]]) -> Column:
    """A document's rate after projected steps from 1, each less its posterior times the step, and never under 0."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    moved = lambda s: sum((F.col(f"p_{d}") * s[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(taken, F.lit(1.0), lambda rate, s: F.greatest(F.lit(0.0), rate - moved(s)))


def fit_rates(rows: DataFrame, targets: dict[str, float], total: float | None = None, anchor: str | None = None) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(steps, expected tokens of each domain, their targets) for rows with ``n_tokens`` and posteriors.

    Targets are shares of ``total`` tokens: by default what there is, or with ``anchor`` as many
    that this domain keeps what it has. The sum of squares of what is off goes down with every
    step: one in the metric of the Gram matrix of posteriors over rows that still have a rate, or
    over all rows, if that comes much closer, else the plain projected gradient step, which always
    comes closer. Rates have no upper bound. Where no rates meet the targets the sum of squares
    that is left is near the least, and ``residual`` of ``mixed_rates`` tells it.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens").cast("double")
    k = len(DOMAINS)

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the rows that still have a rate."""
        moved = rows.withColumn("_rate", rate_after(steps))
        some = F.when(F.col("_rate") > 0, n).otherwise(0.0)
        got = [x or 0.0 for x in moved.agg(*[F.sum(n * a * F.col("_rate")) for a in p], *[F.sum(some * a * b) for a in p for b in p]).first()]
        return np.array(got[:k]), np.array(got[k:]).reshape(k, k)

    now, whole = sums([])
    share = np.array([targets[d] for d in DOMAINS])
    share = share / share.sum()
    if total is None:
        total = now.sum() if anchor is None else now[DOMAINS.index(anchor)] / share[DOMAINS.index(anchor)]
    goal, steps, moving, idle = share * total, [], whole, 0
    plain = 1 / max(np.linalg.eigvalsh(whole)[-1], 1e-12)
    while np.abs(now - goal).sum() > ENOUGH * max(total, 1.0) and idle < PATIENCE:
        off = ((now - goal) ** 2).sum()
        newton = [np.linalg.solve(m + np.eye(k) * (1e-9 * np.trace(m) + 1e-12), now - goal) for m in (moving, whole)]
        for step in (*newton, plain * (now - goal)):
            tried = [*steps, step.tolist()]
            then, left = sums(tried)
            if ((then - goal) ** 2).sum() <= (1 - NEWTON_GAIN) * off:
                break
        gained = off - ((then - goal) ** 2).sum()
        idle = idle + 1 if gained < LEAST_GAIN * off else 0
        if gained > 0:
            steps, now, moving = tried, then, left
    return steps, now, goal


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a row whose expectation is its rate, by a hash of its key."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens``, the posteriors, ``rate``, ``copies`` and ``residual`` of every row.

    ``residual`` is the share of all tokens by which the fit misses its targets, alike in all rows.
    Null and empty texts have no tokens; their rate follows from their posterior all the same.
    Texts of any length are read whole. Repeated rows come back as often as they came, rows without
    an id too. Without labels all posteriors are equal. An empty table gives none; other columns are
    ignored, whatever their names.
    """
    rows = stored(posteriors(docs, fit_domains(docs, labels, id_col, text_col, vocabulary), id_col, text_col, vocabulary=vocabulary), "posteriors")
    steps, now, goal = fit_rates(rows, targets)
    missed = float(np.abs(now - goal).sum() / max(goal.sum(), 1.0))
    return rows.withColumn("rate", rate_after(steps)).withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumn("residual", F.lit(missed))


def achieved(rates: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``domain``, expected ``tokens`` and ``target`` tokens of each domain under the rates of ``mixed_rates``."""
    n, share = F.col("n_tokens").cast("double"), sum(targets.values())
    sums = rates.agg(F.sum(n).alias("_all"), *[F.sum(n * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in DOMAINS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("tokens"), (F.col("_all") * (targets[d] / share)).alias("target")) for d in DOMAINS])).alias("_of")).select("_of.*")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = "high") -> DataFrame:
    """``docs`` with each row as often as its rate says, all its columns kept."""
    carry = tuple(docs.columns)
    rows = stored(posteriors(docs, fit_domains(docs, labels), carry=carry), "posteriors")
    steps, _, _ = fit_rates(rows, targets, anchor=anchor)
    taken = rows.withColumn("_copies", copies(rate_after(steps), F.col("doc_id"))).filter(F.col("_copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(carry)])
