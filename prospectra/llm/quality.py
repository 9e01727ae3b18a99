"""Quality by Naive Bayes support vectors.

A text is the set of its n-grams: of words up to two, and of word shapes up to three, in which a
word that repeats the one before has a shape of its own. N-grams go by hashes. Indicators are scaled by the log ratio of
how often the two classes have them, counted over all labelled rows; a linear hinge-loss model of
the scaled indicators is fitted by dual coordinate descent on a bounded sample. Margins of rows
that a fold has not seen set the logistic curve from margin to score.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resident, stored, text_batches

#: Numbers that n-grams are hashed to.
BUCKETS = 1 << 18
#: Labelled rows that the descent fits; more are thinned by a hash of their text. All are counted for the ratios.
TRAINING_ROWS = 10_000
#: Training rows that must hold an n-gram for it to count.
LEAST_ROWS = 3
#: Rows that smoothing adds to each class's counts, in proportion to the classes: an unseen n-gram has ratio 1.
SMOOTHING = 1.0
#: Upper bound of the dual variables, and passes over the sample.
COST, PASSES = 0.1, 12
THRESHOLD = 0.3
#: Bytes of words that a worker remembers shapes of, and the longest of them.
REMEMBERED_BYTES, LONG_WORD = 16 << 20, 60

_ASCII = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+", re.S)
#: Shape of a word that repeats the one before, in any case; no hash of a shape is as large.
_SAME = np.uint64(0xFFFFFFFF)


def shape(word: str) -> str:
    """Upper case, lower case and digits as A, a and 0, other characters as they are; a run is one."""
    bare = word.rstrip(".,;:!?")
    if bare.isalpha() and len(word) - len(bare) < 2:  # most words
        if bare.islower():
            return "a" + word[len(bare) :]
        if bare.isupper():
            return "A" + word[len(bare) :]
        if bare[0].isupper() and bare[1:].islower():
            return "Aa" + word[len(bare) :]
    plain = word.translate(_ASCII)
    if not plain.isascii():
        plain = "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else c for c in plain)
    return _RUN.sub(r"\1", plain)


class _Words(dict):
    """Hashes of words, shape in the upper half, lower-case word in the lower; emptied at REMEMBERED_BYTES, without long words."""

    bytes = 0

    def __missing__(self, word: str) -> int:
        found = (crc32(shape(word).encode()) & 0x7FFFFFFF) << 32 | crc32(word.lower().encode())
        if len(word) <= LONG_WORD:
            if self.bytes > REMEMBERED_BYTES:
                self.clear()
                self.bytes = 0
            self[word] = found
            self.bytes += 200 + 4 * len(word)
        return found


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Bucket numbers of n-grams of a kind from the hashes of their parts."""
    out = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, "u8")
    for x in parts:
        out = (out ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out % np.uint64(BUCKETS)


class Reader:
    """N-grams of texts as bucket numbers, with a memory of words bounded in bytes."""

    def __init__(self):
        self.known = _Words()

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct bucket numbers of a whole text; none for one without words. Time and memory go with its words."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, "i8")
        hashes = np.fromiter(map(self.known.__getitem__, words), "u8", len(words))
        word, shapes = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        shapes[1:][word[1:] == word[:-1]] = _SAME
        one, two = np.unique(word), np.unique(word[:-1] << np.uint64(32) | word[1:])
        low = np.uint64(0xFFFFFFFF)
        pairs = np.unique(shapes[:-1] << np.uint64(32) | shapes[1:])
        grams = [_mixed(1, one), _mixed(2, two >> np.uint64(32), two & low), _mixed(3, np.unique(shapes)), _mixed(4, pairs >> np.uint64(32), pairs & low), _mixed(5, shapes[:-2], shapes[1:-1], shapes[2:])]
        return np.unique(np.concatenate(grams)).astype("i8")


def log_ratios(n1: np.ndarray, n0: np.ndarray, rows1: int, rows0: int) -> np.ndarray:
    """Log of how much likelier a row of class 1 has each n-gram than one of class 0; 0 where too few rows have it, or a class has no row."""
    if not rows1 or not rows0:
        return np.zeros(len(n1))
    share1 = SMOOTHING * rows1 / (rows1 + rows0)
    out = np.log((n1 + share1) / rows1) - np.log((n0 + SMOOTHING - share1) / rows0)
    return np.where(n1 + n0 >= LEAST_ROWS, out, 0.0)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Weights of the scaled indicators, the last one the bias: dual coordinate descent on the hinge loss.

    ``y`` is 1 or -1. Row i has one dual variable a_i from 0 to ``cost``; a step sets it to its best
    with all others fixed, and w stays the sum of a_i y_i x_i. Rows at a bound whose gradient points
    outward are passed over.
    """
    w, a, rng = np.zeros(len(ratios) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    squares = ratios * ratios
    square = np.array([squares[r].sum() + 1.0 for r in rows])
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i]
            v = ratios[at]
            slope = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(a[i] - slope / square[i], 0.0), cost)
            step = new - a[i]
            if step:
                a[i] = new
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4 * cost:
            break
    return w


def fit_curve(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a m + b))) of margins, by Newton steps on smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * at)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


class Model:
    """Weights of the indicators, bias, and the curve from margin to score."""

    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights.astype("f4"), bias, curve
        self.key = uuid.uuid4().hex

    def score(self, found: np.ndarray) -> float:
        z = self.curve[0] * (float(self.weights[found].sum()) + self.bias) + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the ratios over all labelled rows, and fit the weights on at most about TRAINING_ROWS of them.

    ``held_out`` marks rows (by ``doc_id``) whose labels are not learnt. Only ids and text join the
    labels; no other column is an input. With rows of one class only, every text scores the
    smoothed share of that class; without labels every score is 0.5.
    """
    text_batches(docs.sparkSession)
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # labels grow with the documents, so both are shuffled whatever their size
    rows = rows.filter(~(F.lit(False) if held_out is None else held_out)).join(marked.hint("merge"), "doc_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = resident("quality", Reader)
        for batch in batches:
            chance = np.array([crc32((t or "").encode()) for t in batch["text"]], "i8")
            yield pd.DataFrame({"y": (batch["y"] > 0).astype("int32"), "chance": chance, "ids": [reader.features(t).astype("i4") for t in batch["text"]]})

    train = stored(rows.mapInPandas(read, "y int, chance long, ids array<int>"), "training")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, BUCKETS), "i8")
        for batch in batches:
            for y, ids in zip(batch["y"], batch["ids"], strict=True):
                n[y, ids] += 1
        for y in (0, 1):
            seen = np.flatnonzero(n[y])
            yield pd.DataFrame({"y": np.full(len(seen), y, "i4"), "id": seen.astype("i4"), "n": n[y, seen]})

    # at most two numbers for each bucket
    seen = train.select("y", "ids").mapInPandas(counted, "y int, id int, n long").groupBy("y", "id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, BUCKETS))
    n[seen["y"].to_numpy("i8"), seen["id"].to_numpy("i8")] = seen["n"].to_numpy("f8")
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    ratios = log_ratios(n[1], n[0], sizes.get(1, 0), sizes.get(0, 0))
    if len(sizes) < 2:
        return Model(np.zeros(BUCKETS), 0.0, (1.0, float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)))))

    share = min(1.0, TRAINING_ROWS / total)
    counts = docs.sparkSession.sparkContext.broadcast(ratios != 0)  # a flag for each bucket

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "chance": batch["chance"], "ids": [ids[counts.value[ids]].astype("<i4").tobytes() for ids in batch["ids"]]})

    sample = train.filter(F.col("chance") < share * 2**32).mapInPandas(packed, "y int, chance long, ids binary").toPandas().sort_values(["chance", "y", "ids"])
    kept, y = [np.frombuffer(r, "<i4") for r in sample["ids"]], np.where(sample["y"] > 0, 1.0, -1.0)
    fold, margins = np.arange(len(kept)) % 2, np.zeros(len(kept))
    for k in (0, 1):
        mine, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        # ratios without the rows whose margins are wanted
        less = n.copy()
        for i in mine:
            less[int(y[i] > 0), kept[i]] -= 1
        own = log_ratios(less[1], less[0], max(0, sizes[1] - int((y[mine] > 0).sum())), max(0, sizes[0] - int((y[mine] < 0).sum())))
        w = fit_hinge([kept[i] for i in other], y[other], own)
        margins[mine] = [w[kept[i]] @ own[kept[i]] + w[-1] for i in mine]
    w = fit_hinge(kept, y, ratios)
    return Model(w[:-1] * ratios, float(w[-1]), fit_curve(margins, y) if len(set(y.tolist())) > 1 else (1.0, 0.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` from 0 to 1 of every row, over its whole text."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number for each bucket, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, reader = sent.value, resident("quality", Reader)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": np.array([model.score(reader.features(t)) for t in batch["text"]], "f8")})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, score double")


def held_out_fifth() -> Column:
    """Rows whose labels are kept for measuring."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from THRESHOLD on) of every row.

    Labels are learnt only from rows that are not held out; of repeated labels the lower counts.
    Null and empty texts get the score of a text without any n-gram. Repeated rows come back as
    often as they came, rows without an id too (not held out). Texts of any length are read whole.
    An empty table gives none; other columns are ignored, whatever their names.
    """
    held = F.coalesce(held_out_fifth(), F.lit(False))
    scored = score(docs, fit(docs, labels, held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
