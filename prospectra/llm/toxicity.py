"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words in disguise - digits and signs for
letters, letters set apart, letters repeated - are lattices of what each character may stand for;
the Viterbi path under the model restores the word. The restored text is scored by a linear model
on words and word beginnings, fitted on labelled rows; a word counts as it stands and as restored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resident, stored, text_batches
from .linear import fit_softmax

#: What a sign may stand for (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Natural log of the channel's probabilities: a sign for a letter, a letter dropped from a repeat, a gap closed.
SWAP, DROP, CLOSE = log(0.2), log(0.3), log(0.2)
#: Labelled rows that fit the classifier; more are thinned by a hash of their text.
TRAINING_ROWS = 30_000
#: Toxic training rows that must hold a feature, and how much likelier it must be in toxic ones, to count.
LEAST_TOXIC, LEAST_ODDS = 3, 4.0
#: Lengths of the word beginnings among the features.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Words remembered by a worker, and their longest.
REMEMBERED, LONG_WORD = 300_000, 100

_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"
_CLASSES = 64  # 0 gap, 1.. letters, 61 digit, 62 sign, 63 other letter
_EDGE = ".,;:?\"'()[]{}…*#%&«»¿¡<>=~^`_/\\-"  # at a word's ends never a letter
_SIGN = "".join(c for c in STANDS_FOR if not c.isalnum())  # at a word's ends maybe a letter, maybe not
_ONE, _GAP = rf"(?:[^\W_]|[{re.escape(_SIGN)}])", r"[ .\-_*]+"
_APART = re.compile(rf"(?<!\S){_ONE}(?:{_GAP}{_ONE}){{2,}}(?=[{re.escape(_EDGE)}]*(?!\S))")
_GAPS = re.compile(_GAP)
_DISGUISE = re.compile(f"[{re.escape(''.join(STANDS_FOR))}]")
_REPEAT = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2.*?([^\W\d_])\3")


def _class_table() -> np.ndarray:
    table = np.full(0x250, 62, "u1")
    for c in range(0x250):
        if chr(c).isspace():
            table[c] = 0
        elif chr(c).isdigit():
            table[c] = 61
        elif chr(c).isalpha():
            table[c] = _LETTERS.find(chr(c)) + 1 or 63
    return table


CLASS_OF = _class_table()


def char_class(c: str) -> int:
    return int(CLASS_OF[ord(c)]) if ord(c) < 0x250 else 63 if c.isalpha() else 0 if c.isspace() else 62


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(``code``, ``n``): how often each three character classes follow another, over all whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_CLASSES**3, "int64")
        for batch in batches:
            # white space parts the texts and makes the gap before the first word
            text = "  ".join(["", *(t for t in batch["text"] if t), ""]).lower()
            points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            kinds = CLASS_OF[np.minimum(points, 0x24F)].astype("i4")
            kinds[points >= 0x250] = 63
            total += np.bincount(kinds[:-2] * _CLASSES**2 + kinds[1:-1] * _CLASSES + kinds[2:], minlength=_CLASSES**3)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"code": seen, "n": total[seen]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a, b), smoothed by P(c | b) and P(c). At most 64^3 counts come to the driver."""
    seen = counts.toPandas()
    n = np.zeros(_CLASSES**3)
    n[seen["code"].to_numpy("int64")] = seen["n"].to_numpy("float64")
    n = n.reshape(_CLASSES, _CLASSES, _CLASSES)
    one = (n.sum(axis=(0, 1)) + 0.5) / (n.sum() + 0.5 * _CLASSES)
    two = n.sum(axis=0)
    two = (two + 8 * one) / (two.sum(axis=1, keepdims=True) + 8)
    return np.log((n + 4 * two[None]) / (n.sum(axis=2, keepdims=True) + 4)).astype("f4").reshape(-1)


Lattice = list[list[tuple[str, float]]]


class Restorer:
    """Viterbi decoding of disguised words; the state is the last two character classes."""

    def __init__(self, model: np.ndarray):
        self.model_array, self.model = model, model.tolist()

    def decode(self, lattice: Lattice) -> str:
        """The best string through a lattice of (characters, log probability) choices for each place.

        Back-pointers lead from each place's states to the place before. Where one state is left
        the way to it is certain: it is written out and its back-pointers go, so that time grows
        with the length and memory with the longest doubtful stretch.
        """
        model, made = self.model, []
        states, scores, back = [0], [0.0], []
        for choices in [*lattice, [(" ", 0.0)]]:
            step: dict[int, tuple[float, int, int]] = {}
            kinds = [(k, chance, [char_class(c) for c in text]) for k, (text, chance) in enumerate(choices)]
            for at, (state, total) in enumerate(zip(states, scores, strict=True)):
                for k, chance, classes in kinds:
                    score, now = total + chance, state
                    for c in classes:
                        now = now * _CLASSES + c
                        score += model[now]
                        now %= _CLASSES * _CLASSES
                    if now not in step or score > step[now][0]:
                        step[now] = (score, at, k)
            states, scores = list(step), [x[0] for x in step.values()]
            back.append((choices, [x[1:] for x in step.values()]))
            if len(states) == 1:
                self._write(back, 0, made)
                back = []
        self._write(back, scores.index(max(scores)), made)
        return "".join(made).strip()

    @staticmethod
    def _write(back: list, at: int, made: list[str]) -> None:
        texts = []
        for choices, came in reversed(back):
            at, k = came[at]
            texts.append(choices[k][0])
        made += reversed(texts)

    @staticmethod
    def _meant(sign: str) -> list[tuple[str, float]]:
        return [(sign, 0.0), *((c, SWAP) for c in STANDS_FOR.get(sign, ""))]

    @classmethod
    def lattice(cls, word: str) -> Lattice:
        """Signs may be letters; of letters alike side by side fewer may be meant."""
        out: Lattice = []
        for m in re.finditer(r"(.)\1*", word, re.S):
            run, meant = len(m[0]), cls._meant(m[1])
            if run == 1:
                out.append(meant)
            else:
                out.append([(c * k, p + (DROP if k < run else 0.0)) for c, p in meant for k in sorted({1, 2, run})])
        return out

    def forms(self, word: str) -> set[str]:
        """A word as it stands and, where it looks disguised, restored: without signs at its ends, and with them as what they may be."""
        whole = word.strip(_EDGE)
        core = whole.strip(_SIGN + _EDGE)
        found = {core}
        for part in {core, whole}:
            if any(map(str.isalpha, part)) and (_DISGUISE.search(part) or _REPEAT.search(part)):
                found.add(self.decode(self.lattice(part)).strip(_SIGN + _EDGE))
        return found

    @classmethod
    def apart_lattice(cls, run: str) -> Lattice:
        """Letters set apart: each gap stays or closes."""
        out: Lattice = []
        for c in _GAPS.split(run):
            out += [[(" ", 0.0), ("", CLOSE)]] * bool(out) + [cls._meant(c)]
        return out

    def words(self, text: str) -> set[str]:
        """The distinct words of a text, and those that the model makes of letters set apart."""
        text = text.lower()
        found = set(text.split())
        for m in _APART.finditer(text):
            found.update(self.decode(self.apart_lattice(m[0])).split())
        return found


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k)] if len(word) > 2 else []


class Scorer:
    """Feature ids of whole texts, with a memory of words; ``ids`` None stands for all features."""

    def __init__(self, model: np.ndarray, ids: dict[str, int] | None = None):
        self.restorer, self.ids, self.known = Restorer(model), ids, {}

    def of_word(self, word: str) -> tuple:
        found = {f for form in self.restorer.forms(word) for f in word_features(form)}
        found = tuple(found) if self.ids is None else tuple(self.ids[f] for f in found if f in self.ids)
        if len(word) <= LONG_WORD:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str | None) -> set:
        known, out = self.known, set()
        for word in self.restorer.words(text or ""):
            found = known.get(word)
            if found is None:
                found = self.of_word(word)
            if found:
                out.update(found)
        return out


class Model:
    """What a worker needs to score texts: the character model, the features, their weights."""

    def __init__(self, characters: np.ndarray, ids: dict[str, int], weights: np.ndarray, bias: float):
        self.characters, self.ids, self.weights, self.bias = characters, ids, weights, bias
        self.key = uuid.uuid4().hex


def _training(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """(``text``, ``y``) of the labelled rows that may be learnt from, at most about TRAINING_ROWS."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(~held_out).join(marked, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")
    share = min(1.0, TRAINING_ROWS / max(1, labels.count()))
    return stored(rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000), "training")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the character model over ``docs`` and fit the classifier on its labelled rows.

    ``held_out`` marks rows (by ``doc_id``) whose labels are not learnt. Only ids and text join the
    labels; no other column is an input. Without labels every score is 0.5 or less.
    """
    spark = docs.sparkSession
    text_batches(spark)
    characters = language_model(trigram_counts(docs, text_col))
    train = _training(docs, labels, label, F.lit(False) if held_out is None else held_out, id_col, text_col)

    def counted(wanted: dict[str, int] | None, y: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer, n = Scorer(characters), {}
            for batch in batches:
                for text, label in zip(batch["text"], batch["y"], strict=True):
                    if label == y:
                        for f in scorer.features(text):
                            if wanted is None or f in wanted:
                                n[f] = n.get(f, 0) + 1
            names, sums = list(n), list(n.values())
            for at in range(0, len(names), 20_000):
                yield pd.DataFrame({"feature": pd.Series(names[at : at + 20_000], dtype="object"), "n": np.array(sums[at : at + 20_000], "int64")})

        return train.mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    # features of toxic rows first, then how often they are in the others; the training rows bound both
    toxic = counted(None, 1).filter(F.col("n") >= LEAST_TOXIC).toPandas()
    clean = counted(dict.fromkeys(toxic["feature"], 0), 0).toPandas() if len(toxic) else toxic
    sizes = {int(r["y"] > 0): r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = dict(zip(toxic["feature"], toxic["n"], strict=True)), dict(zip(clean["feature"], clean["n"], strict=True))
    in_toxic, in_clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = {f: ((n + 0.5) / (in_toxic + 1)) / ((n0.get(f, 0) + 0.5) / (in_clean + 1)) for f, n in n1.items()}
    ids = {f: k for k, f in enumerate(sorted(f for f in n1 if odds[f] >= LEAST_ODDS))}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(characters, ids)
        for batch in batches:
            yield pd.DataFrame({"ids": [sorted(scorer.features(t)) for t in batch["text"]], "y": batch["y"]})

    sample = train.mapInPandas(held, "ids array<int>, y int").toPandas()
    weights = fit_softmax([np.array(r, "int64") for r in sample["ids"]], None, (sample["y"] > 0).to_numpy("int64"), len(ids), 2, l2=1e-5, balanced=True)
    margin = weights[:, 1] - weights[:, 0]
    return Model(characters, ids, margin[:-1], float(margin[-1]) if len(sample) else -20.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``score`` from 0 to 1 of every row, over its whole text; the ``carry`` columns in ``carried``."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64^3 floats and words of the training rows, whatever the input
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_carry_{k}") for k, c in enumerate(carry)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        scorer = resident(("toxicity", m.key), lambda: Scorer(m.characters, m.ids))
        for batch in batches:
            z = np.array([m.bias + sum(m.weights[k] for k in scorer.features(t)) for t in batch["_text"]])
            yield batch.assign(score=1 / (1 + np.exp(-np.clip(z, -500, 500))))

    out = rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")
    return out.select("doc_id", "score", *([F.struct(*[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(carry)]).alias("carried")] if carry else []))


def held_out_third() -> Column:
    """Rows whose labels are kept for measuring."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from THRESHOLD on) of every row.

    Labels are learnt only from rows that are not held out. Null and empty texts get the score of
    a text without any feature. Repeated rows come back as often as they came, rows without an id
    too (not held out); repeated labels count once, the toxic one first. Texts of any length are
    read whole. An empty table gives none; other columns are ignored, whatever their names.
    """
    scored = score(docs, fit(docs, labels, F.coalesce(held_out_third(), F.lit(False))))
    return scored.select("doc_id", F.coalesce(held_out_third(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under THRESHOLD, with all their columns."""
    model = fit(docs, labels, F.coalesce(held_out_third(), F.lit(False)))
    return score(docs, model, carry=tuple(docs.columns)).filter(F.col("score") < THRESHOLD).select("carried.*")
