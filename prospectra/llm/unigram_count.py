"""Token counts of a unigram vocabulary without making tokens.

An Aho-Corasick automaton finds every vocabulary piece in a chunk; dynamic programming over the
positions carries the best score, its number of pieces and nothing else. Ties go as in the
tokenizer: a later candidate must be strictly better, and candidates come by ascending start.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, text_batches

DEFAULT_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: What an unknown character scores below the worst piece, as in the tokenizer.
UNKNOWN_PENALTY = 10.0
#: Bytes of chunks remembered by a worker, the longest remembered, and what an entry takes besides its text.
MEMORY, LONG, ENTRY = 64 << 20, 200, 200


class UnigramCounter:
    """Pieces and scores read as a unigram vocabulary with byte fallback.

    A text is cut wherever no piece crosses: before a space mark that follows another character and
    around line ends, or not at all if some piece crosses there. Sums of whole numbers are exact, so
    with whole scores a chunk is counted once and remembered; other scores are summed over the whole
    text in the tokenizer's order, chunk after chunk, each from where the one before it ended.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.whole = all(float(s).is_integer() for s in pieces.values())
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.cut = (lambda text: [text]) if crossing else regex.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        self.known: dict[str, tuple[int, float]] = {}
        self.known_bytes = 0

    @classmethod
    def of_model(cls, path: str) -> UnigramCounter:
        """From a SentencePiece model."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def chunk(self, chunk: str, start_score: float = 0.0) -> tuple[int, float]:
        """Pieces (an unknown character as its bytes) and score of the best path, added to what stands before it."""
        n = len(chunk)
        best: list[float | None] = [start_score] + [None] * n
        count = [0] * (n + 1)
        at, single = 0, [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(chunk):
            ends[end].append((length, score))
            if length == 1:
                single[end] = True
        for at in range(n):
            to = at + 1
            if not single[at]:
                ends[at].append((1, self.unknown))
            for length, score in sorted(ends[at], reverse=True):  # ascending start
                start = to - length
                total = best[start] + score
                if best[to] is None or total > best[to]:
                    best[to] = total
                    count[to] = count[start] + (1 if length > 1 or single[at] else len(chunk[at].encode("utf-8")))
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and best score of a whole text; an empty text has none."""
        if not text:
            return 0, 0.0
        pieces, total = 0, 0.0
        for chunk in self.cut(SPACE + text.replace(" ", SPACE)):
            if self.whole:
                found = self.known.get(chunk) or self._new(chunk)
                total += found[1]
            else:
                found = self.chunk(chunk, total)
                total = found[1]
            pieces += found[0]
        return pieces, total

    def _new(self, chunk: str) -> tuple[int, float]:
        found = self.chunk(chunk)
        if len(chunk) <= LONG:
            self.known_bytes += 4 * len(chunk) + ENTRY
            if self.known_bytes > MEMORY:
                self.known, self.known_bytes = {}, 0
            self.known[chunk] = found
        return found


def load(path: str) -> UnigramCounter:
    return resident(("unigram", path), lambda: UnigramCounter.of_model(path))


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``best_score`` of every whole text.

    Null counts as empty; empty texts have no tokens and score 0. Texts of any length are counted
    whole. Repeated rows come back as often as they came, rows without an id too; an empty table
    gives none; other columns are ignored, whatever their names.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = load(vocabulary)
        for batch in batches:
            found = [counter.count(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [n for n, _ in found], "best_score": [s for _, s in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, best_score double")
