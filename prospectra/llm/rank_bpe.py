"""Byte-level BPE with a contiguous rank array.

A pretoken is an array of parts and an array of the ranks of adjacent pairs. The leftmost
smallest rank is merged, one boundary goes, and the two ranks beside it are looked up anew.
Short words make this scan faster than a heap; longer ones take a heap with the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, text_batches

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pretokens of more bytes are merged with a heap.
LONG_WORD = 200
#: Bytes of pretokens and their ids that a worker remembers, in each of two generations, about; none over LONG_WORD.
REMEMBERED_BYTES = 48 << 20
NO_MERGE = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + n)
    return [shown[b] for b in range(256)]


class RankBpe:
    """Encoder and decoder from a byte-level BPE file of the tokenizers library, without its normalisers."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, shown = spec["model"]["vocab"], byte_characters()
        self.byte_id = [vocab[c] for c in shown]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        value = {c: b for b, c in enumerate(shown)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(value[c] for c in token) for token, i in vocab.items() if all(c in value for c in token)}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        # letters and numbers that this regex library knows and the tokenizers library, of an older Unicode, does not
        new = regex.compile(r"[\p{L}\p{N}]")
        self.unsure = {c for c in map(chr, range(0x530, 0x110000)) if unicodedata.category(c) == "Cn" and new.match(c)}
        self.high = regex.compile("[԰-\U0010ffff]").search
        self.library = None
        self.path = path
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bytes = 0

    def merge(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank((a << 20) | b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_MERGE:
                break
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1] << 20) | parts[at], NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank((parts[at] << 20) | parts[at + 1], NO_MERGE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank, made = len(parts), self.rank.get, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i] << 20) | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank((parts[i] << 20) | parts[after[i]])) is not None:
                    heapq.heappush(queue, (s, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (s := rank((parts[before[i]] << 20) | parts[i])) is not None:
                heapq.heappush(queue, (s, before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p >= 0]

    def _pretokens(self, text: str) -> list[str]:
        if self.high(text) and not self.unsure.isdisjoint(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def _new(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word) or tuple(self.merge(word.encode("utf-8")))
        if len(word) <= LONG_WORD:
            if self.bytes >= REMEMBERED_BYTES:
                self.older, self.known, self.bytes = self.known, {}, 0
            self.known[word] = ids
            self.bytes += 230 + 4 * len(word) + 8 * len(ids)  # two objects and their place in the table besides
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split_added(text) if self.split_added and any(a in text for a in self.added) else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            known = self.known.get
            for word in self._pretokens(part):
                out += known(word) or self._new(word)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> RankBpe:
    """One encoder for each worker process; it keeps its memory of words from task to task."""
    return resident(("bpe", path), lambda: RankBpe(path))


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text; one row for each input row.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded text), with ``ids`` also the ids themselves, and the
    ``carry`` columns. Null counts as empty, an empty text has no tokens. Bytes that are no UTF-8
    decode to U+FFFD. Texts and words of any length are encoded whole, in time that grows with
    them but for a logarithm. Repeated rows come back as often as they came, rows without an id
    too; an empty table gives none; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)])
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            n, id_digests, text_digests, lists, last = [], [], [], [], None
            for text in batch.pop("_text"):
                if ids and n and text == last:  # copies lie side by side after mixing; each text is encoded once
                    for column in (n, id_digests, text_digests, lists):
                        column.append(column[-1])
                    continue
                last = text
                found = bpe.encode(text or "")
                n.append(len(found))
                id_digests.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(found).encode("utf-8")).hexdigest())
                if ids:
                    lists.append(np.array(found, "int32"))
            yield batch.assign(n_tokens=pd.array(n, "int64"), ids_sha256=id_digests, decoded_sha256=text_digests, **({"ids": lists} if ids else {}))

    out = rows.mapInPandas(run, f"{passed}, {made}")
    return out.select("doc_id", *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else []))
