"""Token ids in Parquet: list columns in id order, small row groups, page indexes.

The metadata (id, order in the file, number of tokens) stands in columns of its own, so that
offsets can be worked out without reading a token, and a range of ids needs only its row groups.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, shared_folder, text_batches
from .rank_bpe import byte_characters

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Bytes of a row group, bytes of a page and rows of a page: a reader of few documents reads little more.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",  # ids under the dictionary's size take 16 bits or fewer
    "parquet.writer.version": "v2",  # where a dictionary does not pay, integers are delta-encoded
    "compression": "zstd",
}
FILE_SCHEMA = "doc_id long, part int, seq long, n_tokens int, ids array<int>"
#: Bytes that a worker remembers of chunks and their ids, and of pieces.
CHUNK_MEMORY, PIECE_MEMORY = 32 << 20, 32 << 20
#: What an entry of a dictionary takes besides its bytes.
ENTRY = 170
#: The normaliser and the pretokens for which chunks are exact (fixed values), and the letters and signs whose normal form is their lower case.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_LATIN = "^[!-~¡-¬®-įı-ž]*$"
#: Stands for the space between chunks; no id is as large.
BETWEEN = 0xFFFFFFFF


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def chunked(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks between ASCII white space of all texts, dictionary-encoded, and where each text's end. Some may be empty."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[1:].astype("i8") - lists.offsets[0].as_py()


class WholeEncoder:
    """The tokenizers library over whole texts: right for any vocabulary."""

    def __init__(self, path: str):
        self.library = _library(path)

    def encode(self, texts: pa.Array, tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, ``tail`` after each, and how many each has."""
        found = [e.ids + list(tail) for t in texts.to_pylist() for e in self.library.encode_batch_fast([t or ""], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], "i8")


class ChunkEncoder:
    """The tokenizers library over the distinct chunks between white space.

    With NORMALIZERS and PIECES no pretoken crosses white space and each character is normalised
    alone or with the combining marks after it, so a text's ids are those of its chunks in order.
    Chunks of plain Latin characters, which the normaliser only lower-cases, are split into pieces, and
    pieces not met before go to the library's model together; all other chunks through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = _library(path)
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces_of = regex.compile(PIECES + "| ").findall
        self.shown = dict(enumerate(byte_characters())) | {0x20: " "}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces, self.piece_bytes = {" ": np.array([BETWEEN], "<u4").tobytes()}, 0
        # chunks remembered, where the ids of each begin in ``flat``, and how many they are
        self.chunks, self.first, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "<u4")

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normalizer, steps, model = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers", []), spec["model"]
        split = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
        bytes_ = [{**s, "trim_offsets": True} for s in steps[1:]] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        added = all("<|" in x["content"] and not any(map(str.isspace, x["content"])) and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])
        ended = model.get("end_of_word_suffix") == "</w>" and all(c in model["vocab"] and f"{c}</w>" in model["vocab"] for c in byte_characters())
        return normalizer.get("normalizers") == NORMALIZERS and steps[:1] == [split] and bytes_ and added and ended

    def _learn_pieces(self, new: list[str], wanted: set[str]) -> None:
        text = " ".join(new).encode("utf-8").decode("latin-1").translate(self.shown)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops, data = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
        self.piece_bytes += len(data) + len(text) + ENTRY * len(new)
        if self.piece_bytes > PIECE_MEMORY:
            self.pieces, self.piece_bytes = {p: self.pieces[p] for p in wanted if p in self.pieces}, 0
        self.pieces.update(zip(new, [data[a:b] for a, b in zip([0, *stops], stops)], strict=True))

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each chunk begin, how many they are, and all ids."""
        plain = pc.and_(pc.match_substring_regex(chunks, PLAIN_LATIN), pc.invert(pc.match_substring(chunks, "<|")))
        odd = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(chunks.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        found = self.pieces_of(" ".join([*chunks.filter(plain).to_pylist(), ""]).lower())
        wanted = {" ", *found}
        if new := [p for p in wanted if p not in self.pieces]:
            self._learn_pieces(new, wanted)
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), "<u4")
        between = np.flatnonzero(ids == BETWEEN)
        size, plain = np.zeros(len(chunks), "i8"), plain.to_numpy(zero_copy_only=False)
        size[plain], size[~plain] = np.diff(between, prepend=-1) - 1, [len(x) for x in odd]
        first = np.zeros(len(chunks), "i8")
        first[plain], first[~plain] = size[plain].cumsum() - size[plain], size[~plain].cumsum() - size[~plain] + size[plain].sum()
        return first, size, np.concatenate([ids[ids != BETWEEN], *odd])

    def _remembered(self, chunks: pa.Array) -> np.ndarray:
        """The place of each of some distinct chunks among those remembered, which they are then."""
        at = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(pc.is_null(at))
        place = at.fill_null(-1).to_numpy().astype("i8")
        place[place < 0] = len(self.chunks) + np.arange(len(new))
        if len(new):
            first, size, flat = self._learn(new)
            self.first, self.size, self.flat = np.concatenate([self.first, first + len(self.flat)]), np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            self.chunks = pa.concat_arrays([self.chunks, new])
        return place

    def sizes(self, chunks: pa.Array) -> np.ndarray:
        """How many ids each of some distinct chunks has."""
        place = self._remembered(chunks)
        size = self.size[place]
        self._forget(place)
        return size

    def _forget(self, place: np.ndarray) -> None:
        """Beyond CHUNK_MEMORY only the chunks last asked for are kept."""
        if self.chunks.nbytes + self.first.nbytes + self.size.nbytes + self.flat.nbytes > CHUNK_MEMORY:
            first, size = self.first[place], self.size[place]
            self.flat = self.flat[_slices(first, size)]
            self.chunks, self.first, self.size = self.chunks.take(pa.array(place)), size.cumsum() - size, size

    def encode(self, texts: pa.Array, tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, ``tail`` after each, and how many each has."""
        coded, stops = chunked(texts)
        place = self._remembered(coded.dictionary)
        first, size = np.append(self.first[place], len(self.flat)), np.append(self.size[place], len(tail))
        chunk = np.insert(coded.indices.to_numpy(), stops, len(place))
        taken = size[chunk]
        ids = np.append(self.flat, np.array(tail, "<u4"))[_slices(first[chunk], taken)]
        self._forget(place)
        return ids, np.diff(taken.cumsum()[stops + np.arange(len(stops))], prepend=0)


def _slices(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes first, first + 1, .. of each slice, one slice after another."""
    return np.arange(size.sum()) + np.repeat(first - size.cumsum() + size, size)


def load(path: str) -> ChunkEncoder | WholeEncoder:
    """One encoder for each worker process: by chunks where the file's normaliser and pretokens allow it."""
    return resident(("tokens", path), lambda: (ChunkEncoder if ChunkEncoder.fits(path) else WholeEncoder)(path))


def write_token_files(docs: DataFrame, path: str, vocabulary: str = DEFAULT_VOCABULARY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text with any vocabulary file of the library and write the ids in ascending id order.

    Null text counts as empty; ``end_id``, if any, follows each document. Null ids come first.
    Rows that share an id stand in order of their text. Files are in order of ``part``, rows in
    order of ``seq``. An empty table writes no rows.
    """
    text_batches(docs.sparkSession)
    tail = () if end_id is None else (end_id,)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = load(vocabulary), 0
        for batch in batches:
            ids, sizes = encoder.encode(batch.column("text"), tail)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32")), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.arange(seq, seq + len(sizes))), pa.array(sizes.astype("int32")), lists], schema=schema)
            seq += len(sizes)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, FILE_SCHEMA).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(np.asarray(x, "int32").astype("<u4").tobytes()) for x in ids], dtype="int64")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, all from the files."""
    text_batches(spark)
    rows = read_token_files(spark, path).select("doc_id", "part", "seq", F.col("n_tokens").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
    # one row a file: their starts are summed in one place, and what they are joined to stays where it is
    parts = read_token_files(spark, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("_sum"))
    starts = parts.select("part", (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(starts), "part")
    return out.select("doc_id", (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, **options) -> DataFrame:
    """Write the token files to the shared folder and return the index read from them.

    Texts of any length are encoded whole. Null counts as empty; every document ends with the end id.
    Rows without an id come first, repeated rows as often as they came. An empty table gives none;
    other columns are ignored, whatever their names.
    """
    path = f"{shared_folder(docs.sparkSession)}/token_files"
    write_token_files(docs, path, **options)
    return token_index(docs.sparkSession, path)
