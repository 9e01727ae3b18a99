"""Files of ``elements`` read by byte ranges, so that one large file is the work of many tasks.

Spark's text reader cuts a file anywhere and deals whole records, here the pieces between closing
braces. What a cut stands in - a string, how many braces deep, the ``elements`` or another array -
follows from all that is before it. So each range is summed up first, for a beginning inside and
outside of a string; the sums of a file are chained, and each range is read again from its true
beginning. Elements that cross a cut come in parts, which are put together at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .poi import ELEMENT

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_NAMED = re.compile(r"\s*:\s*\[")
_NAME = '"elements"'
#: Depth of the top object's members, and of its arrays' members.
_TOP, _MEMBER = 1, 2


class Reader:
    """Goes through pieces in order, keeping whether it is in a string, how deep, and which ``elements`` arrays are open."""

    def __init__(self, inside: bool, depth: int = 0, within: bool = False):
        self.inside, self.depth, self.low = inside, depth, depth
        self.opened = [_TOP] if within else []  # depths at which an array of this name was opened
        self.parts: list[str] = []
        self.taking = within and depth > _MEMBER
        self.began = False

    def piece(self, text: str, elements: list[tuple[str, str]] | None = None) -> None:
        """One piece and the closing brace after it. ``elements`` gets (kind, text) of each element that ends here."""
        at = 0
        start = 0 if self.taking else None
        if self.inside:
            end = _STRING_END.match(text)
            at = end.end()
            self.inside = not end[1]
        named = False
        while not self.inside:
            m = _TOKEN.search(text, at)
            if not m:
                break
            at = m.end()
            token = m[0]
            if token[0] == '"':
                self.inside = not m[1] or len(token) == 1
                if token == _NAME and (array := _NAMED.match(text, at)):
                    named, at = True, array.end() - 1
                continue
            if token in "{[":
                if token == "{" and self.depth == _MEMBER and self.opened[:1] == [_TOP] and elements is not None:
                    self.taking, self.began, start = True, True, m.start()
                if named:
                    self.opened.append(self.depth)
                self.depth += 1
            else:
                self._closed()
            named = False
        if start is not None:
            self.parts.append(text[start:])
        if self.inside:
            if self.taking:
                self.parts.append("}")
            return
        self._closed()
        if self.taking:
            self.parts.append("}")
            if self.depth == _MEMBER:
                elements.append(("whole" if self.began else "end", "".join(self.parts)))
                self.parts, self.taking, self.began = [], False, False

    def _closed(self) -> None:
        self.depth -= 1
        self.low = min(self.low, self.depth)
        while self.opened and self.opened[-1] >= self.depth:
            self.opened.pop()


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, pd.Series, bool]]:
    """(file, start, pieces, whether the range begins) of each stretch of pieces of one range."""
    before = None
    for batch in batches:
        cut = (batch["path"] != batch["path"].shift()) | (batch["start"] != batch["start"].shift())
        for _, rows in batch.groupby(cut.cumsum()):
            key = rows["path"].iloc[0], int(rows["start"].iloc[0])
            yield *key, rows["value"], key != before
            before = key


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here, readers = None, ()

    def row() -> pd.DataFrame:
        return pd.DataFrame([{"path": here[0], "start": here[1]} | {f"{name}{k}": value for k, r in enumerate(readers) for name, value in (("inside", r.inside), ("depth", r.depth), ("low", r.low), ("opened", r.opened))}])

    for path, start, pieces, begins in _ranges(batches):
        if begins:
            if here:
                yield row()
            here, readers = (path, start), (Reader(False), Reader(True))
        for text in pieces:
            for r in readers:
                r.piece(text)
    if here:
        yield row()


def _beginnings(sums: DataFrame) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """What each range begins in. The driver sees a few numbers for each range of a file, whatever is in it."""
    out, file, state = {}, None, (False, 0, False)
    for r in sums.orderBy("path", "start").toLocalIterator():
        if r["path"] != file:
            file, state = r["path"], (False, 0, False)
        out[file, r["start"]] = state
        inside, depth, within = state
        k = int(inside)
        held = within and depth + r[f"low{k}"] > _TOP
        state = r[f"inside{k}"], depth + r[f"depth{k}"], held or _TOP - depth in r[f"opened{k}"]
    return out


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row for each of the ``elements`` of a file, or of all files of a folder.

    Files may be written in any way that is valid JSON, each as one object; elements of other
    arrays and of nested ones do not count. A file without elements gives none. Both readings must
    cut files alike, so the session's ``spark.sql.files.minPartitionNum`` is set where it is not, to the
    number of cores now: executors that come or go meanwhile move no cut.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    half = lambda k: f"inside{k} boolean, depth{k} long, low{k} long, opened{k} array<long>"
    states = spark.sparkContext.broadcast(_beginnings(pieces.mapInPandas(_summed, f"path string, start long, {half(0)}, {half(1)}")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, reader = None, None

        def frame(found: list[tuple[str, str]]) -> pd.DataFrame:
            return pd.DataFrame({"path": here[0], "start": here[1], "kind": [k for k, _ in found], "text": [t for _, t in found]})

        def left() -> list[tuple[str, str]]:
            return [("begin" if reader.began else "middle", "".join(reader.parts))] if reader and reader.taking else []

        for path, start, texts, begins in _ranges(batches):
            if begins:
                if rest := left():
                    yield frame(rest)
                if (path, start) not in states.value:
                    raise RuntimeError(f"{path} is cut at {start} now, and was not before: it or the session's spark.sql.files settings have changed")
                here, reader = (path, start), Reader(*states.value[path, start])
            found: list[tuple[str, str]] = []
            for text in texts:
                reader.piece(text, found)
            if found:
                yield frame(found)
        if rest := left():
            yield frame(rest)

    parts = pieces.mapInPandas(run, "path string, start long, kind string, text string")
    cut = parts.filter("kind <> 'whole'")  # two a range at most
    number = F.sum((F.col("kind") == "begin").cast("int")).over(Window.partitionBy("path").orderBy("start", F.col("kind") == "begin"))
    joined = cut.withColumn("_element", number).groupBy("path", "_element").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    text = parts.filter("kind = 'whole'").select("text").unionByName(joined.select("text"))
    return text.select(F.from_json("text", ELEMENT).alias("e")).select("e.*")
