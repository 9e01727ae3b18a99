"""Codes of vectors by product quantisation, with codebooks from dual-tree Lloyd rounds in integers.

The parts of a block of rows stand in a tree of boxes that holds the count and the sums of each
node; a codebook stands in another. Both are descended together: bounds on the squared distance
between two boxes prune the entries that can be nearest to no part of a node. A node that one entry
is left for is assigned whole, by its cached sums; leaves that stay uncertain are compared in
integers. All bounds are integers too, so that the result is that of plain Lloyd rounds, to the bit.
The trees are built once and stored; a round reads them and sends one row of sums for each entry
and task. The driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components beyond this count as this, so that squared distances fit into 64 bits.
LARGEST = 1 << 24
#: Components of a block, whose rows have one set of trees; bounds a task's memory.
BLOCK_COMPONENTS = 1 << 19
LEAF_ROWS = 32
#: Pairs of nodes in one step of the descent; bounds its memory.
STEP_PAIRS = 1 << 15


@dataclass
class Tree:
    """Nodes, parents first: rows ``start`` to ``stop`` of ``points``, box, sums, first of two children or -1."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int) -> Tree:
        """Halves along the widest side until at most ``leaf`` points are left, or all are equal."""
        order, spans, child, low, high, sums = np.arange(len(points)), [(0, len(points))], [], [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            here = points[order[a:b]]
            low.append(here.min(axis=0))
            high.append(here.max(axis=0))
            sums.append(here.sum(axis=0))
            side = int(np.argmax(high[-1] - low[-1])) if points.shape[1] else 0
            if b - a <= leaf or not points.shape[1] or high[-1][side] == low[-1][side]:
                child.append(-1)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(here[:, side], half)]
                child.append(len(spans))
                spans += [(a, a + half), (a + half, b)]
            at += 1
        start, stop = np.array(spans, "i8").T
        return cls(order.astype("i8"), points[order], start, stop, np.array(child, "i8"), np.array(low, "i8"), np.array(high, "i8"), np.array(sums, "i8"))

    _shapes = (("order", "<i8", 0), ("points", "<i4", 1), ("start", "<i8", 0), ("stop", "<i8", 0), ("child", "<i8", 0), ("low", "<i4", 1), ("high", "<i4", 1), ("sums", "<i8", 1))

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind, _ in self._shapes}

    @classmethod
    def unpacked(cls, data: dict[str, bytes], width: int) -> Tree:
        flat = {name: np.frombuffer(data[name], kind).astype("i8") for name, kind, _ in cls._shapes}
        n, nodes = len(flat["order"]), len(flat["start"])
        return cls(**{name: flat[name].reshape(n if name == "points" else nodes, width) if deep else flat[name] for name, _, deep in cls._shapes})


class Codebook:
    """Entries and the tree over the distinct ones; of equal entries the first takes all."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        self.entries, self.first = entries, np.sort(first)
        self.tree = Tree.of(entries[self.first], 1)
        self.entry = self.first[self.tree.order]  # by place in the tree


def _bounds(a: Tree, x: np.ndarray, b: Tree, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of nodes ``x`` of one tree and ``y`` of the other."""
    near, far = np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
    for at in range(0, len(x), STEP_PAIRS):
        i, j = x[at : at + STEP_PAIRS], y[at : at + STEP_PAIRS]
        over, under = a.low[i] - b.high[j], b.low[j] - a.high[i]
        gap, reach = np.maximum(np.maximum(over, under), 0), np.maximum(-over, -under)
        near[at : at + STEP_PAIRS] = np.einsum("ij,ij->i", gap, gap)
        far[at : at + STEP_PAIRS] = np.einsum("ij,ij->i", reach, reach)
    return near, far


def _beaten(a: Tree, x: np.ndarray, b: Tree, rival: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether entry ``rival`` is nearer than entry ``y`` to every point of node ``x``, the corner of its box that is worst for it included."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), STEP_PAIRS):
        i, r, e = x[at : at + STEP_PAIRS], b.low[rival[at : at + STEP_PAIRS]], b.low[y[at : at + STEP_PAIRS]]
        away = r - e
        least = np.einsum("ij,ij->i", np.where(away > 0, a.low[i], a.high[i]), away)
        out[at : at + STEP_PAIRS] = np.einsum("ij,ij->i", away, r + e) < 2 * least
    return out


def descend(parts: Tree, book: Codebook) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Node pairs (node, entry) that are certain, and (leaf, place of an entry in the tree) that are not.

    All pairs of a leaf stand together. A pair goes where its least distance is above the smallest
    of the node's greatest ones, a single entry also where a rival is nearer to all of the node's box.
    """
    entries = book.tree
    x, y = np.zeros(1, "i8"), np.zeros(1, "i8")
    whole, open_pairs = [], []
    while len(x):
        near, far = _bounds(parts, x, entries, y)
        heads = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        sizes = np.diff(np.append(heads, len(x)))
        least = np.repeat(np.minimum.reduceat(far, heads), sizes)
        left = near <= least
        rivals = np.flatnonzero(left & (far == least))
        rivals = rivals[np.append(True, x[rivals][1:] != x[rivals][:-1])]  # one for each node
        rival = np.repeat(y[rivals], sizes)
        single = entries.child[y] < 0
        alone = np.flatnonzero(left & single & (entries.child[rival] < 0) & (rival != y))
        left[alone[_beaten(parts, x[alone], entries, rival[alone], y[alone])]] = False
        x, y, single = x[left], y[left], single[left]
        heads = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        sizes = np.diff(np.append(heads, len(x)))
        sure = np.repeat(sizes == 1, sizes) & single
        whole.append((x[sure], book.entry[entries.start[y[sure]]]))
        done = np.repeat(np.logical_and.reduceat(single, heads), sizes) & (parts.child[x] < 0) & ~sure
        open_pairs.append((x[done], entries.start[y[done]]))
        x, y = x[~sure & ~done], y[~sure & ~done]
        for tree, mine in ((parts, 0), (entries, 1)):
            nodes = (x, y)[mine]
            inner = tree.child[nodes] >= 0
            first = np.where(inner, tree.child[nodes], nodes)
            twice = np.repeat(np.arange(len(nodes)), 1 + inner)
            second = np.append(False, twice[1:] == twice[:-1]) if len(twice) else np.zeros(0, bool)
            moved = first[twice] + second
            x, y = (moved, y[twice]) if not mine else (x[twice], moved)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
    return whole, open_pairs


def assigned(parts: Tree, book: Codebook, sums: np.ndarray | None = None, want_codes: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Add count and sums of every entry's parts to ``sums`` (entries, 1 + width), or give code and squared distance of each row."""
    whole, open_pairs = descend(parts, book)
    code = np.zeros(len(parts.order), "i8") if want_codes else None
    for nodes, entry in whole:
        if sums is not None:
            np.add.at(sums, entry, np.column_stack([parts.stop[nodes] - parts.start[nodes], parts.sums[nodes]]))
        if want_codes:
            for node, e in zip(nodes.tolist(), entry.tolist(), strict=True):
                code[parts.start[node] : parts.stop[node]] = e
    for leaves, places in open_pairs:
        heads = np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])) if len(leaves) else []
        for a, b in zip(heads, np.append(heads, len(leaves))[1:], strict=False):
            start, stop = parts.start[leaves[a]], parts.stop[leaves[a]]
            entry = np.sort(book.entry[places[a:b]])
            some, points = book.entries[entry], parts.points[start:stop]
            # the square of the point itself is the same for all entries; the first of equals is the lowest
            best = entry[np.argmin((some * some).sum(axis=1)[None, :] - 2 * (points @ some.T), axis=1)]
            if sums is not None:
                np.add.at(sums, best, np.column_stack([np.ones(len(points), "i8"), points]))
            if want_codes:
                code[start:stop] = best
    if not want_codes:
        return None
    off = parts.points - book.entries[code]
    codes, errors = np.zeros(len(code), "i8"), np.zeros(len(code), "i8")
    codes[parts.order], errors[parts.order] = code, (off * off).sum(axis=1)
    return codes, errors


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(``id``, ``label``, ``v``) with integer components, of vectors that are not null and hold no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & finite)
    whole = F.transform("v", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-16.0 * LARGEST), F.least(F.lit(16.0 * LARGEST), x)) * SCALE))).cast("int"))
    return rows.withColumn("v", whole)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row for a block: ids, labels and a tree for each part. Rows stay where they were read."""
    size = max(1, BLOCK_COMPONENTS // max(1, PARTS * width))
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, data = [], [], []

        def block() -> pd.DataFrame:
            v = np.array(data, "i8").reshape(len(data), PARTS, width)
            return pd.DataFrame({"ids": [list(ids)], "labels": [list(labels)], "trees": [[Tree.of(v[:, k], LEAF_ROWS).packed() for k in range(PARTS)]]})

        for batch in batches:
            for i, x, v in zip(batch["id"].astype(object), batch["label"].astype(object), batch["v"], strict=True):
                ids.append(None if pd.isna(i) else i)
                labels.append(None if pd.isna(x) else x)
                data.append(v)
                if len(ids) >= size:
                    yield block()
                    ids, labels, data = [], [], []
        if ids:
            yield block()

    tree = "struct<" + ", ".join(f"{name}: binary" for name, _, _ in Tree._shapes) + ">"
    return rows.mapInPandas(run, f"ids array<long>, labels array<{label}>, trees array<{tree}>")


def _round(blocks: DataFrame, books: list[Codebook], width: int) -> list[np.ndarray]:
    """The codebooks after one round: an entry becomes the floor of its parts' mean, one without parts stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((len(b.entries), 1 + width), "i8") for b in books]
        for batch in batches:
            for trees in batch["trees"]:
                for k, data in enumerate(trees):
                    assigned(Tree.unpacked(data, width), books[k], sums[k])
        for k, some in enumerate(sums):
            used = np.flatnonzero(some[:, 0])
            if len(used):
                yield pd.DataFrame({"part": np.full(len(used), k, "i4"), "entry": used.astype("i4"), "sums": list(some[used])})

    sent = blocks.select("trees").mapInPandas(run, "part int, entry int, sums array<long>")
    summed = sent.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
    new = [b.entries.copy() for b in books]
    totals = [np.zeros((len(b.entries), 1 + width), "i8") for b in books]
    for r in summed.collect():  # as many numbers as the codebooks hold
        totals[r["part"]][r["entry"], r["at"]] = r["x"]
    for entries, total in zip(new, totals, strict=True):
        used = total[:, 0] > 0
        entries[used] = total[used, 1:] // total[used, :1]
    return new


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256`` of every row kept.

    Components become floor(1024 x). A codebook starts as the parts of the rows with the smallest
    ids (fewer rows: fewer entries; of equal ids the smaller vector first; null ids last). Ties go
    to the lower index. Vectors that are null or hold null or non-finite components take no part,
    nor do those of another length than that of the first row of the codebooks, or any if that is
    no multiple of four; empty vectors have empty parts and error 0. Components beyond 2^14 count as
    2^14. Repeated rows come back as often as they came, rows without an id too; null labels are one
    label. An empty table gives none; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: from 1 to 256 entries")
    text_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col, label_col)
    start = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]  # the first codebooks
    size = len(start[0]) if start and len(start[0]) % PARTS == 0 else -1
    rows, width = rows.filter(F.size("v") == size), max(0, size) // PARTS
    if any(len(v) != size for v in start):  # other lengths among them
        start = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    first = np.array(start, "i8").reshape(len(start), PARTS, width)
    blocks = stored(_blocks(rows, width), "blocks")
    books = [Codebook(first[:, k].copy()) for k in range(PARTS)] if len(start) else []
    for _ in range(rounds if books else 0):
        books = [Codebook(e) for e in _round(blocks, books, width)]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, labels, trees in zip(batch["ids"], batch["labels"], batch["trees"], strict=True):
                found = [assigned(Tree.unpacked(data, width), books[k], want_codes=True) for k, data in enumerate(trees)]
                codes = [bytes(c).hex() for c in np.column_stack([c for c, _ in found]).astype("u1")]
                yield pd.DataFrame({"vec_id": pd.Series(ids, dtype=object), "label": pd.Series(labels, dtype=object), "code": codes, "error": sum(e for _, e in found)})

    coded = stored(blocks.mapInPandas(run, f"vec_id long, label {label}, code string, error long"), "coded")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
