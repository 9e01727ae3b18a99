"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 and packed into tiles. A query tile meets a candidate tile in an int8
matrix product, which gives every cosine up to a bound on the quantisation error. Tiles are sent by
blocks, so that one travels once for each block of the others. Pairs whose upper bound reaches the
k-th best lower bound survive, first among the candidates of a query tile in a task, then among all
of a query's; only their ids are shuffled. Survivors are joined to their vectors, computed
again in double precision and merged by heaps, so no neighbour is missed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches

QUERY_TILE = 512
CANDIDATE_TILE = 2048
#: Tiles of a block: a query tile is sent once to each block of candidate tiles, and the other way round.
QUERY_BLOCK, CANDIDATE_BLOCK = 64, 32
#: Pairs that a task holds back until the bounds of their query tile are final for it.
HELD_PAIRS = 500_000
#: What rounding in single precision can add to a bound.
SLACK = 1e-5


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``id``, ``v`` in double precision) without null, zero, empty or non-finite vectors."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _tiles(rows: DataFrame, tile: int, count: int) -> DataFrame:
    """One row a tile: ``group``, ``dim``, ``ids`` and the quantised vectors ``q``, ``scale``, ``lost``.

    Rows are dealt by a hash of their id and stand in order of ids; a tile holds at most ``tile``
    rows, and of rows alike only one.
    """
    groups = max(1, -(-count // tile))
    dealt = rows.withColumn("dim", F.size("v")).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, data = None, [], []

        def packed() -> pd.DataFrame:
            v = np.array(data, "f8")
            v /= np.abs(v).max(axis=1)[:, None]
            q, scale, lost = quantised(v / np.linalg.norm(v, axis=1)[:, None])
            return pd.DataFrame({"group": [key[0]], "dim": [key[1]], "ids": [np.array(ids, "<i8").tobytes()], "q": [q.tobytes()], "scale": [scale.astype("<f8").tobytes()], "lost": [lost.astype("<f8").tobytes()]})

        for batch in batches:
            for group, dim, i, v in zip(batch["group"], batch["dim"], batch["id"], batch["v"], strict=True):
                if ids and (key != (group, dim) or len(ids) >= tile):
                    yield packed()
                    ids, data = [], []
                if ids and ids[-1] == i and np.array_equal(data[-1], v):
                    continue
                key = (group, dim)
                ids.append(i)
                data.append(v)
        if ids:
            yield packed()

    ordered = dealt.repartition("group").sortWithinPartitions("group", "dim", "id", "v").select("group", "dim", "id", "v")
    return ordered.mapInPandas(run, "group long, dim int, ids binary, q binary, scale binary, lost binary")


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, and the length of what rounding has taken from it."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype("i1")
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows in double precision; rows are scaled first so that squares stay finite."""
    a, b = a / np.abs(a).max(axis=1)[:, None], b / np.abs(b).max(axis=1)[:, None]
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1)) / np.sqrt((b * b).sum(axis=1))


def _best_bounds(lows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's lower bounds the k best of different ids, best first."""
    order = np.argsort(-lows, axis=1, kind="stable")
    lows, ids = np.take_along_axis(lows, order, 1), np.take_along_axis(ids, order, 1)
    before = np.tril(np.ones((lows.shape[1],) * 2, bool), -1)
    again = ((ids[:, :, None] == ids[:, None, :]) & before[None]).any(axis=2)
    order = np.argsort(-np.where(again, -np.inf, lows), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(np.where(again, -np.inf, lows), order, 1), np.take_along_axis(ids, order, 1)


def _block_bounds(low: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best lower bounds of each query among the candidates of a tile, ids in order and each counted once."""
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    low, ids = (low, ids) if len(first) == len(ids) else (np.maximum.reduceat(low, first, axis=1), ids[first])
    some = np.argpartition(-low, k - 1, axis=1)[:, :k] if low.shape[1] > k else np.tile(np.arange(low.shape[1]), (len(low), 1))
    return np.take_along_axis(low, some, 1), ids[some]


def _survivors(pairs: DataFrame, k: int) -> DataFrame:
    """(``query_id``, ``vec_id``, ``low``, ``high``): pairs that may be among a query's k nearest, tile by tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, qi, lows, ids, held = None, None, None, None, []  # the best bounds of one query tile's queries, and its pairs so far

        def pruned() -> pd.DataFrame | None:
            """What is left of the held pairs by the bounds now."""
            if not held:
                return None
            r, c, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            left = high >= lows[r, -1]
            return pd.DataFrame({"query_id": qi[r[left]], "vec_id": c[left], "low": low[left], "high": high[left]}) if left.any() else None

        for batch in batches:
            for row in batch.itertuples(index=False):
                if tile != row.q_ids:
                    if (done := pruned()) is not None:
                        yield done
                    tile, qi = row.q_ids, np.frombuffer(row.q_ids, "<i8")
                    lows, ids = np.full((len(qi), k), -np.inf), np.full((len(qi), k), np.iinfo("i8").min)
                ci = np.frombuffer(row.c_ids, "<i8")
                q8, c8 = (np.frombuffer(x, "i1").reshape(-1, row.dim) for x in (row.q_q, row.c_q))
                qs, qe, cs, ce = (np.frombuffer(x, "<f8") for x in (row.q_scale, row.q_lost, row.c_scale, row.c_lost))
                # sums of int8 products under 2^24 are exact in single precision, in which BLAS multiplies
                kind = "f4" if row.dim <= 1024 else "f8"
                near = (q8.astype(kind) @ c8.astype(kind).T) * (qs[:, None] * cs[None, :])
                off = qe[:, None] + (1 + qe[:, None]) * ce[None, :] + SLACK
                own = qi[:, None] == ci[None, :]
                low = np.where(own, -np.inf, near - off)
                more, more_ids = _block_bounds(low, ci, k)
                lows, ids = _best_bounds(np.hstack([lows, more]), np.hstack([ids, more_ids]), k)
                r, c = np.nonzero((near + off >= lows[:, -1][:, None]) & ~own)
                if len(r):
                    held.append((r, ci[c], low[r, c], (near + off)[r, c]))
                    if sum(len(x[0]) for x in held) > HELD_PAIRS and (some := pruned()) is not None:
                        yield some
        if (done := pruned()) is not None:
            yield done

    return pairs.mapInPandas(run, "query_id long, vec_id long, low double, high double")


def _closest(survivors: DataFrame, k: int) -> DataFrame:
    """(``query_id``, ``vec_id``): survivors whose upper bound reaches the k-th best lower bound of their query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, best, floor = None, set(), -np.inf
        for batch in batches:
            kept = []
            for q, v, low, high in zip(batch["query_id"].tolist(), batch["vec_id"].tolist(), batch["low"], batch["high"], strict=True):
                if q != query:
                    query, best, floor = q, set(), -np.inf
                if len(best) < k:
                    best.add(v)  # best lower bounds first: the k-th new id has the k-th best
                    floor = low if len(best) == k else -np.inf
                if high >= floor:
                    kept.append((q, v))
            if kept:
                yield pd.DataFrame(kept, columns=["query_id", "vec_id"])

    return survivors.repartition("query_id").sortWithinPartitions("query_id", F.desc("low"), "vec_id").mapInPandas(run, "query_id long, vec_id long").distinct()


def _scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with the cosine of their vectors in double precision."""
    q, v = (vectors.select(F.col("id").alias(i), F.col("v").alias(x)) for i, x in (("query_id", "q"), ("vec_id", "c")))
    met = pairs.join(v, "vec_id").join(q, "query_id").filter(F.size("q") == F.size("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = np.zeros(len(batch))
            sizes = batch["q"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                scores[at] = exact_cosine(np.stack(batch["q"].iloc[at].to_list()), np.stack(batch["c"].iloc[at].to_list()))
            yield pd.DataFrame({"query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": scores})

    return met.select("query_id", "vec_id", "q", "c").mapInPandas(run, "query_id long, vec_id long, score double")


def _merged(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from a heap of k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, heap = None, {}

        def done() -> pd.DataFrame:
            best = sorted(((s, -v) for v, s in heap.items()), reverse=True)
            return pd.DataFrame({"query_id": query, "rank": np.arange(1, len(best) + 1, dtype="int32"), "vec_id": [-v for _, v in best], "score": [s for s, _ in best]})

        for batch in batches:
            for q, v, s in zip(batch["query_id"].tolist(), batch["vec_id"].tolist(), batch["score"].tolist(), strict=True):
                if q != query:
                    if heap:
                        yield done()
                    query, heap = q, {}
                heap[v] = max(s, heap.get(v, s))  # an id stands once, with its best score
                if len(heap) > k:
                    del heap[heapq.nsmallest(1, heap, key=lambda i: (heap[i], -i))[0]]
        if heap:
            yield done()

    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(run, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of every query by cosine: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Candidates are all rows but those with the query's id; ties go to the smaller id. Vectors that
    are null, empty, all zero or hold null or non-finite components take no part, rows without an
    id neither; vectors of different lengths never meet. Rows alike count once; an id with several
    vectors stands once in a list, with its best score. Fewer than k candidates give fewer rows, an
    empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    rows = usable(vectors, id_col, vector_col).filter(F.col("id").isNotNull())
    asked = usable(vectors.filter(is_query), id_col, vector_col).filter(F.col("id").isNotNull())
    # of vectors alike, only k + 1 smallest ids can be near: the others come after k of them for any query
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    near_ones = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place")
    n, asked_n = vectors.count(), asked.count()
    parts = ("ids", "q", "scale", "lost")
    groups, asked_groups = max(1, -(-n // CANDIDATE_TILE)), max(1, -(-asked_n // QUERY_TILE))
    # the stated queries against all rows, in blocks; few tiles make as many blocks as there are partitions
    columns = -(-asked_groups // QUERY_BLOCK)
    blocks = max(-(-groups // CANDIDATE_BLOCK), min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = lambda name, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<long>")).alias(name)
    queries = _tiles(asked, QUERY_TILE, asked_n).select("dim", F.pmod("group", F.lit(columns)).alias("column"), every("block", blocks), *[F.col(c).alias(f"q_{c}") for c in parts])
    candidates = _tiles(near_ones, CANDIDATE_TILE, n).select("dim", F.pmod("group", F.lit(blocks)).alias("block"), every("column", columns), *[F.col(c).alias(f"c_{c}") for c in parts])
    pairs = queries.join(candidates, ["block", "column", "dim"]).sortWithinPartitions("q_ids").select("dim", *[f"{side}_{c}" for side in "qc" for c in parts])
    return _merged(_scores(_closest(_survivors(pairs, k), k), rows), k)
