"""Near duplicates by SimHash under the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits. If two of them differ in at
most D bits, then for any thresholds t_1..t_m with sum D - m + 1 they differ in at most t_i bits
within some partition i (a partition may be skipped with t_i = -1). A dynamic program gives each
partition its threshold by estimated work. A fingerprint is filed under its bits in each
partition and under all values within the threshold; those that share a file are compared in full.
Only distinct fingerprints are filed, and a file yields a star for each of its linked sets, so
copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_batches

BITS = 64
SEED = 42
#: Distinct fingerprints sampled to plan the partitions. The plan decides the work, never what counts as linked.
PLAN_SAMPLE = 4096
#: A file with more fingerprints is cut into several, without losing a pair.
LARGE_FILE = 20_000
#: Work of filing a row against that of comparing a pair.
FILING_COST = 400.0


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from the same hashes (the finaliser of splitmix64); word 0 is the hash itself."""
    if not word:
        return hashes
    z = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, width: int = 1) -> list[int]:
    """SimHash of the word shingles, repeats included, as ``width`` signed 64-bit integers.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Fewer words than a
    shingle has make one shingle; no words make fingerprint 0.
    """
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return [0] * width
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[:-1] + 1).tolist()
    count, digest = max(len(found) - words, 0) + 1, xxhash.xxh64_intdigest
    stops = ends[words - 1 :].tolist() if len(found) > words else [len(joined)]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "<u8", count)
    ones = np.zeros((width, BITS), "int64")
    for at in range(0, count, 1 << 15):
        for k in range(width):
            ones[k] += np.unpackbits(_mixed(hashes[at : at + (1 << 15)], k).view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view("<i8").ravel().tolist()


def _words(width: int) -> list[str]:
    return [f"w{k}" for k in range(width)]


def fingerprints(docs: DataFrame, words: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the words of the fingerprint, and ``node``: the fingerprint itself, or a hash of a wider one."""
    text_batches(docs.sparkSession)
    names = _words(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, words, width) for t in batch["text"]], "int64").reshape(-1, width)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")} | {n: found[:, k] for k, n in enumerate(names)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = rows.mapInPandas(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))
    return fps.withColumn("node", F.col("w0") if width == 1 else F.xxhash64(*names))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view("u1").reshape(len(fps), -1), axis=1, bitorder="little")


def _mask(bits: list[int], width: int) -> np.ndarray:
    out = np.zeros(width, "u8")
    for b in bits:
        out[b // BITS] |= np.uint64(1 << b % BITS)
    return out


def partition_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into m partitions, each grown from a bit by what correlates with it most."""
    bits = _bits(sample).astype("f8")
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    tied = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(tied, 0)
    free, parts = np.ones(bits.shape[1], bool), []
    for k in range(m):
        size = int(free.sum()) // (m - k)
        part = [int(np.argmax(np.where(free, tied[:, free].sum(axis=1), -1)))]
        free[part[0]] = False
        pull = tied[:, part[0]].copy()
        while len(part) < size:
            part.append(int(np.argmax(np.where(free, pull, -1))))
            free[part[-1]] = False
            pull += tied[:, part[-1]]
        parts.append(sorted(part))
    return parts


def thresholds(parts: list[list[int]], apart: np.ndarray, rows: int, budget: int, most: int) -> tuple[float, list[int]]:
    """The threshold of each partition, -1 to skip it, so that those plus one sum to ``budget``, with the least estimated work."""
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        within = np.bincount(apart[:, part].sum(axis=1), minlength=most + 1)[: most + 1].cumsum() / len(apart)
        cost = {-1: 0.0}
        for t in range(most + 1):
            values = sum(comb(len(part), j) for j in range(t + 1))
            cost[t] = FILING_COST * rows * values + rows * rows / 2 * max(within[t], values / 2.0 ** len(part))
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (total, chosen) in table.items():
            for t, c in cost.items():
                if s + t + 1 <= budget and (s + t + 1 not in step or total + c < step[s + t + 1][0]):
                    step[s + t + 1] = (total + c, [*chosen, t])
        table = step
    return table[budget]


def plan(sample: np.ndarray, rows: int, distance: int, partitions: int | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use.

    Without ``partitions`` their number is chosen too, and thresholds meet the generalised
    pigeonhole condition for ``distance``: no pair within it is missed. With ``partitions`` the
    thresholds plus one sum to that number.
    """
    sample = np.unique(sample, axis=0)
    order = np.random.default_rng(7).permutation(len(sample))
    pairs = [sample[order] ^ sample[np.roll(order, k)] for k in range(1, min(12, len(sample)))]
    apart = _bits(np.concatenate(pairs) if pairs else np.zeros((1, sample.shape[1]), "u8"))
    tried = []
    for m in [partitions] if partitions else range(2, distance + 2):
        parts = partition_bits(sample, m)
        total, chosen = thresholds(parts, apart, rows, partitions or distance + 1, 1 if partitions else distance)
        tried.append((total, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(tried, key=lambda x: x[0])[1]


def _value(masked: np.ndarray) -> np.ndarray:
    """One 64-bit value of masked words; with several words they are mixed, and pairs are compared in full anyway."""
    if masked.shape[-1] == 1:
        return masked[..., 0]
    out = np.zeros(masked.shape[:-1], "u8")
    for k in range(masked.shape[-1]):
        out = _mixed(out ^ masked[..., k], 1 + k)
    return out


def _filed(nodes: DataFrame, parts: list[tuple[list[int], int]], names: list[str]) -> DataFrame:
    """(part, value, words): each fingerprint under its own value and all values within the threshold."""
    width = len(names)
    masks = [_mask(bits, width) for bits, _ in parts]
    flips = [np.array([_mask(list(some), width) for j in range(t + 1) for some in combinations(bits, j)], "u8") for bits, t in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch[names].to_numpy("int64").view("u8")
            for k, mask in enumerate(masks):
                for some in np.array_split(flips[k], max(1, len(flips[k]) // 32)):
                    values = _value((fps & mask)[:, None, :] ^ some[None, :, :]).ravel()
                    filed = np.repeat(fps.view("int64"), len(some), axis=0)
                    yield pd.DataFrame({"part": np.full(len(values), k, "int32"), "value": values.view("int64")} | {n: filed[:, j] for j, n in enumerate(names)})

    return nodes.select(*names).mapInPandas(run, ", ".join(["part int", "value long", *(f"{n} long" for n in names)]))


def linked_sets(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Indexes of each set of two or more fingerprints that hangs together at that distance."""
    left, out = np.arange(len(fps)), []
    if len(fps) <= 600:
        near = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype("i2") for k in range(fps.shape[1])) <= distance
        left = np.flatnonzero(near.sum(axis=1) > 1)
    while len(left):
        found, left = [left[:1]], left[1:]
        front = found[0]
        while len(front) and len(left):
            step = []
            for f in front:
                hit = np.bitwise_count(fps[left] ^ fps[f]).sum(axis=1, dtype="i4") <= distance
                if hit.any():
                    step.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(step) if step else left[:0]
            found.append(front)
        members = np.concatenate(found)
        if len(members) > 1:
            out.append(members)
    return out


def _stars(filed: DataFrame, keys: list[str], names: list[str], distance: int) -> DataFrame:
    """Links found within files; each set of a file is a star around its smallest fingerprint."""
    points = [f"a{k}" for k in range(len(names))] + [f"b{k}" for k in range(len(names))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, open_fps = None, []

        def close(out: list[np.ndarray]) -> None:
            if sum(map(len, open_fps)) > 1:
                fps = np.unique(np.concatenate(open_fps), axis=0)
                for members in linked_sets(fps.view("u8"), distance) if len(fps) > 1 else ():
                    root, rest = members.min(), members[members != members.min()]
                    out.append(np.hstack([np.repeat(fps[root : root + 1], len(rest), axis=0), fps[rest]]))

        def frame(out: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=points)

        for batch in batches:
            if not len(batch):
                continue
            out: list[np.ndarray] = []
            fps = batch[names].to_numpy("int64")
            key = batch[keys].to_numpy("int64")
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = tuple(key[a].tolist())
                if here != open_key:
                    close(out)
                    open_key, open_fps = here, []
                open_fps.append(fps[a:b])
            if out:
                yield frame(out)
        out = []
        close(out)
        if out:
            yield frame(out)

    sets = filed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, ", ".join(f"{p} long" for p in points))
    side = lambda s: F.col(f"{s}0") if len(names) == 1 else F.xxhash64(*[f"{s}{k}" for k in range(len(names))])
    return sets.select(side("a").alias("a"), side("b").alias("b")).distinct()


def _cut(filed: DataFrame, parts: list[tuple[list[int], int]], names: list[str], distance: int) -> DataFrame:
    """Large files cut into several, so that each pair within the distance still meets in one.

    For one-word fingerprints the bits outside the partition are cut into distance + 1 pieces, of
    which a pair has one in common. Wider ones are dealt into blocks, and each two blocks make a file.
    """
    sizes = filed.groupBy("part", "value").count().filter(F.col("count") > LARGE_FILE)
    sized = filed.join(sizes.withColumnRenamed("count", "_size"), ["part", "value"], "left")
    if len(names) == 1:
        pieces = []
        for bits, _ in parts:
            outside = sorted(set(range(BITS)) - set(bits))
            pieces.append([int(_mask(outside[j :: distance + 1], 1).view("i8")[0]) for j in range(distance + 1)])
        masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in p]) for p in pieces])
        chosen = F.when(F.col("_size").isNotNull(), F.element_at(masks, F.col("part") + 1)).otherwise(F.array(F.lit(0).cast("long")))
        return sized.select("part", "value", *names, F.posexplode(chosen).alias("piece", "_mask")).withColumn("inner", F.col("w0").bitwiseAND(F.col("_mask")))
    blocks = F.ceil(F.coalesce("_size", F.lit(1)) / (LARGE_FILE / 2)).cast("long")
    own = F.pmod(F.xxhash64(*names), F.col("_blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, own).alias("piece"), F.greatest(k, own).alias("inner")))
    return sized.withColumn("_blocks", blocks).select("part", "value", *names, F.explode(met).alias("_met")).select("part", "value", *names, "_met.piece", "_met.inner")


def links(nodes: DataFrame, width: int = 1, distance: int = 4, partitions: int | None = None) -> DataFrame:
    """Stars (``a``, ``b``) whose components are those of the pairs within the distance (see ``plan``)."""
    rows, names, spark = nodes.count(), _words(width), nodes.sparkSession
    share = min(1.0, 2.0 * PLAN_SAMPLE / max(rows, 1))
    some = nodes.filter(F.pmod(F.hash("node"), F.lit(1_000_000)) < share * 1_000_000).select(*names).limit(PLAN_SAMPLE).collect()
    sample = np.array([list(r) for r in some] or [[0] * width], "int64").view("u8")
    parts = plan(sample, rows, distance, partitions)
    text_batches(spark)
    filed = stored(_filed(nodes, parts, names), "filed")
    return _stars(_cut(filed, parts, names, distance), ["part", "value", "piece", "inner"], names, distance)


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node on an edge; root is the smallest node it hangs together with.

    Each round gives a node the least root among its own and its neighbours', hands it on to its
    root, and shortens the way to it; rounds end when nothing changes. Every round is a table in
    the shared folder.
    """
    edges = stored(edges, "edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near")).select("node", F.least("node", "_near").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        stepped = roots.join(near, "node").select("node", "root", F.least("root", "_near").alias("_least"))
        # what a member has found also goes to its old root
        told = stepped.groupBy(F.col("root").alias("node")).agg(F.min("_least").alias("_told"))
        # as a table: both sides of the next join are then plain shuffles, and one root's many nodes are split
        hooked = stored(stepped.join(told, "node", "left").select("node", F.col("root").alias("_old"), F.least("_least", F.coalesce("_told", "_least")).alias("root")), "hooked")
        way = hooked.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        new = stored(hooked.join(way, "root", "left").select("node", "_old", F.least("root", F.coalesce("_next", "root")).alias("root")), "roots")
        changed = new.filter(F.col("_old") != F.col("root")).limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots


def _resolved(fps: DataFrame, **how) -> DataFrame:
    """``doc_id``, the fingerprint's columns and ``component_id`` of every row of stored fingerprints."""
    names = [c for c in fps.columns if c not in ("doc_id", "node")]
    nodes = stored(fps.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(n).alias(n) for n in names]), "nodes")
    roots = components(links(nodes, len(names), **how)).withColumnRenamed("node", "_node")
    named = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "root").select("node", "component_id"), "node")


def simhash_components(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Every pair of 64-bit fingerprints within ``distance`` is linked, none is missed. One row comes
    back for each input row. Null text counts as empty; documents without words have fingerprint
    0 and are linked like any others. Null ids belong to components but name one only where all
    its ids are null. Repeated rows come back as often as they came; an empty table gives none;
    other columns are ignored.
    """
    fps = stored(fingerprints(docs, words, 1, id_col, text_col), "fingerprints")
    return _resolved(fps, distance=distance).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: Least Jaccard similarity of near copies: 4 parts of 5.
SHARED_PARTS, PARTS = 4, 5
#: Documents whose shingles are counted so that frequent ones come last in the order of prefixes, how often
#: one must occur there, and how many the driver takes. The order decides the work, never what is linked.
ORDER_SAMPLE, LEAST_OFTEN, MOST_FREQUENT = 20_000, 3, 100_000
#: How many sets that stand after it in its file each meets, before all that are left are compared.
NEIGHBOURS = 8
#: Members of a file that are ordered together for this; a larger file is dealt into several.
ORDERED = 20_000
#: Sets of a block; a file with more is compared block by block.
BLOCK_SETS = 1024
#: Bits of a shingle's hash that name its file. A file of several shingles brings more candidates, never fewer.
FILE_BITS = np.uint64((1 << 48) - 1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text, with words as in ``fingerprint``; none without words."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, "u8")
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts, stops = np.append(0, ends[:-1] + 1).tolist(), ends[words - 1 :].tolist() if len(found) > words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "u8"))


def _named(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], "u8").view("i8")[0])


def prefix(shingles: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: one that is similar enough shares one of them at least."""
    if not len(shingles):
        return shingles
    n = np.zeros(len(shingles), "i8")
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        n = np.where(frequent[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, n))][: len(shingles) + (-SHARED_PARTS * len(shingles) // PARTS) + 1]


def _frequent(texts: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent in a sample of texts, and how often they are there."""
    some = texts.filter(F.pmod(F.xxhash64("text", F.lit("order")), F.lit(1_000_000)) < min(1.0, ORDER_SAMPLE / max(rows, 1)) * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"shingle": np.concatenate([shingle_set(t, words) for t in batch["text"]] or [np.zeros(0, "u8")]).view("i8")})

    counted = some.select("text").mapInPandas(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_OFTEN)
    found = counted.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas()
    shingles, n = found["shingle"].to_numpy("int64").view("u8"), found["n"].to_numpy("int64")
    order = np.argsort(shingles)
    return shingles[order], n[order]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each bit, in bytes: two sets' sketches differ in at most as many bits as the sets differ in shingles.

    There are two to four bits a shingle. A wider sketch folds into a narrower one by the parities of its halves.
    """
    bits = 1 << max(6, min(16, int(len(shingles) - 1).bit_length() + 1))
    hits = np.bincount((shingles & np.uint64(bits - 1)).astype("i8"), minlength=bits)
    return np.packbits((hits & 1).astype("u1"), bitorder="little")


def folded(some: np.ndarray, width: int) -> np.ndarray:
    """Sketches of one width (rows) as narrower ones."""
    while some.shape[-1] > width:
        half = some.shape[-1] // 2
        some = some[..., :half] ^ some[..., half:]
    return some


def open_pairs(n: np.ndarray, at: np.ndarray, head: np.ndarray, side: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of all sets of a file that may be similar enough and do not hang together yet.

    ``at`` is the place of the file's shingle in each set of ``n``; sets of one ``side`` are not
    paired if there are two. Sets that differ in more than a ninth of both sizes are below 0.8.
    """
    widths = np.array([len(x) for x in sketches])
    own = {w: np.frombuffer(b"".join(x for x in sketches if len(x) == w), "u1").reshape(-1, w) for w in np.unique(widths).tolist()}
    # sets that are similar enough are within a quarter in size, and so at most one fold apart
    held = {w: (np.flatnonzero((widths == w) | (widths == 2 * w)), np.zeros(len(n), "i8"), np.empty((((widths == w) | (widths == 2 * w)).sum(), w), "u1")) for w in own}
    for w, (who, place, rows) in held.items():
        place[who] = np.arange(len(who))
        rows[widths[who] == w] = own[w]
        if 2 * w in own:
            rows[widths[who] == 2 * w] = folded(own[2 * w], w)
    views = {w: (place, rows.view("<u8")) for w, (_, place, rows) in held.items()}
    heads, sizes = np.unique(head, return_counts=True)
    main, two, out = heads[np.argmax(sizes)], side.min() != side.max(), []
    later = np.arange(len(n))
    for i in np.flatnonzero(head != main):  # of two heads one is not the largest
        j = np.flatnonzero((head != head[i]) & ((head == main) | (later > i)))
        if two:
            j = j[side[j] != side[i]]
        least, rest = np.minimum(n[i], n[j]), np.minimum(n[i] - at[i], n[j] - at[j])
        j = j[(PARTS * least >= SHARED_PARTS * np.maximum(n[i], n[j])) & ((PARTS + SHARED_PARTS) * rest >= SHARED_PARTS * (n[i] + n[j]))]
        for w in np.unique(np.minimum(widths[j], widths[i])).tolist():
            place, bits = views[w]
            these = j[np.minimum(widths[j], widths[i]) == w]
            off = np.bitwise_count(bits[place[these]] ^ bits[place[i]]).sum(axis=1, dtype="i8")
            near = (PARTS + SHARED_PARTS) * off <= (PARTS - SHARED_PARTS) * (n[i] + n[these])
            out.append((np.full(near.sum(), i), these[near], off[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, "i8"),) * 3


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) whose sketches do not rule out that they are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = []
            for x, y, n in zip(batch["x"], batch["y"], (batch["n"] + batch["m"]).tolist(), strict=True):
                x, y = np.frombuffer(x, "u1"), np.frombuffer(y, "u1")
                off = int(np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum())
                near.append((PARTS + SHARED_PARTS) * off <= (PARTS - SHARED_PARTS) * n)
            yield batch.loc[np.array(near, bool), ["a", "b"]]

    x, y = (sketches.select(F.col("node").alias(end), F.col("n").alias(size), F.col("sketch").alias(side)) for end, size, side in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInPandas(run, "a long, b long")


def _similar_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``) of sets whose Jaccard similarity, counted in full on 64 bits of each shingle's hash, is enough."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch["text"]]
            right = np.array([_named(x) for x in found], "int64") == batch["name"].to_numpy("int64")  # ids may repeat
            yield pd.DataFrame({"node": batch["node"], "shingles": [x.tobytes() for x in found]})[right]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(PARTS * shared >= SHARED_PARTS * (len(x) + len(y) - shared))
            yield batch.loc[np.array(near, bool), ["a", "b"]]

    # as a table, whose size Spark knows: a short list is sent to the texts, for a long one these are shuffled
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "name", "least"), "node"), "wanted")
    sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "name", "text").mapInPandas(made, "node long, shingles binary")
    sets = stored(sets, "sets")
    x, y = (sets.select(F.col("node").alias(end), F.col("shingles").alias(side)) for end, side in (("a", "x"), ("b", "y")))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long").distinct(), "similar")


def _open(left: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """(``a``, ``b``, ``cut``) of the pairs that are left to compare, of each two heads in a block the ``most`` closest; ``cut`` tells that there are more."""
    sized = left.join(left.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")), "shingle")
    blocks = F.ceil(F.col("size") / BLOCK_SETS).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("p"), F.greatest(k, own).alias("q")))
    dealt = sized.withColumn("blocks", blocks).select("shingle", "node", "place", "head", own.alias("side"), F.explode(met).alias("met")).select("shingle", "node", "place", "head", "side", "met.p", "met.q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts = None, []

        def compared() -> Iterator[pd.DataFrame]:
            rows = pd.concat(parts, ignore_index=True)
            node, head, place = (rows[c].to_numpy("int64") for c in ("node", "head", "place"))
            if head.min() == head.max():
                return
            i, j, off = open_pairs(place >> 32, place & 0xFFFFFFFF, head, rows["side"].to_numpy("int64"), rows["sketch"].tolist())
            if len(i):
                low, high = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
                order = np.lexsort((np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), off, high, low))
                low, high = low[order], high[order]
                start = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
                rank = np.arange(len(low)) - np.repeat(start, np.diff(np.append(start, len(low))))
                a, b = node[i][order], node[j][order]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cut": rank == most})[rank <= most]

        for batch in batches:
            keys = batch[["shingle", "p", "q"]].to_numpy("int64")
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if key != (here := tuple(keys[x].tolist())):
                    if parts:
                        yield from compared()
                    key, parts = here, []
                parts.append(batch.iloc[x:y])
        if parts:
            yield from compared()

    unit = ["shingle", "p", "q"]
    return dealt.join(sketches.select("node", "sketch"), "node").repartition(*unit).sortWithinPartitions(*unit, "node").mapInPandas(run, "a long, b long, cut boolean")


def near_copies(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``component_id`` of every row, linking texts whose shingle sets have a Jaccard similarity of 0.8 or more.

    Components are those of all such pairs, but for shingles that share a 64-bit hash: no pair less
    similar is linked, as every candidate is compared in full, and none is missed. Candidates come
    from files of a prefix join: with all shingles in one order, two sets that similar share one of
    their first n - ceil(0.8 n) + 1, and at the first they share the rest of both must still be long
    enough. Pairing all sets of a file at once would grow with the square of a group of copies. So
    first each meets the one nearest to the middle of its group and the NEIGHBOURS after it in an
    order by chance, which is every pair of a small file, and fingerprints within 4 bits meet too.
    What hangs together then is not compared again. All other pairs of every larger file are held
    against each other by sketches that bound their difference, in blocks, and what these leave is
    compared: first the closest of each two components, then ever more until no pair is left.
    Documents without words, null texts among them, are linked with each other only. Repeated rows
    come back as often as they came, rows without an id too; an empty table gives none; other
    columns are ignored.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, docs.count(), words))  # MOST_FREQUENT pairs of numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch["text"]]
            bits = [np.unpackbits(x.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64") for x in found]
            prints = [np.packbits(2 * b > len(x), bitorder="little").view("<i8")[0] for b, x in zip(bits, found, strict=True)]
            firsts = [(prefix(x, *frequent.value) & FILE_BITS).view("i8") for x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "name": np.array([_named(x) for x in found], "int64"), "w0": np.array(prints, "int64"), "n": np.array([len(x) for x in found], "int64"), "firsts": firsts, "sketch": [sketch(x).tobytes() for x in found]})

    rows = stored(texts.mapInPandas(run, "doc_id long, name long, w0 long, n long, firsts array<long>, sketch binary").withColumn("row", F.monotonically_increasing_id()), "shingles")
    # a set goes by the row that has it first: small numbers, which compress well
    nodes = stored(rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.min("row").alias("node"), F.min("w0").alias("w0")), "nodes")
    again = rows.select("name", "row").join(nodes.select("name", "node"), "name").filter(F.col("row") != F.col("node")).select("row")
    filed = rows.select("row", "n", "firsts").join(again, "row", "left_anti").select(F.col("row").alias("node"), "n", F.posexplode("firsts").alias("at", "shingle"))
    sketches = rows.select(F.col("row").alias("node"), "n", "sketch")

    # (node, size of the set and place of the shingle in it): the two fit into one number
    file = Window.partitionBy("shingle")
    filed = filed.select("shingle", "node", (F.shiftleft("n", 32) + F.col("at")).alias("place"))
    filed = filed.withColumns({"_low": F.min("node").over(file), "_high": F.max("node").over(file), "_size": F.count(F.lit(1)).over(file)}).filter("_low < _high")
    filed = stored(filed.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("_size") / ORDERED))).drop("_low", "_high").withColumnRenamed("_size", "size"), "filed")
    # a set with more of its first shingles in files with others is nearer to the middle of its group
    shared = filed.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))

    def meet(x: Column, y: Column) -> Column:
        """Whether two sets that share a shingle at these places for the first time can be similar enough."""
        n, m, at = F.shiftright(x, 32), F.shiftright(y, 32), F.lit((1 << 32) - 1)
        rest = F.least(n - x.bitwiseAND(at), m - y.bitwiseAND(at))
        return (PARTS * F.least(n, m) >= SHARED_PARTS * F.greatest(n, m)) & ((PARTS + SHARED_PARTS) * rest >= SHARED_PARTS * (n + m))

    prints = nodes.select(F.col("w0").alias("node"), "w0").distinct()
    print_roots = components(links(stored(prints, "prints"))).withColumnRenamed("node", "w0")
    rooted = nodes.join(print_roots, "w0", "left").select("node", F.coalesce("root", "w0").alias("_root"))
    close = rooted.join(rooted.groupBy("_root").agg(F.min("node").alias("a")), "_root").select("a", F.col("node").alias("b")).filter("a < b")

    own = F.struct("node", "place")
    dealt = Window.partitionBy("shingle", "part")
    by_chance = F.xxhash64("node", F.lit("order"))
    met = filed.join(shared, "node").withColumns({"_middle": F.max(F.struct("shared", by_chance, own.alias("own"))).over(dealt)["own"], "_after": F.collect_list(own).over(dealt.orderBy(by_chance, "node").rowsBetween(1, NEIGHBOURS))})
    others = F.filter(F.concat(F.array("_middle"), "_after"), lambda x: (x["node"] != F.col("node")) & meet(F.col("place"), x["place"]))
    pairs = met.select("node", F.explode(others).alias("_with")).select(F.least("node", "_with.node").alias("a"), F.greatest("node", "_with.node").alias("b"))
    tried = stored(pairs.union(close).distinct(), "tried")

    large = filed.filter(F.col("size") > NEIGHBOURS + 1).select("shingle", "node", "place")  # in others all pairs have met
    near, most = _similar_pairs(stored(_possible(tried, sketches), "possible"), nodes, texts, words), NEIGHBOURS
    while True:  # until no pair of sets that do not hang together is left that the sketches admit
        heads = components(near).withColumnRenamed("root", "head")
        headed = large.join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
        left = headed.withColumns({"_low": F.min("head").over(file), "_high": F.max("head").over(file)}).filter("_low < _high").drop("_low", "_high")
        found = stored(_open(stored(left, "left"), sketches, most), "open")
        pairs = stored(found.filter("NOT cut").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        if pairs.limit(1).count():
            tried, near = tried.union(pairs), near.union(_similar_pairs(pairs, nodes, texts, words))
        if not found.filter("cut").limit(1).count():
            break
        most *= 16

    roots = components(near).withColumnRenamed("node", "_node")
    named = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("name", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "name").join(named.join(least, "root").select("name", "component_id"), "name").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component of near copies.

    Ids are expected to be unique, as they are after exact dedup: of one id with several texts all
    rows go as soon as one is to go. Rows with null ids stay.
    """
    found = near_copies(docs, words, id_col, text_col)
    dropped = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(dropped, id_col, "left_anti")
