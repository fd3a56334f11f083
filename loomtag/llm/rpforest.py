"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all of them, exact reranking.

A level of a tree has one random direction and its nodes their own cuts, medians of a
bounded sample; where the sample ends, leaves that are still large are cut into slabs
along one more direction at quantiles of their own rows. Every row is dealt to its
leaf in each tree. A query walks all trees at once: the branches it did not take wait
in one queue, ordered by their distance to the hyperplane, until it has opened the
number of leaves of the budget. A task then holds the rows of a leaf, which are
bounded, and lets the queries that opened it pass by. The budget is set by
calibration: for some queries the true neighbours are found by a full pass, and the
budget is the number of leaves that holds the wanted share of them.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.llm.shared import saved

#: Trees, wanted rows of a leaf.
TREES, LEAF_ROWS = 4, 2048
#: Bounds of what reaches the driver: rows that the cuts are fitted on, queries that calibrate the budget, slabs of a leaf.
SAMPLE, CALIBRATION, MOST_SLABS = 1 << 17, 128, 64
#: Share of true neighbours that the calibration asks for, least sample rows of a leaf.
RECALL, LEAST_SAMPLE = 0.96, 16


@dataclass(frozen=True)
class Forest:
    """directions (trees, depth + 1, d), cuts (trees, nodes) of complete trees, slabs (trees, leaves, slabs - 1); node i has children 2i+1 and 2i+2."""

    depth: int
    directions: np.ndarray
    cuts: np.ndarray
    slabs: np.ndarray

    @property
    def width(self) -> int:
        """Slabs of a leaf."""
        return self.slabs.shape[2] + 1


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5) -> Forest:
    """Each node cuts its part of the sample at the median along the direction of its level."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(trees, depth + 1, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            along, first = sample @ directions[t, level], (1 << level) - 1
            order = np.lexsort((along, node))
            ends = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            for i in range(1 << level):
                part = along[order[ends[i] : ends[i + 1]]]
                cuts[t, first + i] = (part[(len(part) - 1) // 2] + part[len(part) // 2]) / 2 if len(part) else 0.0
            node = 2 * node + 1 + (along > cuts[t][node])
    return Forest(depth, directions, cuts, np.zeros((trees, 1 << depth, 0)))


def _leaf_nodes(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trees, rows): the leaf before slabs, and the place along the slabs' direction."""
    out, along = np.zeros((len(forest.cuts), len(x)), np.int64), np.zeros((len(forest.cuts), len(x)))
    for t in range(len(forest.cuts)):
        projected = x @ forest.directions[t].T
        node = np.zeros(len(x), np.int64)
        for level in range(forest.depth):
            node = 2 * node + 1 + (projected[:, level] > forest.cuts[t][node])
        out[t], along[t] = node - ((1 << forest.depth) - 1), projected[:, -1]
    return out, along


def leaves(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(trees, rows): the leaf of each row in each tree."""
    leaf, along = _leaf_nodes(forest, x)
    for t in range(len(leaf)):
        leaf[t] = leaf[t] * forest.width + (forest.slabs[t][leaf[t]] < along[t][:, None]).sum(axis=1)
    return leaf


def visits(forest: Forest, query: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """The first `budget` (tree, leaf) that the query opens, in order, from one queue over all trees."""
    along = forest.directions @ query  # trees, levels
    inner, width = forest.cuts.shape[1], forest.width
    queue, out = [(0.0, t, 0) for t in range(len(along))], []
    while queue and len(out) < budget:
        bound, t, node = heapq.heappop(queue)
        if node < 0:
            out.append((t, -node - 1))
            continue
        while node < inner:
            margin = along[t, (node + 1).bit_length() - 1] - forest.cuts[t, node]
            near = 2 * node + 1 + int(margin > 0)
            heapq.heappush(queue, (max(bound, abs(float(margin))), t, 4 * node + 3 - near))
            node = near
        leaf = node - inner
        if width == 1:
            out.append((t, leaf))
            continue
        edges = np.concatenate([[-np.inf], forest.slabs[t, leaf], [np.inf]])
        away = np.maximum(np.maximum(edges[:-1] - along[t, -1], along[t, -1] - edges[1:]), 0.0)
        for k in range(width):
            heapq.heappush(queue, (max(bound, float(away[k])), t, -(leaf * width + k) - 1))
    return out


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def nearest(rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and exact Euclidean distances of its k nearest rows (more if the last ones tie)."""
    out = []
    squares = (rows**2).sum(axis=1)
    for start in range(0, len(queries), 256):
        block = queries[start : start + 256]
        rough = squares[None, :] - 2 * (block @ rows.T)
        for q, r in zip(block, rough, strict=True):
            if len(rows) > k:
                last = np.partition(r, k - 1)[k - 1]
                at = np.flatnonzero(r <= last + 1e-9 * (1 + abs(last) + float(q @ q)))
            else:
                at = np.arange(len(rows))
            out.append((at, np.sqrt(((rows[at] - q) ** 2).sum(axis=1))))
    return out


def _calibrated(forest: Forest, classes: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """The least budget whose leaves hold `recall` of the true neighbours of at most CALIBRATION queries."""
    drawn = sorted(queries.select("key", "vector").orderBy("key").limit(CALIBRATION).collect(), key=lambda r: r["key"])
    keys, points = [r["key"] for r in drawn], _matrix(r["vector"] for r in drawn)

    def run(frames):
        best: list[list[tuple[float, list[float]]]] = [[] for _ in keys]
        for pdf in frames:
            rows, names = _matrix(pdf["vector"]), pdf["key"].to_numpy()
            for i, (at, score) in enumerate(nearest(rows, points, k + 1)):
                best[i] = sorted(best[i] + [(float(s), rows[j].tolist()) for j, s in zip(at, score, strict=True) if names[j] != keys[i]], key=lambda x: x[0])[:k]
        if any(best):
            yield pd.DataFrame([(i, s, v) for i, found in enumerate(best) for s, v in found], columns=["q", "score", "vector"])

    order = Window.partitionBy("q").orderBy("score")
    true = classes.select("key", "vector").mapInPandas(run, "q int, score double, vector array<double>").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).collect()
    full = len(forest.cuts) * forest.width << forest.depth
    at = [{v: i for i, v in enumerate(visits(forest, p, full))} for p in points]
    needed = []
    for r in true:
        own = leaves(forest, np.asarray([r["vector"]], np.float64))[:, 0]
        needed.append(1 + min(at[r["q"]][t, int(leaf)] for t, leaf in enumerate(own)))
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def _with_slabs(forest: Forest, classes: DataFrame, width: int) -> Forest:
    """The forest with its leaves cut into width slabs, at quantiles of their rows along one more direction."""

    def run(frames):
        for pdf in frames:
            leaf, along = _leaf_nodes(forest, _matrix(pdf["vector"]))
            yield pd.concat([pd.DataFrame({"tree": t, "leaf": leaf[t], "along": along[t]}) for t in range(len(leaf))])

    shares = [k / width for k in range(1, width)]
    placed = classes.select("vector").mapInPandas(run, "tree int, leaf long, along double")
    found = placed.groupBy("tree", "leaf").agg(F.percentile_approx("along", shares, 1000).alias("q")).collect()  # at most trees x leaves x MOST_SLABS numbers
    slabs = np.zeros((len(forest.cuts), 1 << forest.depth, width - 1))
    for r in found:
        slabs[r["tree"], r["leaf"]] = r["q"]
    return replace(forest, slabs=slabs)


def _reranked(frames, k: int):
    """Of rows in order of (tree, leaf, block, side), for each query (side 1) its nearest among the leaf's rows (side 0), which come before it."""
    here, held, ids, matrix = None, [], [], None
    for pdf in frames:
        place = pdf[["tree", "leaf", "block", "side"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
        for start, end in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            part, at = pdf.iloc[start:end], tuple(place[start][:3])
            if at != here:
                here, held, ids, matrix = at, [], [], None
            if place[start][3] == 0:
                held.append(_matrix(part["vector"]))
                ids.extend(part["ids"])
            elif held:
                matrix = np.concatenate(held) if matrix is None else matrix
                for i in range(0, len(part), 256):
                    some = part.iloc[i : i + 256]
                    found = nearest(matrix, _matrix(some["vector"]), k)
                    yield pd.DataFrame([(q, s, ids[j]) for q, (near, score) in zip(some["key"], found, strict=True) for j, s in zip(near, score, strict=True)], columns=["key", "score", "ids"])


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows found for each row of queries (columns id_col, vector_col), without its own id.

    Nearest first by Euclidean distance in double precision, ties to the smaller id.
    Rows with a null id, and vectors that are null, empty, zero, hold null or
    non-finite components or differ in length from most, take no part on either
    side. Equal vectors are searched once: of each only the k + 1 least ids can
    matter, and only these are kept. Rows that repeat an id and a vector count once.
    Empty tables give no rows; columns besides the two named are ignored.

    A row is sent once for each tree, a query once for each leaf that it opens. The
    number of leaves grows with the rows, up to trees x SAMPLE / LEAST_SAMPLE x
    MOST_SLABS; beyond that the rows of a leaf are dealt into blocks.
    """
    narrow = rows.schema[vector_col].dataType.simpleString() == "array<float>" == queries.schema[vector_col].dataType.simpleString()
    kept = "array<float>" if narrow else "array<double>"

    def keyed(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col)
        text = F.array_join(F.transform(vector, lambda x: (x + 0.0).cast("string")), ",")
        return df.where(F.col(id_col).isNotNull() & _usable(vector)).select(F.col(id_col).cast("long").alias("id"), vector.cast(kept).alias("vector"), F.md5(text).alias("key"))

    usable = keyed(rows)
    widths = usable.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    nothing = usable.where("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    if widths is None:
        return nothing
    usable, asked = (x.where(F.size("vector") == widths["d"]) for x in (usable, keyed(queries)))
    least = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    classes = saved(usable.withColumn("r", least).where(F.col("r") <= k + 1).groupBy("key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    points = saved(asked.groupBy("key").agg(F.first("vector").alias("vector")), "queries")
    n, n_points = classes.count(), points.count()
    if not n_points:
        return nothing
    wanted = max(1, -(-n // leaf_rows))
    most = min(SAMPLE, max(4 * LEAST_SAMPLE * wanted, 1024))
    share = min(1.0, 1.2 * most / n)
    some = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000).select("key", "vector").orderBy("key").limit(most)
    sample = _matrix(some.toArrow().column("vector").to_pylist()) if n else np.zeros((1, widths["d"]))
    depth = max(0, min(math.ceil(math.log2(wanted)), int(math.log2(max(1, len(sample) / LEAST_SAMPLE)))))
    forest = fit(sample, depth, trees)
    slabs = min(MOST_SLABS, -(-n // (leaf_rows << depth)))
    if slabs > 1:
        forest = _with_slabs(forest, classes, slabs)
    budget = _calibrated(forest, classes, points, k, recall)
    blocks = max(1, n // (leaf_rows << depth) // slabs // 8)

    def deal(frames):
        for pdf in frames:
            own = leaves(forest, _matrix(pdf["vector"]))
            yield pd.concat([pdf.assign(tree=t, leaf=own[t]) for t in range(len(own))])

    def route(frames):
        for pdf in frames:
            found = [visits(forest, np.asarray(v, np.float64), budget) for v in pdf["vector"]]
            out = pdf.loc[pdf.index.repeat([len(f) for f in found])]
            yield out.assign(tree=[t for f in found for t, _ in f], leaf=[x for f in found for _, x in f])

    dealt = classes.mapInPandas(deal, f"key string, vector {kept}, ids array<long>, tree int, leaf long")
    dealt = dealt.select("tree", "leaf", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("key"), "vector", "ids")
    routed = points.mapInPandas(route, f"key string, vector {kept}, tree int, leaf long")
    routed = routed.select("tree", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("side"), "key", "vector", F.lit(None).cast("array<long>").alias("ids"))
    place = ["tree", "leaf", "block"]
    met = dealt.unionByName(routed).repartition(*place).sortWithinPartitions(*place, "side")
    ranked = met.mapInPandas(lambda frames: _reranked(frames, k + 1), "key string, score double, ids array<long>")
    pairs = F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("id")))
    # at most budget x (k + 1) entries a query
    best = ranked.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k + 1).alias("best"))
    met = asked.select(F.col("id").alias("query_id"), "key").distinct().join(best, "key")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = met.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))
