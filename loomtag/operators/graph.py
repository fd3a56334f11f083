"""Ranking on the bipartite graph of items and tags: edge frames (item, tag, w), iterated by joins.

Per-query iterations run on the side of the tags, which are far fewer than items;
items enter with the query and come back in one last join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtag.operators.sequences import seeded_order
from loomtag.scratch import saved

Cut = Callable[[DataFrame], DataFrame]

#: Equal items, or queries, in one array; rows that a task makes of such arrays; the most tasks for them.
TOGETHER, TASK_ROWS, MOST_TASKS = 256, 1 << 25, 4096


def normalised(edges: DataFrame) -> DataFrame:
    """(item, tag, s): w over the roots of the degrees of both ends."""
    items = edges.groupBy("item").agg(F.sum("w").alias("di"))
    tags = edges.groupBy("tag").agg(F.sum("w").alias("dt"))
    # items grow, and their exploded tags look as small to the planner as the file that they come from
    return edges.join(items.hint("merge"), "item").join(tags, "tag").select("item", "tag", (F.col("w") / F.sqrt(F.col("di") * F.col("dt"))).alias("s"))


def tag_transitions(s: DataFrame) -> DataFrame:
    """(a, b, t): transpose(S) x S, tags by tags."""
    return s.select("item", F.col("tag").alias("a"), F.col("s").alias("sa")).join(s.select("item", F.col("tag").alias("b"), F.col("s").alias("sb")).hint("merge"), "item").groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("t"))


def with_own(moves: DataFrame) -> DataFrame:
    """moves (a, b, t) written with `own`, and a row (a, a, 0, true) for each node: what it keeps comes by the same join as what it sends."""
    own = moves.select("a").union(moves.select("b")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("t"), F.lit(True).alias("own"))
    return saved(moves.select("a", "b", "t", F.lit(False).alias("own")).unionByName(own), "moves")


def push(start: DataFrame, moves: DataFrame, factor: float, cut: Cut, bound: float = 1e-9, rounds: int = 300, check_every: int = 5) -> DataFrame:
    """(keys…, tag, v, left): the sum over m of (factor x A)^m on start (keys…, tag, v) by forward push.

    Every (keys, tag) has an estimate and a residual that is not yet spread. A round
    spreads the residuals above bound alone, so that a query holds the tags that it
    reaches with so much, not all tags of the graph, and late rounds touch few. At the end no
    residual is above bound (left, which v includes): v is within factor / (1 - factor)
    times the length of the vector of what is left.
    """
    keys, big, stays = [c for c in start.columns if c not in ("tag", "v")], F.abs("r") > bound, F.col("own")
    state = cut(start.groupBy(*keys, "tag").agg(F.lit(0.0).alias("p"), F.sum(F.col("v").cast("double")).alias("r")))
    ways = with_own(moves)
    for n in range(1, rounds + 1):
        met = state.join(ways, (F.col("tag") == F.col("a")) & (stays | big))
        p = F.sum(F.when(stays, F.col("p") + F.when(big, F.col("r")).otherwise(0.0)).otherwise(0.0))
        r = F.sum(F.when(stays, F.when(big, 0.0).otherwise(F.col("r"))).otherwise(F.col("r") * F.col("t") * factor))
        state = met.groupBy(*keys, F.col("b").alias("tag")).agg(p.alias("p"), r.alias("r"))
        if n % check_every == 0 or n == rounds:
            state = cut(state)
            if state.where(big).isEmpty():
                break
    return state.select(*keys, "tag", (F.col("p") + F.col("r")).alias("v"), F.abs("r").alias("left"))


def resolvents(start: DataFrame, moves: DataFrame, factors: list[float], cut: Cut, tol: float = 1e-13, cut_every: int = 8) -> DataFrame:
    """(keys…, tag, c, v): for each factor c below 1 the sum over m of (c A)^m on start (keys…, tag, v), from one sequence of vectors.

    A is symmetric with eigenvalues from 0 to 1. The sequence is that of the Chebyshev
    polynomials of 2A - 1 on start, which does not depend on c; a factor only has weights
    of its own for its terms, 2 rho^m / sqrt(1 - c) with rho from c alone. The weights fall
    much faster than c^m (0.39^m for c = 0.81), and the terms are no longer than start,
    so the number of rounds follows from tol before the first. A round is one join
    and has a row for each (keys, tag), whatever the number of factors.
    """
    factors, keys = sorted(set(factors)), [c for c in start.columns if c not in ("tag", "v")]
    roots = {c: math.sqrt(1 - c) for c in factors}
    rho = {c: (1 - c / 2 - roots[c]) / (c / 2) if c else 0.0 for c in factors}
    weight = lambda c, m: (2 if m else 1) * rho[c] ** m / roots[c]
    rounds = max((next(m for m in range(1, 10_000) if 2 * rho[c] ** m / ((1 - rho[c]) * roots[c]) < tol) for c in factors), default=0)
    sums = [f"_v{i}" for i in range(len(factors))]
    # x: the last polynomial, y: the one before
    state = start.groupBy(*keys, "tag").agg(F.sum(F.col("v").cast("double")).alias("x")).withColumn("y", F.lit(0.0))
    state = cut(state.select("*", *[(F.col("x") * weight(c, 0)).alias(n) for c, n in zip(factors, sums, strict=True)]))
    ways, stays = with_own(moves), F.col("own")
    for m in range(1, rounds + 1):
        twice = 1.0 if m == 1 else 2.0
        met = state.join(ways, (F.col("tag") == F.col("a")) & (stays | (F.col("x") != 0.0)))
        kept = lambda c: F.sum(F.when(stays, c).otherwise(0.0))
        x = F.sum(F.when(stays, -twice * F.col("x") - F.col("y")).otherwise(F.col("x") * F.col("t") * (2 * twice)))
        state = met.groupBy(*keys, F.col("b").alias("tag")).agg(x.alias("x"), kept(F.col("x")).alias("y"), *[kept(F.col(n)).alias(n) for n in sums])
        state = state.select(*keys, "tag", "x", "y", *[(F.col(n) + F.col("x") * weight(c, m)).alias(n) for c, n in zip(factors, sums, strict=True)])
        if m % cut_every == 0:
            state = cut(state)
    each = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("c"), F.col(n).alias("v")) for c, n in zip(factors, sums, strict=True)]))
    return state.select(*keys, "tag", each.alias("_f")).select(*keys, "tag", "_f.c", "_f.v")


#: Numbers that a group of queries holds at a time in its task.
GROUP_CELLS = 1 << 21


def grid_gains(candidates: DataFrame, histories: DataFrame, asks: Callable[[DataFrame], DataFrame], edges: DataFrame, width: int, pairs: list[tuple[float, float]], cut: Cut, k: int = 10, seed: int = 42) -> DataFrame:
    """(at, ndcg): the mean NDCG@k of birank_items() on candidates (qid, item, is_pos), scores rounded to 9 digits, ties by the seeded order, for each of width weightings and each (alpha, beta) of pairs; at counts pairs within weightings.

    asks makes (keys of a history, item, weights: array of width, null where an item has no weight) of histories (group, qid, seq).
    Queries are dealt to groups of bounded size, each with its histories and candidates, the edges of
    its items and the tags' resolvents, which one sequence of vectors gives for all alpha x beta; all
    configurations are scored and ranked there, so nothing is shuffled for a configuration.
    """
    factors = sorted({a * b for a, b in pairs})
    twins, few = classes(edges)
    s = normalised_classes(few)
    histories = saved(histories.select("qid", "seq"), "histories")
    seen = histories.select(F.explode("seq").alias("item")).distinct()
    basis = seen.join(twins.hint("merge"), "item").select("rep").distinct().join(s, "rep").select(F.col("tag").alias("of"), "tag", F.lit(1.0).alias("v")).distinct()
    kernel = resolvents(basis, class_transitions(s), factors, cut).groupBy("of", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("v"))
    kernel = saved(kernel, "kernel")
    own = max(1, few.select("tag").distinct().count()) * width * len(factors)
    groups = -(-max(1, candidates.select("qid").distinct().count()) // max(1, GROUP_CELLS // own))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("group")
    shown = candidates.select(group, "qid", "item", F.lit(None).cast("array<double>").alias("w"), "is_pos", seeded_order(seed, F.col("qid"), F.col("item")).alias("place"))
    asked = asks(histories.select(group, "qid", "seq")).where("item IS NOT NULL").select("group", "qid", "item", F.col("weights").alias("w"), F.lit(None).cast("int").alias("is_pos"), F.lit(None).cast("string").alias("place"))
    items = candidates.select(group, "item").union(histories.select(group, F.explode("seq").alias("item"))).where("item IS NOT NULL").distinct()
    edges_of = items.join(twins.hint("merge"), "item").join(s, "rep").select("group", "item", F.lit(None).cast("string").alias("of"), "tag", F.array("s").alias("v"))
    side = edges_of.unionByName(kernel.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(None).cast(twins.schema["item"].dataType).alias("item"), "of", "tag", "v"))
    rows = shown.withColumn("is_pos", F.col("is_pos").cast("int")).unionByName(asked)
    side = saved(side, "side")  # cogroup takes no two frames with a column in common

    def gains(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        sums, n = _group_gains(rows, side, width, pairs, factors, k)
        return pd.DataFrame({"sums": [sums.tolist()], "n": [n]})

    each = rows.groupBy("group").cogroup(side.groupBy("group")).applyInPandas(gains, "sums array<double>, n long")
    return each.where("n > 0").select("n", F.posexplode("sums").alias("at", "sum")).groupBy("at").agg((F.sum("sum") / F.sum("n")).alias("ndcg"))


def _group_gains(rows: pd.DataFrame, side: pd.DataFrame, width: int, pairs: list[tuple[float, float]], factors: list[float], k: int) -> tuple[np.ndarray, int]:
    """Sums of NDCG@k over the queries of a group with a positive, weightings x pairs in a row, and their number."""
    own, kernel = side[side["of"].isna()], side[side["of"].notna()]
    tags, items = pd.Index(pd.unique(pd.concat([side["tag"], kernel["of"]]))), pd.Index(pd.unique(own["item"]))
    resolvent = np.zeros((len(factors), len(tags), len(tags)))
    if len(kernel):
        resolvent[:, tags.get_indexer(kernel["of"]), tags.get_indexer(kernel["tag"])] = np.array(kernel["v"].tolist()).T
    s = np.zeros((len(items) + 1, len(tags)))  # the last row is of items without edges
    s[items.get_indexer(own["item"]), tags.get_indexer(own["tag"])] = [v[0] for v in own["v"]]
    asked, shown = rows[rows["is_pos"].isna()], rows[rows["is_pos"].notna()].assign(place=lambda x: x["place"].fillna("")).sort_values(["qid", "place"])
    weights = np.nan_to_num(np.array(asked["w"].tolist(), dtype=float).reshape(-1, width))
    asks_of = dict(asked.reset_index(drop=True).groupby("qid").indices)
    ask_item, ask_row = asked["item"].to_numpy(), items.get_indexer(asked["item"])
    item, row, good = shown["item"].to_numpy(), items.get_indexer(shown["item"]), shown["is_pos"].to_numpy() == 1
    sums, n = np.zeros((width, len(pairs))), 0
    at, left, c = [factors.index(a * b) for a, b in pairs], np.array([1 - a for a, _ in pairs])[:, None, None], np.array(factors)[:, None, None]
    for q, where in shown.reset_index(drop=True).groupby("qid").indices.items():
        hits = np.flatnonzero(good[where])
        if not len(hits):
            continue
        mine = asks_of.get(q, np.array([], dtype=int))
        w = weights[mine].T
        spread = (w @ s[ask_row[mine]]) @ resolvent  # factors x weightings x tags
        back = (spread @ s[row[where]].T) * c
        itself = w @ (ask_item[mine][:, None] == item[where][None, :])
        scores = np.rint((back[at] + itself) * left * 1e9) / 1e9  # pairs x weightings x candidates
        gain = np.zeros(scores.shape[:2])
        for h in hits:
            one = scores[:, :, h : h + 1]
            rank = 1 + (scores > one).sum(2) + (scores[:, :, :h] == one).sum(2)
            gain += np.where(rank <= k, 1 / np.log2(rank + 1.0), 0.0)
        sums += gain.T / (1 / np.log2(np.arange(1, min(len(hits), k) + 1) + 1.0)).sum()
        n += 1
    return sums.ravel(), n


def alike(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, rep) written: the least key with the same rows of columns, in any order and as often. Such items, or queries, get the same from a graph."""
    keyed = saved(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_all")), "keyed")
    least = keyed.groupBy("_all").agg(F.min(key).alias("rep"))
    return saved(keyed.join(least.hint("merge"), "_all").select(key, "rep"), "alike")


def classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, rep), the least item with the same edges (item, tag, w), and (rep, n, tag, w), the edges of each that stands for n items; both written."""
    keyed = saved(edges.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("tag", "w"))).alias("_all")), "keyed")
    least = saved(keyed.groupBy("_all").agg(F.min("item").alias("rep"), F.count("*").alias("n")), "least")
    twins = saved(keyed.join(least.select("_all", "rep").hint("merge"), "_all").select("item", "rep"), "alike")
    return twins, least.select("rep", "n", F.inline("_all"))


def normalised_classes(few: DataFrame) -> DataFrame:
    """(rep, n, tag, s) written: normalised() of the edges that few (rep, n, tag, w) stands for."""
    items, tags = few.groupBy("rep").agg(F.sum("w").alias("di")), few.groupBy("tag").agg(F.sum(F.col("w") * F.col("n")).alias("dt"))
    met = few.join(items.hint("merge"), "rep").join(tags, "tag")
    return saved(met.select("rep", "n", "tag", (F.col("w") / F.sqrt(F.col("di") * F.col("dt"))).alias("s")), "normalised")


def class_transitions(s: DataFrame) -> DataFrame:
    """(a, b, t): tag_transitions() of the items that s (rep, n, tag, s) stands for."""
    a, b = s.select("rep", "n", F.col("tag").alias("a"), F.col("s").alias("sa")), s.select("rep", F.col("tag").alias("b"), F.col("s").alias("sb"))
    return a.join(b.hint("merge"), "rep").groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb") * F.col("n")).alias("t"))


def answers(spread: DataFrame, s: DataFrame, factor: float) -> DataFrame:
    """(asks, rep, score): factor x S x spread (asks, tag, v). A query's tags lie together, so that its sums are shuffled no more where s (rep, tag, s) is small."""
    met = spread.select("asks", "tag", "v").repartition("asks").join(s.select("rep", "tag", "s"), "tag")
    return met.groupBy("asks", "rep").agg((F.sum(F.col("v") * F.col("s")) * factor).alias("score"))


def packed(alike: DataFrame, by: str, what: str) -> DataFrame:
    """(by, what): what of each by as arrays of about TOGETHER, several for a large class."""
    sizes = alike.groupBy(by).agg(F.ceil(F.count("*") / TOGETHER).alias("_n"))
    dealt = alike.join(sizes.hint("merge"), by).withColumn("_part", F.pmod(F.xxhash64(what), F.col("_n")))
    return dealt.groupBy(by, "_part").agg(F.collect_list(what).alias(what)).select(by, what)


def asked(queries: DataFrame, twins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, item, rep, weight) of item weights (qid, item, weight), written, rep null for items without tags, and (qid, asks): the query that stands for those alike."""
    own = queries.groupBy("qid", "item").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    own = saved(own.join(twins.hint("merge"), "item", "left").select("qid", "item", "rep", "weight"), "own")
    return own, alike(own, "qid", "rep", "weight").withColumnRenamed("rep", "asks")


def given_back(found: DataFrame, twins: DataFrame, same: DataFrame, own: DataFrame | None = None, digits: int | None = None, name: Column | None = None) -> DataFrame:
    """(qid, item, score) of found (asks, rep, score): each query and each item has what stands for it, plus its own weight (own: qid, item, rep, weight).

    Scores are rounded, and items named (name, an expression of item), before they meet. Equal queries and
    equal items meet as arrays, and a row for each pair is made last, which nothing shuffles, sorts or looks up;
    only the few classes of a query that hold items with weights of their own meet row by row.
    """
    rounded = lambda c: c if digits is None else F.round(c, digits)
    shown = F.col("item") if name is None else name
    named = twins.select("rep", "item", shown.alias("name"))
    many = max(int(twins.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-twins.count() * same.count() // TASK_ROWS)))

    def pairs(rows: DataFrame) -> DataFrame:
        met = rows.join(packed(same, "asks", "qid").hint("merge"), "asks").select("rep", "shown", "qid").repartition(many, "rep")
        # both sides are dealt to so many, else the planner takes the lesser number
        met = met.join(packed(named, "rep", "name").repartition(many, "rep").hint("merge"), "rep").select("shown", "name", F.explode("qid").alias("qid"))
        return met.select("qid", F.explode("name").alias("item"), F.col("shown").alias("score"))

    if own is None:
        return pairs(found.select("asks", "rep", rounded(F.col("score")).alias("shown")))
    held = own.where("rep IS NOT NULL").join(same.where("qid = asks").hint("merge"), "qid").groupBy("asks").agg(F.collect_set("rep").alias("_reps"))
    holds = F.coalesce(F.array_contains("_reps", F.col("rep")), F.lit(False))
    found = found.join(held.hint("merge"), "asks", "left")
    found = saved(found.select("asks", "rep", F.when(holds, F.col("score")).alias("score"), F.when(~holds, rounded(F.col("score"))).alias("shown")), "found")
    mine = own.where("rep IS NOT NULL").groupBy("qid", "rep").agg(F.map_from_entries(F.collect_list(F.struct("item", "weight"))).alias("_own"))
    met = found.where("score IS NOT NULL").join(same.hint("merge"), "asks").join(mine.hint("merge"), ["qid", "rep"]).join(named.hint("merge"), "rep")
    met = met.select("qid", F.col("name").alias("item"), rounded(F.col("score") + F.coalesce(F.try_element_at("_own", "item"), F.lit(0.0))).alias("score"))
    alone = own.where("rep IS NULL").select("qid", shown.alias("item"), rounded(F.col("weight")).alias("score"))
    return pairs(found.where("shown IS NOT NULL").select("asks", "rep", "shown")).unionByName(met).unionByName(alone)


def birank_items(queries: DataFrame, edges: DataFrame, cut: Cut, alpha: float = 0.85, beta: float = 0.85, bound: float = 1e-9, digits: int | None = None) -> DataFrame:
    """(qid, item, score) of item weights (qid, item, weight): (1 - alpha) x sum of (alpha beta S transpose(S))^n on the weights.

    That sum is the weights plus alpha beta S times the sum over the tags' own
    transitions on transpose(S) x weights, pushed to bound. Items with the same edges,
    and queries with the same weights on such items, are computed once.
    """
    twins, few = classes(edges)
    s, c = normalised_classes(few), alpha * beta
    own, same = asked(queries, twins)
    asking = own.join(same.where("qid = asks").hint("merge"), "qid").groupBy("asks", "rep").agg(F.sum("weight").alias("weight"))
    start = asking.join(s.hint("merge"), "rep").groupBy("asks", "tag").agg(F.sum(F.col("weight") * F.col("s")).alias("v"))
    spread = push(start, class_transitions(s), c, cut, bound)
    return given_back(answers(spread, s, c * (1 - alpha)), twins, same, own.withColumn("weight", F.col("weight") * (1 - alpha)), digits)


def birank_tags(queries: DataFrame, edges: DataFrame, cut: Cut, alpha: float = 0.85, beta: float = 0.85, bound: float = 1e-9, digits: int | None = None) -> DataFrame:
    """(qid, item, score) of tag weights (qid, tag, weight): alpha (1 - beta) x sum of (alpha beta S transpose(S))^n S on the weights, pushed to bound.

    Items with the same edges, and queries with the same weights, are computed once.
    """
    twins, few = classes(edges)
    s = normalised_classes(few)
    same = alike(queries, "qid", "tag", "weight").withColumnRenamed("rep", "asks")
    start = queries.join(same.where("qid = asks").hint("merge"), "qid").select("asks", "tag", F.col("weight").alias("v"))
    spread = push(start, class_transitions(s), alpha * beta, cut, bound)
    return given_back(answers(spread, s, alpha * (1 - beta)), twins, same, digits=digits)


def birank(edges: DataFrame, normalizer: str, cut: Cut, alpha: float = 0.85, beta: float = 0.85, rounds: int = 200, tol: float = 1e-4, check_every: int = 5) -> DataFrame:
    """(side, node, score) of both sides of the whole graph, node as text.

    normalizer is HITS, CoHITS, BGRM or BiRank. Both sides move at once from uniform
    starts, as one frame that meets the edges of both directions in one join; HITS also divides each
    side by its sum. It stops when both sides move less than tol in sum of absolute values.
    Items with the same edges move alike, so the least of them moves for all and counts as many.
    """
    twins, few = classes(edges)
    di, dt = few.groupBy("rep").agg(F.sum("w").alias("di")), few.groupBy("tag").agg(F.sum(F.col("w") * F.col("n")).alias("dt"))
    e = few.join(di.hint("merge"), "rep").join(dt, "tag")
    w, i, t = F.col("w").cast("double"), F.col("di"), F.col("dt")
    up, down = {"HITS": (w, w), "CoHITS": (w / i, w / t), "BGRM": (w / (i * t), w / (i * t)), "BiRank": (w / F.sqrt(i * t), w / F.sqrt(i * t))}[normalizer]
    rep, tag = F.col("rep").cast("string"), F.col("tag")
    both = F.array(F.struct(F.lit("item").alias("at"), rep.alias("src"), tag.alias("dst"), (up * F.col("n") * alpha).alias("m"), F.col("n")), F.struct(F.lit("tag").alias("at"), tag.alias("src"), rep.alias("dst"), (down * beta).alias("m"), F.lit(1).cast("long").alias("n")))
    moves = saved(e.select(F.inline(both)), "moves")
    # what a node keeps comes by the same join; n: how many items it stands for
    own = moves.select("at", "src", F.col("src").alias("dst"), F.lit(0.0).alias("m"), "n").distinct()
    ways = saved(moves.select("at", "src", "dst", "m", F.lit(False).alias("own")).unionByName(own.select("at", "src", "dst", "m", F.lit(True).alias("own"))), "ways")
    n = {"i": twins.count(), "t": few.select("tag").distinct().count()}
    base = F.when(F.col("side") == "item", 1.0 / max(1, n["i"])).otherwise(1.0 / max(1, n["t"]))
    fresh = F.when(F.col("side") == "item", 1 - beta).otherwise(1 - alpha) * base
    state = cut(own.select(F.col("at").alias("side"), F.col("src").alias("node"), "n").withColumn("x", base).withColumn("was", F.lit(0.0)))
    to = F.when(F.col("own"), F.col("side")).when(F.col("side") == "item", "tag").otherwise("item")
    for r in range(1, rounds + 1):
        met = state.join(ways, (F.col("side") == F.col("at")) & (F.col("node") == F.col("src")))
        x, was = F.sum(F.when(F.col("own"), fresh).otherwise(F.col("x") * F.col("m"))), F.sum(F.when(F.col("own"), F.col("x")).otherwise(0.0))
        state = met.groupBy(to.alias("side"), F.col("dst").alias("node")).agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n"), x.alias("x"), was.alias("was"))
        if normalizer == "HITS":
            state = cut(state)
            state = state.join(F.broadcast(state.groupBy("side").agg(F.sum(F.col("x") * F.col("n")).alias("s"))), "side").select("side", "node", "n", (F.col("x") / F.col("s")).alias("x"), "was")  # two rows
        if r % check_every == 0 or r == rounds:
            state = cut(state)
            moved = state.groupBy("side").agg(F.sum(F.abs(F.col("x") - F.col("was")) * F.col("n")).alias("m")).agg(F.max("m")).first()[0] or 0.0
            if moved < tol:
                break
    each = twins.select(F.col("rep").cast("string").alias("node"), F.col("item").cast("string").alias("item"))
    items = state.where("side = 'item'").join(each.hint("merge"), "node").select("side", F.col("item").alias("node"), F.col("x").alias("score"))
    return items.unionByName(state.where("side = 'tag'").select("side", "node", F.col("x").alias("score")))


def homogeneous(edges: DataFrame) -> DataFrame:
    """(src, dst, w): both directions of every edge, nodes as i:… and t:…."""
    i, t = F.concat(F.lit("i:"), F.col("item").cast("string")), F.concat(F.lit("t:"), "tag")
    return edges.select(i.alias("src"), t.alias("dst"), "w").unionByName(edges.select(t.alias("src"), i.alias("dst"), "w"))


def pagerank(start: DataFrame, graph: DataFrame, cut: Cut, alpha: float = 0.85, rounds: int = 200, tol: float = 1e-4, check_every: int = 5) -> DataFrame:
    """(qid, node, score): personalised PageRank of all queries at once; start is (qid, node, x0) with sum 1 per query."""
    out = graph.groupBy("src").agg(F.sum("w").alias("deg"))
    moves = cut(graph.join(out, "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("m")))
    base = cut(start.select("qid", "node", F.col("x0").cast("double").alias("x0")))
    x = base.select("qid", "node", F.col("x0").alias("x"))
    for r in range(1, rounds + 1):
        moved = x.join(moves, x["node"] == moves["src"]).select("qid", F.col("dst").alias("node"), (F.col("x") * F.col("m") * alpha).alias("x"))
        new = moved.unionByName(base.select("qid", "node", (F.col("x0") * (1 - alpha)).alias("x"))).groupBy("qid", "node").agg(F.sum("x").alias("x"))
        if r % check_every == 0 or r == rounds:
            new = cut(new)
            step = new.join(x.withColumnRenamed("x", "y"), ["qid", "node"], "full").groupBy("qid").agg(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))).alias("s")).agg(F.max("s")).first()[0]
            if (step or 0.0) < tol:
                x = new
                break
        x = new
    return x.select("qid", "node", F.col("x").alias("score"))


def pagerank_items(start: DataFrame, edges: DataFrame, cut: Cut, alpha: float = 0.85, rounds: int = 200, tol: float = 1e-4, check_every: int = 5, digits: int | None = None) -> DataFrame:
    """(qid, node, score): pagerank() on the homogeneous graph of edges, from items alone: start is (qid, item, x0), x0 above 0.

    A round takes what tags have from two rounds before, over the items between, so only
    tags are iterated: t(r) = alpha^2 K t(r - 2) + alpha (1 - alpha) z, z the start on its tags. Items come
    from t(r - 1) after the last round. Items with the same edges, and queries with the same start
    on such items, are computed once. It stops at the round at which pagerank() stops: what items
    move is bounded by what tags moved, and summed over items only where that bound does not decide.
    rounds is 2 at least.
    """
    twins, few = classes(edges)
    di, dt = few.groupBy("rep").agg(F.sum("w").alias("di")), few.groupBy("tag").agg(F.sum(F.col("w") * F.col("n")).alias("dt"))
    few = saved(few.join(di.hint("merge"), "rep").join(dt, "tag").select("rep", "tag", "n", (F.col("w") / F.col("di")).alias("up"), (F.col("w") / F.col("dt")).alias("down")), "few")
    own, same = asked(start.withColumnRenamed("x0", "weight"), twins)
    asking = own.where("rep IS NOT NULL").join(same.where("qid = asks").hint("merge"), "qid").groupBy("asks", "rep").agg(F.sum("weight").alias("x0"))
    k = few.select("rep", F.col("tag").alias("a"), (F.col("n") * F.col("down")).alias("down")).join(few.select("rep", F.col("tag").alias("b"), "up").hint("merge"), "rep")
    ways, stays = with_own(k.groupBy("a", "b").agg(F.sum(F.col("down") * F.col("up")).alias("t"))), F.col("own")
    z = asking.join(few.hint("merge"), "rep").groupBy("asks", "tag").agg(F.sum(F.col("x0") * F.col("up")).alias("z"))
    # x, y and was: t of the last round and of the two before
    state = cut(z.select("asks", "tag", "z", (F.col("z") * alpha).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("was")))
    kept = lambda c: F.sum(F.when(stays, F.col(c)).otherwise(0.0))

    def settled() -> bool:
        tags, most = F.sum(F.abs(F.col("x") - F.col("y"))).alias("tags"), (F.sum(F.abs(F.col("y") - F.col("was"))) * alpha).alias("most")
        moved = state.groupBy("asks").agg(tags, most)
        least, most = moved.agg(F.max("tags"), F.max(F.col("tags") + F.col("most"))).first()
        if most is None or most < tol or least >= tol:
            return most is None or most < tol
        each = state.join(few, "tag").groupBy("asks", "rep", "n").agg(F.sum((F.col("y") - F.col("was")) * F.col("down")).alias("d"))
        items = each.groupBy("asks").agg(F.sum(F.abs("d") * F.col("n") * alpha).alias("items"))
        return moved.join(items, "asks").agg(F.max(F.col("tags") + F.col("items"))).first()[0] < tol

    for r in range(2, rounds + 1):
        met = state.join(ways, (F.col("tag") == F.col("a")) & (stays | (F.col("y") != 0.0)))
        x = F.sum(F.when(stays, F.col("z") * (alpha * (1 - alpha))).otherwise(F.col("y") * F.col("t") * alpha**2))
        state = met.groupBy("asks", F.col("b").alias("tag")).agg(kept("z").alias("z"), x.alias("x"), kept("x").alias("y"), kept("y").alias("was"))
        if r % check_every == 0 or r == rounds:
            state = cut(state)
            if settled():
                break
    back = answers(state.where("y <> 0").withColumnRenamed("y", "v"), few.withColumnRenamed("down", "s"), alpha)
    node = F.concat(F.lit("i:"), F.col("item").cast("string"))
    found = given_back(back, twins, same, own.withColumn("weight", F.col("weight") * (1 - alpha)), digits, node)
    x = F.col("x") if digits is None else F.round("x", digits)
    tags = state.where("x <> 0").join(same.hint("merge"), "asks").select("qid", F.concat(F.lit("t:"), "tag").alias("node"), x.alias("score"))
    return found.withColumnRenamed("item", "node").unionByName(tags)
