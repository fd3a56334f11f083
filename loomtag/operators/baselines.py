"""Baseline scorers: popularity, Markov transitions, browsed items, random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtag.operators.sequences import seeded_order


def popularity(events: DataFrame) -> DataFrame:
    """(item, score): how often an item occurs."""
    return events.groupBy("item").agg(F.count("*").alias("score"))


def scaled_popularity(examples: DataFrame) -> DataFrame:
    """(item, cnt, score) of examples (history, target): targets, and first items of one-item histories, over the largest count."""
    first = examples.where(F.size("history") == 1).select(F.get("history", F.lit(0)).alias("item"))
    counts = examples.select(F.col("target").alias("item")).union(first).groupBy("item").agg(F.count("*").alias("cnt"))
    most = counts.agg(F.max("cnt").alias("m"))
    return counts.withColumn("score", F.col("cnt") / most.scalar())


def for_queries(queries: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """(qid, item, score, rank): every query gets the same n best items (a top-k list, ties by item)."""
    best = scores.orderBy(F.desc("score"), "item").limit(n).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item"))).alias("b"))
    long = queries.select("qid", F.posexplode(best.scalar()).alias("r", "b"))
    return long.select("qid", "b.item", (-F.col("b.s")).alias("score"), (F.col("r") + 1).alias("rank"))


def transitions(events: DataFrame, user: str = "user", order: str = "ts") -> DataFrame:
    """(prev, next, p): share of the moves from an item that go to another."""
    following = F.lead("item").over(Window.partitionBy(user).orderBy(order))
    moves = events.select(F.col("item").alias("prev"), following.alias("next")).where("next IS NOT NULL").groupBy("prev", "next").agg(F.count("*").alias("n"))
    return moves.select("prev", "next", (F.col("n") / (F.sum("n").over(Window.partitionBy("prev")) + 1e-10)).alias("p"))


def markov_scores(weights: DataFrame, moves: DataFrame) -> DataFrame:
    """(qid, item, score): item weights of a history through the transitions."""
    met = weights.join(moves, weights["item"] == moves["prev"])
    return met.groupBy("qid", F.col("next").alias("item")).agg(F.sum(F.col("weight") * F.col("p")).alias("score"))


def browsed_scores(histories: DataFrame) -> DataFrame:
    """(qid, item, score): the last place of an item in the history, from 1."""
    return histories.select("qid", F.posexplode("seq").alias("pos", "item")).groupBy("qid", "item").agg((F.max("pos") + 1).alias("score"))


def random_ranks(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """Adds rank in the seeded order to (qid, item)."""
    order = Window.partitionBy("qid").orderBy(seeded_order(seed, F.col("qid"), F.col("item")), "item")
    return candidates.withColumn("rank", F.row_number().over(order))
