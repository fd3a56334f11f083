"""Corpora of items and their tags: (item, tags array); repeated tags count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_tags(tags: Column, skip: int, take: int) -> Column:
    """take tags after the first skip."""
    return F.slice(tags, skip + 1, take)


def with_own_id(tags: Column, item: Column, times: int = 1) -> Column:
    """Appends the item's id as a tag, so many times."""
    return F.concat(tags, F.array_repeat(item.cast("string"), times))


def lowered(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.lower(t))


def edges(corpus: DataFrame) -> DataFrame:
    """(item, tag, w): how often an item has a tag."""
    return corpus.select("item", F.explode("tags").alias("tag")).groupBy("item", "tag").agg(F.count("*").alias("w"))


def tag_domain(corpus: DataFrame) -> DataFrame:
    """(tag, n): tags with the number of their occurrences."""
    return corpus.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def statistics(corpus: DataFrame) -> DataFrame:
    """One row: items, tags, distinct edges, density, items per tag, tags per item."""
    e = edges(corpus)
    n = corpus.agg(F.countDistinct("item").alias("items"))
    s = e.agg(F.countDistinct("tag").alias("tags"), F.count("*").alias("edges")).withColumn("items", n.scalar())
    return s.select("items", "tags", "edges", (F.col("edges") / (F.col("items") * F.col("tags"))).alias("density"), (F.col("edges") / F.col("tags")).alias("items_per_tag"), (F.col("edges") / F.col("items")).alias("tags_per_item"))


def aligned(items: DataFrame, by_id: DataFrame, by_index: DataFrame) -> DataFrame:
    """(item, idx, tags): the tags of an item's id, else those of its index, else none."""
    a = by_id.select("item", F.col("tags").alias("_a"))
    b = by_index.select("idx", F.col("tags").alias("_b"))
    none = F.array().cast("array<string>")
    return items.select("item", "idx").join(a, "item", "left").join(b, "idx", "left").select("item", "idx", F.coalesce("_a", "_b", none).alias("tags"))


def rewritten(corpus: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags replaced by mapping (tag, to); tags without a mapping drop out, repeated ones stay, order is kept."""
    long = corpus.select("item", F.posexplode("tags").alias("pos", "tag")).join(mapping, "tag")
    pairs = F.array_sort(F.collect_list(F.struct("pos", "to")))
    return long.groupBy("item").agg(F.transform(pairs, lambda x: x["to"]).alias("tags"))


def preference_first(tags: Column, suffix: str, most_native: int) -> Column:
    """Preference tags (without their suffix), then at most most_native of the others."""
    own = F.transform(F.filter(tags, lambda t: F.endswith(t, F.lit(suffix))), lambda t: F.regexp_replace(t, f"{suffix}$", ""))
    return F.concat(own, F.slice(F.filter(tags, lambda t: ~F.endswith(t, F.lit(suffix))), 1, most_native))


def session_tags(items: DataFrame, corpus: DataFrame, first: int = 3, distinct: bool = False) -> DataFrame:
    """(session_id, tags): the first tags of each distinct item of a session, in the order of the items."""
    met = items.select("session_id", "item").distinct().join(corpus.select("item", F.slice("tags", 1, first).alias("t")), "item")
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item", "t"))), lambda x: x["t"]))
    return met.groupBy("session_id").agg((F.array_distinct(ordered) if distinct else ordered).alias("tags"))


def merged_tags(similar: DataFrame, frequency: DataFrame, cut) -> DataFrame:
    """(tag, leader): greedy merging of similar tags (a, b), the most frequent first, ties by name.

    A tag is a leader if no earlier similar tag is one, and else follows the earliest
    similar leader. Each round decides all tags with no undecided earlier neighbour,
    at least one, which ends as the scan over all tags in order would.
    """
    rank = frequency.select("tag", F.struct((-F.col("n")).alias("n"), "tag").alias("o"))
    both = similar.select("a", "b").union(similar.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    earlier = both.join(rank.select(F.col("tag").alias("a"), F.col("o").alias("oa")), "a").join(rank.select(F.col("tag").alias("b"), F.col("o").alias("ob")), "b").where("ob < oa").select("a", "b", "ob")
    earlier = cut(earlier)
    state = cut(frequency.select("tag", F.lit(None).cast("boolean").alias("lead")))
    while not state.where("lead IS NULL").isEmpty():
        seen = earlier.join(state.select(F.col("tag").alias("b"), "lead"), "b").groupBy("a").agg(F.bool_or(F.coalesce("lead", F.lit(False))).alias("led"), F.bool_or(F.col("lead").isNull()).alias("open"))
        met = state.join(seen.withColumnRenamed("a", "tag"), "tag", "left")
        now = F.when(F.col("lead").isNotNull(), F.col("lead")).when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut(met.select("tag", now.alias("lead")))
    leaders = earlier.join(state.where("lead").select(F.col("tag").alias("b")), "b").groupBy(F.col("a").alias("tag")).agg(F.min("ob").alias("o"))
    follow = state.where("NOT lead").join(leaders, "tag").select("tag", F.col("o.tag").alias("leader"))
    return follow.union(state.where("lead").select("tag", F.col("tag").alias("leader")))


def merged_to_reference(similar: DataFrame, reference: DataFrame) -> DataFrame:
    """(tag, leader): the first matching reference tag (reference: ref, pos; similar: tag, ref)."""
    return similar.join(reference, "ref").groupBy("tag").agg(F.min_by("ref", "pos").alias("leader"))


def top_tags(corpus: DataFrame, n: int) -> DataFrame:
    order = Window.orderBy(F.desc("n"), "tag")
    return tag_domain(corpus).orderBy(F.desc("n"), "tag").limit(n).withColumn("rank", F.row_number().over(order))
