"""Sequences of users: collecting, splitting, examples for training and evaluation, dense ids, k-core.

A sequence frame has a user and `seq`, the array of the user's items in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.scratch import saved


def collect_sequences(events: DataFrame, user: str = "user", item: str = "item", order: str = "ts") -> DataFrame:
    """(user, seq): the items of each user by (order, item)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))
    return events.groupBy(user).agg(F.transform(pairs, lambda x: x["i"]).alias("seq"))


def last_n(seq: Column, n: int) -> Column:
    """The last n items, or all of a shorter sequence."""
    return F.slice(seq, F.greatest(F.size(seq) - n, F.lit(0)) + 1, F.lit(n))


def at_least(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return df.where(F.size(seq) >= n)


def at_most(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return df.where(F.size(seq) <= n)


def window_of_sessions(df: DataFrame, start: int, size: int, id_col: str = "session_id") -> DataFrame:
    """Sessions with dense id in [start, start + size)."""
    return df.where((F.col(id_col) >= start) & (F.col(id_col) < start + size))


def long_ids(ids: Column, n: int) -> Column:
    """Ids of at least n characters."""
    return F.filter(ids, lambda x: F.length(x) >= n)


def leave_one_out(df: DataFrame, two_item_users: bool = True) -> DataFrame:
    """Adds train (all but two), valid (last but one) and test (last).

    A user with two items keeps one for training and one for the test if
    two_item_users, and has a null valid; shorter sequences have a null test.
    """
    n = F.size("seq")
    train = F.when(n >= 3, F.slice("seq", F.lit(1), n - 2)).otherwise(F.slice("seq", F.lit(1), F.greatest(n - 1, F.lit(0))) if two_item_users else F.slice("seq", 1, 0))
    test = F.when(n >= (2 if two_item_users else 3), F.get("seq", n - 1))
    return df.withColumns({"train": train, "valid": F.when(n >= 3, F.get("seq", n - 2)), "test": test})


def collapse_runs(events: DataFrame, user: str = "user", item: str = "item", order: str = "ts") -> DataFrame:
    """Of each run of equal consecutive items the last event."""
    following = F.lead(item).over(Window.partitionBy(user).orderBy(order))
    return events.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") != F.col(item))).drop("_next")


def sliding_examples(df: DataFrame, most: int = 50, seq: str = "seq") -> DataFrame:
    """(user…, pos, history, target): every item from the second on with at most `most` items before it."""
    rest = [c for c in df.columns if c != seq]
    long = df.select(*rest, seq, F.posexplode(seq).alias("pos", "target")).where("pos >= 1")
    start = F.greatest(F.col("pos") - most, F.lit(0))
    return long.select(*rest, "pos", F.slice(seq, start + 1, F.col("pos") - start).alias("history"), "target")


def held_out_examples(df: DataFrame, most: int = 50) -> DataFrame:
    """(user, split, history, target) of a frame from leave_one_out: valid after train, test after train and valid."""
    valid = F.struct(F.lit("valid").alias("split"), last_n(F.col("train"), most).alias("history"), F.col("valid").alias("target"))
    past = F.concat("train", F.when(F.col("valid").isNull(), F.slice("train", 1, 0)).otherwise(F.array("valid")))
    test = F.struct(F.lit("test").alias("split"), last_n(past, most).alias("history"), F.col("test").alias("target"))
    return df.select("user", F.explode(F.array(valid, test)).alias("e")).select("user", "e.*").where("target IS NOT NULL")


def item_based(examples: DataFrame) -> DataFrame:
    """Examples whose history is its last item."""
    return examples.withColumn("history", F.array(F.element_at("history", -1)))


def first_occurrences(events: DataFrame, user: str = "user", item: str = "item", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Of each user and item the first event."""
    first = F.row_number().over(Window.partitionBy(user, item).orderBy(*order))
    return events.withColumn("_r", first).where("_r = 1").drop("_r")


def temporal_split(events: DataFrame, train: float = 0.7, valid: float = 0.9, order: str = "ts") -> DataFrame:
    """Adds split by fractions of the time span of all events (epoch seconds)."""
    at = F.unix_timestamp(F.col(order).cast("timestamp")).cast("double")
    span = events.agg(F.struct(F.min(at).alias("lo"), F.max(at).alias("hi")).alias("s"))
    timed = events.withColumn("_s", span.scalar()).withColumn("_f", at - F.col("_s.lo"))
    whole = F.col("_s.hi") - F.col("_s.lo")
    split = F.when(F.col("_f") <= whole * train, "train").when(F.col("_f") <= whole * valid, "valid").otherwise("test")
    return timed.withColumn("split", split).drop("_s", "_f")


def boundary_split(sessions: DataFrame, reference: DataFrame, id_col: str = "session_id") -> DataFrame:
    """Adds split by the least session id of the valid and test parts of reference (id_col, split)."""
    least = reference.agg(F.struct(F.min(F.when(F.col("split") == "valid", F.col(id_col))).alias("v"), F.min(F.when(F.col("split") == "test", F.col(id_col))).alias("t")).alias("s"))
    marked = sessions.withColumn("_s", least.scalar())
    split = F.when(F.col(id_col) >= F.col("_s.t"), "test").when(F.col(id_col) >= F.col("_s.v"), "valid").otherwise("train")
    return marked.withColumn("split", split).drop("_s")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): 0, 1, … over the sorted distinct non-null keys.

    Keys are range-partitioned; the rows before a partition are a sum over one count
    per partition, so no window sees all keys.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    # ranges are found by sampling: write one dealing of the keys for the counts and for the rows
    ranked = saved(keys.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))), "dense")
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n"), F.min(key).alias("_least"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranked.join(F.broadcast(before), "_p").select(key, (F.col("_before") + F.col("_r") - 1).alias(name))  # one row per partition


def first_appearance_ids(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, name): 0, 1, … over the distinct non-null keys by their least value of order, ties by key."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_o")).select(F.struct("_o", F.col(key).alias("_k")).alias("_s"))
    return dense_ids(first, "_s", name).select(F.col("_s._k").alias(key), name)


def positional_split(ids: DataFrame, index: str, train: float = 0.7, valid: float = 0.9) -> DataFrame:
    """Adds split by the place of a dense index: the first 70 %, the next 20 %, the rest."""
    n = ids.agg(F.count("*").alias("n"))
    marked = ids.withColumn("_n", n.scalar())
    split = F.when(F.col(index) < F.floor(F.col("_n") * train), "train").when(F.col(index) < F.floor(F.col("_n") * valid), "valid").otherwise("test")
    return marked.withColumn("split", split).drop("_n")


def next_item_examples(past: DataFrame, held: DataFrame) -> DataFrame:
    """(user, k, history, target): each item of a held-out sequence after all that came before it; a missing side is empty."""
    both = past.select("user", F.col("seq").alias("p")).join(held.select("user", F.col("seq").alias("h")), "user", "full")
    both = both.select("user", F.coalesce("p", F.slice("h", 1, 0)).alias("p"), "h")
    long = both.select("user", "p", "h", F.posexplode("h").alias("k", "target"))
    return long.select("user", "k", F.concat("p", F.slice("h", F.lit(1), F.col("k"))).alias("history"), "target").where(F.size("history") > 0)


def unseen_last_items(df: DataFrame, n: int = 1, least_history: int = 1) -> DataFrame:
    """(user, history, targets): the shortest end of a sequence with n items that don't occur before it.

    An item is unseen before an end if its first occurrence lies in it, so the end
    begins at the n-th largest of the first occurrences: one aggregate over the
    positions of a user and one pass over the sequence, linear in its length. Null items count as one
    item. Users without such an end, or with less than least_history items before
    it, drop out; rows that repeat a user stay rows of their own.
    """
    long_enough = saved(df.where(F.size("seq") >= least_history + n).withColumn("_row", F.monotonically_increasing_id()), "sequences")
    first = long_enough.select("_row", F.posexplode("seq").alias("pos", "item")).groupBy("_row", "item").agg(F.min("pos").alias("pos"))
    begins = first.groupBy("_row").agg(F.sort_array(F.collect_list("pos"), asc=False).alias("firsts")).where(F.size("firsts") >= n)
    begins = begins.select("_row", F.get("firsts", F.lit(n - 1)).alias("start"), F.reverse(F.slice("firsts", 1, n)).alias("at"))
    met = long_enough.join(begins, "_row").where(F.col("start") >= least_history)
    return met.select("user", F.slice("seq", F.lit(1), F.col("start")).alias("history"), F.transform("at", lambda i: F.get("seq", i)).alias("targets"))


def first_item_retrieval(df: DataFrame, least_others: int = 1) -> DataFrame:
    """(user, query, targets): the first item asks for the rest, which must hold least_others other items."""
    rest = F.slice("seq", F.lit(2), F.greatest(F.size("seq") - 1, F.lit(0)))
    out = df.where(F.size("seq") >= 1).select("user", F.get("seq", F.lit(0)).alias("query"), rest.alias("targets"))
    return out.where(F.size(F.array_except("targets", F.array("query"))) >= least_others)


def indexed(df: DataFrame, ids: DataFrame, key: str = "item", index: str = "idx") -> DataFrame:
    """Sequences with items replaced by their index; unknown items drop out."""
    long = df.select("user", F.posexplode("seq").alias("pos", key)).join(ids, key)
    pairs = F.array_sort(F.collect_list(F.struct("pos", index)))
    return long.groupBy("user").agg(F.transform(pairs, lambda x: x[index]).alias("seq"))


def skipped_items(df: DataFrame, ids: DataFrame, key: str = "item") -> DataFrame:
    """(key, n): how often sequences hold an item that indexed() drops."""
    return df.select(F.explode("seq").alias(key)).join(ids.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def with_metadata(interactions: DataFrame, metadata: DataFrame, key: str = "item") -> DataFrame:
    """Interactions with items that metadata knows."""
    return interactions.join(metadata.select(key), key, "left_semi")


def only_known_sessions(df: DataFrame, known: DataFrame, key: str = "item") -> DataFrame:
    """Sessions (user, seq) all of whose items are known."""
    long = df.select("user", F.explode("seq").alias(key)).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    good = long.groupBy("user").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("ok")).where("ok").select("user")
    return df.join(good, "user", "left_semi")


def joined_splits(*splits: DataFrame) -> DataFrame:
    """Users' sequences of several splits one after the other; a missing split is empty."""
    out = splits[0].select("user", F.col("seq"))
    for s in splits[1:]:
        met = out.join(s.select("user", F.col("seq").alias("_more")), "user", "full")
        none = F.slice(F.coalesce("seq", "_more"), 1, 0)
        out = met.select("user", F.concat(F.coalesce("seq", none), F.coalesce("_more", none)).alias("seq"))
    return out


def prediction_domain(candidates: DataFrame, seen: DataFrame, positives: DataFrame, repeatable: bool = False) -> DataFrame:
    """(user, item): candidates that the user has not seen, and the positives; all candidates if repeatable."""
    if repeatable:
        return candidates.select("user", "item").union(positives.select("user", "item")).distinct()
    # a domain is far larger than the planner takes it for, and both sides grow
    fresh = candidates.select("user", "item").hint("merge").join(seen.select("user", "item"), ["user", "item"], "left_anti")
    return fresh.union(positives.select("user", "item")).distinct()


def interaction_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def _without_trees(df: DataFrame, cut: Callable[[DataFrame], DataFrame], user: str, item: str) -> DataFrame:
    """The interactions left when nodes with a single one are taken off again and again: what has two at every node.

    A chain of nodes with two interactions each would go one node a round. So every
    interaction, in either direction, points to the one behind the node that it leads to;
    pointers double until they reach a loose end or a fork, and all that leads to a loose end goes at
    once. A turn takes off every chain that ends loosely, which at least halves the loose ends.
    """
    while True:
        rows = cut(df.withColumn("_e", F.monotonically_increasing_id()))
        arcs = []
        for side, key in ((0, user), (1, item)):
            at = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("_e").alias("lo"), F.max("_e").alias("hi"))
            to = F.when(F.col("n") == 2, F.col("lo") + F.col("hi") - F.col("_e"))
            arcs.append(rows.join(at, key).select("_e", F.lit(side).alias("s"), to.alias("to"), F.lit(1 - side).alias("to_s"), (F.col("n") == 1).alias("loose")))
        state, before = cut(arcs[0].unionByName(arcs[1])), -1
        if not state.where("loose").head(1):
            return rows.drop("_e")
        while True:
            running = state.where("to IS NOT NULL").count()
            if running in (0, before):  # what still runs goes round in a circle
                break
            before = running
            ahead = state.select(F.col("_e").alias("to"), F.col("s").alias("to_s"), F.struct("to", "to_s", "loose").alias("then"))
            met = state.where("to IS NOT NULL").join(ahead, ["to", "to_s"]).select("_e", "s", "then.*")
            state = cut(state.where("to IS NULL").unionByName(met))
        df = rows.join(state.where("loose").select("_e").distinct(), "_e", "left_anti").drop("_e")


def k_core(df: DataFrame, user_min: int, item_min: int, cut: Callable[[DataFrame], DataFrame], user: str = "user", item: str = "item", compact: float = 0.5) -> DataFrame:
    """The interactions in which every user has user_min and every item item_min of them; 0 disables a side.

    Delta peeling: degrees are counted once, and a round looks at the interactions
    of the nodes that went in the last one and lowers the degrees of their neighbours
    alone. Interactions are written anew, and degrees counted again, when no more than
    `compact` of them is left. Rounds have no bound, each removes a node at least; where both sides ask for two, chains
    are contracted first. Interactions without a user or an item that is asked for go; cut
    ends a lineage (a checkpoint in the shared folder).
    """
    least, columns = {k: n for k, n in ((user, user_min), (item, item_min)) if n}, df.columns
    for key in least:
        df = df.where(F.col(key).isNotNull())
    df = cut(df)
    if list(least.values()) == [2, 2]:
        df = _without_trees(df, cut, user, item)
    while True:
        degree = {k: cut(interaction_counts(df, k)) for k in least}
        dead = {k: cut(degree[k].where(F.col("n") < least[k]).select(k)) for k in least}
        gone, lost, total = {k: dead[k].limit(0) for k in least}, {}, df.count()
        left = total
        while any(dead[k].head(1) for k in least) and left > compact * total:
            live = df.select(user, item)
            for k in least:
                live = live.join(gone[k], k, "left_anti").join(dead[k].withColumn(f"_{k}", F.lit(True)), k, "left")
            hit = cut(live.where(F.coalesce(*[F.col(f"_{k}") for k in least])).select(user, item))
            left -= hit.count()
            for k in least:
                gone[k] = cut(gone[k].union(dead[k]))
                now = hit.groupBy(k).agg(F.count("*").alias("lost"))
                both = now if k not in lost else lost[k].unionByName(now).groupBy(k).agg(F.sum("lost").alias("lost"))
                lost[k] = cut(both)
            for k in least:
                touched = hit.select(k).distinct().join(gone[k], k, "left_anti").join(degree[k], k).join(lost[k], k)
                dead[k] = cut(touched.where(F.col("n") - F.col("lost") < least[k]).select(k))
        if left == total:
            return df
        for k in least:
            df = df.join(gone[k].union(dead[k]), k, "left_anti")
        df = cut(df.select(*columns))


def length_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.size("seq").alias("length")).agg(F.count("*").alias("users"))


def totals(df: DataFrame) -> DataFrame:
    """One row: users, items, interactions."""
    return df.agg(F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"), F.count("*").alias("interactions"))


def seeded_order(seed: int, *cols: Column) -> Column:
    """md5 of the seed and the columns: the order of all sampling, equal in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def user_downsample(splits: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All rows of n users drawn by the seed."""
    drawn = splits.select("user").distinct().orderBy(seeded_order(seed, F.col("user")), "user").limit(n)
    return splits.join(drawn, "user", "left_semi")


def block_sample(ids: DataFrame, size: int, seed: int = 42, id_col: str = "session_id") -> DataFrame:
    """One row of each run of `size` consecutive dense ids."""
    block = F.floor(F.col(id_col) / size)
    order = Window.partitionBy(block).orderBy(seeded_order(seed, F.col(id_col)), id_col)
    return ids.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def masked_history(df: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(user, kept, hidden): max(1, share) of a user's items are hidden, the others shuffled by the seed."""
    keyed = F.array_sort(F.transform("seq", lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("user").cast("string"), i.cast("string"))).alias("h"), x.alias("x"))))
    n = F.greatest(F.lit(1), F.floor(F.size("seq") * share)).cast("int")
    order = df.select("user", F.transform(keyed, lambda p: p["x"]).alias("o"), n.alias("n"))
    return order.select("user", F.slice("o", F.col("n") + 1, F.size("o")).alias("kept"), F.slice("o", F.lit(1), F.col("n")).alias("hidden"))


def shuffled_history(df: DataFrame, seed: int = 42) -> DataFrame:
    """Sequences in the order of the seed."""
    keyed = F.array_sort(F.transform("seq", lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("user").cast("string"), i.cast("string"))).alias("h"), x.alias("x"))))
    return df.withColumn("seq", F.transform(keyed, lambda p: p["x"]))


def random_history(df: DataFrame, n_items: int, seed: int = 42) -> DataFrame:
    """Sequences of the same lengths with items drawn from 0 … n_items - 1 by the seed."""
    draw = lambda x, i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("user").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n_items))
    return df.withColumn("seq", F.transform("seq", draw))
