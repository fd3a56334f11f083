"""Labels of sessions as tags of items: co-occurrence counts, z-scores, levels, label patterns, merging with base tags.

Sessions are (session_id, item) and (session_id, labels array) frames; everything
stays long and is aggregated before it is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.operators.quantiles import percentiles

#: Rows of a side that meet in one task; the number of tasks follows from the rows.
TASK_ROWS = 1 << 19


@dataclass(frozen=True)
class TagConfig:
    """Thresholds of tag mining: levels are (least z, suffix), ascending."""

    divisor: float = 20.0
    levels: tuple[tuple[float, str], ...] = ((0.0, " Preference"),)
    most_labels: int = 6
    least_support: int = 20
    most_patterns: int = 10
    strength: float = 0.3


def parsed_labels(text: Column) -> Column:
    """A JSON list of labels; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def distinct_items(items: Column) -> Column:
    """Trimmed items in order of appearance, without blanks and `nan`."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan")))


def known_items(names: DataFrame, ids: DataFrame) -> DataFrame:
    """names (…, name) with the item of ids (name, item); unknown names drop out."""
    return names.join(ids, "name")


def tasks(df: DataFrame, rows: int) -> int:
    """A number of tasks in proportion to rows, at least as many as the session has for shuffles."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to a number of tasks in proportion to its rows, at least to as many as the session has for shuffles."""
    return df.repartition(tasks(df, rows), *keys)


def item_label_counts(items: DataFrame, labels: DataFrame, dedup: bool = True) -> DataFrame:
    """(item, label, cnt): sessions with both. A label that a session repeats counts once unless dedup is off.

    Both sides grow with the sessions, so they meet by sorting, whatever their files
    look like, in as many tasks as their rows ask for. Repeated items go after that
    shuffle: before it hardly any rows repeat, and a task would hold those of a whole split.
    Labels stay one array until a rebalance has put the sessions of an item
    together: then the counts of a task are few, and a frequent item is split. The
    rebalance has as many parts as the rows ask for, too, of which small ones are joined.
    """
    own = F.array_distinct("labels") if dedup else F.col("labels")
    sessions = labels.select("session_id", own.alias("labels")).hint("merge")
    lines = items.select("session_id", "item")
    rows = lines.count()
    met = spread(lines, rows, "session_id").distinct().join(sessions, "session_id").select("item", "labels").hint("rebalance", tasks(lines, rows), "item")
    long = met.select("item", F.explode("labels").alias("label")).where(F.col("label").isNotNull())
    return long.groupBy("item", "label").agg(F.count("*").alias("cnt"))


def label_incidences(counts: DataFrame) -> DataFrame:
    return counts.groupBy("label").agg(F.sum("cnt").alias("incidences"))


def reliable(counts: DataFrame, n_sessions: DataFrame, divisor: float = 20.0) -> DataFrame:
    """Counts of labels with at least n / divisor item-session incidences; n_sessions has one row `n`."""
    keep = label_incidences(counts).where(F.col("incidences") >= n_sessions.select(F.col("n") / divisor).scalar())
    return counts.join(keep.select("label"), "label", "left_semi")  # labels are few: a window over a label would be one task


def label_statistics(counts: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes, median and size of a label over the items that have it."""
    c = F.col("cnt")
    return counts.groupBy("label").agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.percentile(c, F.lit(0.5)).alias("median"), F.count("*").alias("n_items")
    )


def item_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("item").agg(F.sum("cnt").alias("freq"))


def quartiles(frequencies: DataFrame) -> DataFrame:
    """One row of exact quartiles (linear interpolation) of item frequencies."""
    return percentiles(frequencies, "freq", {f"q{round(q * 100)}": q for q in (0.25, 0.5, 0.75)})


def label_frequency_percentile(counts: DataFrame, share: float = 0.6) -> DataFrame:
    return percentiles(label_incidences(counts), "incidences", {"percentile": share})


def with_zscores(counts: DataFrame) -> DataFrame:
    """Adds z of cnt within its label; 0 where a label does not vary."""
    stats = label_statistics(counts).select("label", "mean", "std")
    z = F.when(F.col("std") == 0, 0.0).otherwise(F.try_divide(F.col("cnt") - F.col("mean"), F.col("std")))
    return counts.join(stats, "label").withColumn("z", z).drop("mean", "std")


def level(z: Column, levels: tuple[tuple[float, str], ...]) -> Column:
    """The suffix of the band that z lies in; null below the lowest."""
    out = F.lit(None).cast("string")
    for least, name in levels:
        out = F.when(z >= least, name).otherwise(out)
    return out


def frequency_adjustment(freq: Column, q25: Column, q50: Column, q75: Column, strength: float = 0.3) -> Column:
    """Down for items above the third quartile, up for those below the first, by their distance over the quartile gap.

    An empty gap pushes without bound, as the limit of the division does.
    """
    high = F.when(q75 == q50, F.lit(float("-inf"))).otherwise(-F.try_divide(freq - q75, q75 - q50) * strength)
    low = F.when(q50 == q25, F.lit(float("inf"))).otherwise(F.try_divide(q25 - freq, q50 - q25) * strength)
    return F.when(freq > q75, high).when(freq < q25, low).otherwise(F.lit(0.0))


def zscore_tags(counts: DataFrame, config: TagConfig = TagConfig()) -> DataFrame:
    """(item, label, z, adjusted, level, rank): at most most_labels labels of an item, by adjusted score, then name."""
    freq = item_frequencies(counts)
    q = quartiles(freq)
    f = freq.join(F.broadcast(q))  # one row
    f = f.select("item", frequency_adjustment(F.col("freq"), F.col("q25"), F.col("q50"), F.col("q75"), config.strength).alias("adjustment"))
    scored = with_zscores(counts).withColumn("level", level(F.col("z"), config.levels)).where(F.col("level").isNotNull())
    scored = scored.join(f, "item").withColumn("adjusted", F.col("z") + F.col("adjustment"))
    order = Window.partitionBy("item").orderBy(F.desc("adjusted"), "label")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.most_labels).select("item", "label", "z", "adjusted", "level", "rank")


def threshold_items(base: DataFrame, counts: DataFrame, config: TagConfig = TagConfig(levels=((float("-inf"), " Preference"),))) -> DataFrame:
    """(item, base, labels: array of (rank, tag, z)) of base (item, tags): all labels in the order of zscore_tags(), from which threshold_tags() takes those of any threshold.

    Where an item's adjustment is finite that order is the order of z, so no threshold takes a label beyond the first most_labels, and these alone are kept.
    """
    every = replace(config, most_labels=1 << 30)
    tags = zscore_tags(counts, every).where((F.col("rank") <= config.most_labels) | (F.abs("adjusted") == float("inf")))
    own = tags.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("label", "level").alias("tag"), "z"))).alias("labels"))
    return base.select("item", F.col("tags").alias("base")).hint("merge").join(own, "item", "left")


def threshold_tags(base: Column, labels: Column, least: float, most_labels: int = 6) -> Column:
    """Base tags, then at most most_labels of the labels (rank, tag, z) from z = least on, which may be null."""
    found = F.transform(F.slice(F.filter(labels, lambda x: x["z"] >= least), 1, most_labels), lambda x: x["tag"])
    return F.concat(base, F.coalesce(found, F.array().cast("array<string>")))


def coverage(counts: DataFrame, kept: DataFrame, tags: DataFrame, strong: float = 0.6) -> DataFrame:
    """One row that sums a tagging run up: items and labels kept, labels removed as rare, strong labels, items tagged, tags, labels used.

    counts are all (item, label, cnt), kept those of reliable labels; a label is
    strong from the given percentile of incidences on.
    """
    own = label_incidences(counts)
    bound = own.agg(F.percentile("incidences", F.lit(strong)).alias("p"))
    all_labels = own.agg(F.count("*").alias("all_labels"), F.count_if(F.col("incidences") >= bound.scalar()).alias("strong_labels"))
    seen = tags.agg(F.countDistinct("item").alias("tagged_items"), F.count("*").alias("tags"), F.countDistinct("label").alias("used_labels"), F.avg("z").alias("mean_z"))
    whole = kept.agg(F.countDistinct("item").alias("items"), F.countDistinct("label").alias("labels"))
    met = seen.join(F.broadcast(whole)).join(F.broadcast(all_labels))  # one row each
    return met.withColumn("removed_labels", F.col("all_labels") - F.col("labels")).drop("all_labels")


def level_counts(tags: DataFrame) -> DataFrame:
    """(level, tags, share): how many of all tags each level has."""
    counts = tags.where(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("tags"))
    return counts.withColumn("share", F.col("tags") / counts.agg(F.sum("tags").alias("n")).scalar())


def frequent_patterns(labels: DataFrame, least_support: int, most: int | None = None, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(pattern, size, support): sorted label combinations of a session, kept from least_support sessions on.

    A session has few labels, so its combinations are enumerated in place, without a join.
    """
    own = labels.select(F.array_sort(F.array_distinct("labels")).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.array(a, b))))
    triples = F.flatten(F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b, j: F.transform(F.slice("l", i + j + 3, F.size("l")), lambda c: F.array(a, b, c))))))
    found = [{2: pairs, 3: triples}[s] for s in sizes]
    counts = own.select(F.explode(F.concat(*found)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= least_support)
    counts = counts.select(F.array_join("pattern", "+").alias("pattern"), F.size("pattern").alias("size"), "support")
    return counts if most is None else counts.orderBy(F.desc("support"), "pattern").limit(most)


def item_pattern_counts(items: DataFrame, labels: DataFrame, patterns: DataFrame) -> DataFrame:
    """(item, pattern, cnt): sessions with the item and all labels of the pattern; patterns are a top-k list."""
    few = F.broadcast(patterns.select("pattern", F.split("pattern", r"\+").alias("_parts")))
    met = labels.join(few, F.size(F.array_except("_parts", "labels")) == 0).select("session_id", "pattern")
    return items.select("session_id", "item").distinct().join(met, "session_id").groupBy("item", "pattern").agg(F.count("*").alias("cnt"))


def pattern_zscores(counts: DataFrame) -> DataFrame:
    """(item, pattern, cnt, z): each item that has any pattern with every pattern; missing cells count as zero, in mean and deviation too.

    The statistics come from sums over the cells that exist. The list of patterns is
    a top-k list, so that it can be a scalar.
    """
    n = counts.select(F.countDistinct("item").alias("n"))
    c = F.col("cnt").cast("double")
    sums = counts.groupBy("pattern").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q")).withColumn("n", n.scalar())
    stats = sums.select("pattern", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)), F.lit(0.0))).alias("std"))
    every = stats.agg(F.collect_list(F.struct("pattern", "mean", "std")).alias("p"))
    own = counts.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "cnt"))).alias("own"))
    cells = own.withColumn("p", F.explode(every.scalar())).select("item", "p.*", F.coalesce(F.try_element_at("own", F.col("p.pattern")), F.lit(0)).cast("long").alias("cnt"))
    z = F.when(F.col("std") == 0, 0.0).otherwise(F.try_divide(F.col("cnt") - F.col("mean"), F.col("std")))
    return cells.select("item", "pattern", "cnt", z.alias("z"))


def enhanced(base: DataFrame, singles: DataFrame, composites: DataFrame) -> DataFrame:
    """(item, tags): base tags, then label tags by rank, then pattern tags by name; items without base tags drop out.

    singles holds (item, label, level, rank), composites (item, pattern, level).
    """
    none = F.array().cast("array<string>")
    one = singles.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("label", "level").alias("t")))), lambda x: x["t"]).alias("_one"))
    two = composites.where(F.col("level").isNotNull()).groupBy("item").agg(F.array_sort(F.collect_list(F.concat("pattern", "level"))).alias("_two"))
    both = one.join(two, "item", "full").select("item", F.concat(F.coalesce("_one", none), F.coalesce("_two", none)).alias("_more"))
    return base.join(both, "item", "left").select("item", F.concat("tags", F.coalesce("_more", none)).alias("tags"))


def threshold_grid(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tags, items, labels) for each threshold: the z-scores are made once and each row counts towards every threshold below it."""
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    long = scored.select("item", "label", F.explode(F.filter(grid, lambda t: t <= F.col("z"))).alias("threshold"))
    return long.groupBy("threshold").agg(F.count("*").alias("tags"), F.countDistinct("item").alias("items"), F.countDistinct("label").alias("labels"))


def bisect_threshold(evaluate, low: float = -2.0, high: float = 2.0, tolerance: float = 0.1, most_rounds: int = 8) -> tuple[float, dict[float, float]]:
    """The threshold with the best value of evaluate(threshold), by halving towards the better end (ties: the lower).

    Each round evaluates both ends and the middle, then stops if the range is within
    the tolerance. evaluate runs one Spark job on a saved table; each threshold is
    evaluated once.
    """
    seen: dict[float, float] = {}

    def value(t: float) -> float:
        if t not in seen:
            seen[t] = evaluate(t)
        return seen[t]

    for _ in range(most_rounds):
        middle = (low + high) / 2
        at_low, _, at_high = value(low), value(middle), value(high)
        if high - low <= tolerance:
            break
        if at_low >= at_high:
            high = middle
        else:
            low = middle
    best = max(sorted(seen), key=lambda t: seen[t])
    return best, seen
