"""Mixing sources to target weights along a curriculum whose source rates change over training.

Each source has a target of words (its share of all words by weight, capped at a
number of repeats) and a rate over training time. The integral of the rate is the
source's cumulative demand; inverting it at the place of a document within its
source gives the training position of the document, and sorting by position gives
the order of training.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.llm.shared import count_words, running_sums, saved

#: Weights of the sources in the order of their names, repeating; no source is read more often than MOST_REPEATS times.
WEIGHTS, MOST_REPEATS = (1, 2, 3), 3
#: Rate of a source over training time as straight lines between (time, rate) knots, by its place in WEIGHTS.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
#: Rows of a source that are summed in one group.
GROUP_ROWS = 2_000


def inverse_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of the rate reaches `share` of its total (rates are positive or zero, not all zero)."""
    areas, total = [0.0], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        total += (t1 - t0) * (r0 + r1) / 2
        areas.append(total)
    out = F.lit(float(knots[-1][0]))
    for k in range(len(knots) - 2, -1, -1):
        (t0, r0), (t1, r1) = knots[k], knots[k + 1]
        slope, more = (r1 - r0) / (t1 - t0), share * total - areas[k]
        if slope:
            at = (F.sqrt(F.greatest(F.lit(r0 * r0) + more * (2 * slope), F.lit(0.0))) - r0) / slope
        else:
            at = more / (r0 or 1.0)
        out = F.when(share * total < areas[k + 1], at + t0).otherwise(out)
    return out


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, ahead, place, target) from rows (source, size); ahead is the size of the sources before it by name.

    Targets share the sum of all sizes by weight; one that would exceed MOST_REPEATS
    times its source's size stops there and the excess is reshared by weight. In the
    order of cap / weight the sources that stop are a prefix, so running sums find
    the common factor of the others. They are taken in range partitions, so that
    sources may be as many as web hosts.
    """
    by_name = F.col("source").asc_nulls_last()
    src = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    src = running_sums(src, [by_name], {"ahead": F.col("source_size"), "place": F.lit(1)}, "sources")
    src = src.withColumn("place", F.col("place") % len(WEIGHTS))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * MOST_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    src = saved(running_sums(src, [F.col("ratio"), by_name], {"caps": F.col("cap"), "weights": F.col("weight")}, "ratios"), "factors")
    whole = src.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # of the sources that don't stop, the first in this order has the largest factor
    factor = (F.lit(whole["size"]) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("weights"))
    common = src.agg(F.max(F.when(factor <= F.col("ratio"), factor)).alias("f")).first()["f"]
    return src.select("source", "source_size", "ahead", "place", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(common)).alias("target"))


def assigned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES) -> DataFrame:
    """(row, id, size, source_size, target, taken, positions) for each row of docs; row is a struct of all its columns.

    size is the number of words (null text: 0), positions the training positions in
    [0, 1] of its copies (none to MOST_REPEATS), taken the words of these copies. A
    source reads its documents in the order of md5(id), over again up to
    MOST_REPEATS times; a copy belongs to the mix if its middle lies before the
    target, so a source misses its target by half a document at most. Its position
    is the time at which its source's schedule has asked for that many words. A null
    source is a source, the last by name. Rows that repeat an id, or have none, count
    separately, ordered by size; equal ones tie and their positions go to either. A
    very long text is one document of its size. An empty table gives no rows. Columns
    of docs may have any name.

    The running sum within a source is taken in groups of md5 prefixes, so that a
    source with a third of all rows is spread over many tasks.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source_col).alias("source"), F.col(id_col).alias("id"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        count_words(F.col(text_col)).alias("size"),
    )
    digits = max(1, math.ceil(math.log(max(1, docs.count() / GROUP_ROWS), 16)))
    base = base.withColumn("part", F.substring("key", 1, digits))
    parts = saved(base.groupBy("source", "part").agg(F.sum("size").alias("size")), "parts")
    offsets = running_sums(parts, [F.col("source").asc_nulls_last(), F.col("part")], {"before": F.col("size")}, "parts")
    targets = source_targets(parts)
    about = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source"))
    about = about.select("o.source", "o.part", (F.col("o.before") - F.col("t.ahead")).alias("before"), "t.source_size", "t.place", "t.target")
    inner = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    met = placed.alias("p").join(about.alias("a"), F.expr("p.source <=> a.source AND p.part = a.part")).select("p.*", "a.before", "a.source_size", "a.place", "a.target")
    middles = [F.col("before") + F.col("within") + F.col("source_size") * k + F.col("size") / 2 for k in range(MOST_REPEATS)]
    shares = F.array(*[F.when(m < F.col("target"), m / F.col("target")) for m in middles])

    def position(share: Column) -> Column:
        return F.coalesce(*[F.when(F.col("place") == i, inverse_demand(share, schedules[i])) for i in range(len(WEIGHTS))])

    met = met.withColumn("positions", F.transform(F.array_compact(shares), position))
    return met.select("row", "id", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions")


def range_sorted(rows: DataFrame, *order: Column) -> DataFrame:
    """rows range-partitioned and sorted."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, one row for each copy that the mix takes, range-partitioned and sorted by training position."""
    found = assigned(docs, **options).select("row", F.explode("positions").alias("position"))
    return range_sorted(found, F.col("position")).select("row.*")


def curriculum(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, size, source_size, target, taken, position_1 …): the training positions of a document's copies, null where the mix takes fewer.

    Range-sorted by the first position, documents that the mix leaves out last;
    target and positions are rounded to six places. Rows as assigned() describes.
    """
    found = assigned(docs, id_col=id_col, **options)
    positions = [F.round(F.get("positions", F.lit(k)), 6).alias(f"position_{k + 1}") for k in range(MOST_REPEATS)]
    found = found.select(F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), "taken", *positions)
    return range_sorted(found, F.col("position_1").asc_nulls_last(), F.col(id_col))


def _inverse_sql(share: str, knots: tuple[tuple[float, float], ...]) -> str:
    """inverse_demand in SQL."""
    areas = [0.0]
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (t1 - t0) * (r0 + r1) / 2)
    cases = ""
    for k, ((t0, r0), (t1, r1)) in enumerate(zip(knots, knots[1:], strict=False)):
        slope, more = (r1 - r0) / (t1 - t0), f"({share} * {areas[-1]}::DOUBLE - {areas[k]}::DOUBLE)"
        at = f"(sqrt(greatest({r0 * r0}::DOUBLE + {more} * {2 * slope}::DOUBLE, 0)) - {r0}::DOUBLE) / {slope}::DOUBLE" if slope else f"{more} / {r0 or 1.0}::DOUBLE"
        cases += f" WHEN {share} * {areas[-1]}::DOUBLE < {areas[k + 1]}::DOUBLE THEN {at} + {t0}::DOUBLE"
    return f"CASE{cases} ELSE {knots[-1][0]}::DOUBLE END"


def _positions_sql(schedules=SCHEDULES) -> str:
    out = []
    for k in range(MOST_REPEATS):
        middle = f"(middle + {k} * source_size)"
        cases = " ".join(f"WHEN {i + 1} THEN {_inverse_sql(f'({middle} / target)', knots)}" for i, knots in enumerate(schedules))
        out.append(f"CASE WHEN {middle} < target THEN round(CASE place {cases} END, 6) END AS position_{k + 1}")
    return ",\n       ".join(out)


#: DuckDB SQL for the op3 query.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, weight AS place FROM s),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
f AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE) AS factor FROM r
),
g AS (SELECT source, source_size, place, least(cap::DOUBLE, weight * (SELECT max(factor) FROM f WHERE factor <= ratio)) AS target FROM f),
o AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2 AS middle FROM d
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       size * ((middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2 * source_size < target)::BIGINT) AS taken,
       {_positions_sql()}
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""
