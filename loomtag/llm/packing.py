"""Best-fit packing into sequences of several permitted lengths.

Pieces go, the longest first, into the open sequence that they fill best. Where none
has room, a sequence of the length with the least cost per word that it can still
hold is opened, given what is left to pack; at the end every sequence shrinks to the
least permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.llm.shared import count_words, saved

#: Permitted sequence lengths in words; longer documents are cut into pieces of the largest.
LENGTHS = (256, 512, 1024, 2048)
#: Bounds of what one task packs: sequences of the largest length, and pieces.
GROUP_SEQUENCES, GROUP_PIECES = 512, 50_000
#: Where order counts: parts of all words that the order is kept to, the least sequences of a group, and rows of a file that are summed in one group.
ORDER_PARTS, LEAST_SEQUENCES, BLOCK_ROWS = 64, 8, 20_000


def training_cost(length: int) -> float:
    """Cost of a sequence: a part in proportion to its length, one to its square (attention), and a fixed one."""
    return length * (1 + length / 8192) + 16


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = training_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins for sizes in descending order, none above the largest length: (bin of each, offset of each, length of each bin).

    Open bins are kept by free space, and a mask of bits says which spaces occur, so
    the best fit is the lowest bit at or above the size.
    """
    lengths = tuple(sorted(lengths))
    n, top = len(sizes), lengths[-1]
    left = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])  # words from piece i on
    first_at_most = n - np.searchsorted(sizes[::-1], np.arange(top + 1), side="right")
    by_space: list[list[int]] = [[] for _ in range(top + 1)]
    occurs = 0
    used: list[int] = []
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    space: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        above = occurs >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = by_space[free].pop()
            if not by_space[free]:
                occurs ^= 1 << free
        else:
            best = None
            for c in lengths:
                if c >= size:
                    fill = size + min(c - size, int(left[max(i + 1, first_at_most[c - size])]))
                    if best is None or cost(c) / fill < best[0]:
                        best = (cost(c) / fill, c)
            b, free = len(used), best[1]
            used.append(0)
            space.append(free)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        rest = free - size
        if rest:
            by_space[rest].append(b)
            occurs |= 1 << rest
    taken = np.array(used, np.int64)
    return bins, offsets, np.array(lengths, np.int64)[np.searchsorted(lengths, taken)] if len(taken) else taken


def stored_order() -> list[Column]:
    """(part number, file name, row) of rows read from Parquet files: the order in which a sorted table was written."""
    name = F.col("_metadata.file_name")
    return [F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(-1).cast("long")), name, F.col("_metadata.row_index")]


def _in_order(base: DataFrame, top: int) -> DataFrame:
    """base with before, the words ahead of a row, and group, its contiguous range of words and pieces; base has (part, file, row, words, n_pieces)."""
    base = base.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS))
    blocks = base.groupBy("part", "file", "block").agg(F.sum("words").alias("w"), F.sum("n_pieces").alias("p"))
    whole = Window.partitionBy(F.lit(0))  # over one row for each block
    ahead = whole.orderBy("part", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in "wp"], F.sum("w").over(whole).alias("w_all"))
    inner = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    within = [F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"{c}_within") for c in ("words", "n_pieces")]
    met = base.select("*", *within).join(blocks, ["file", "block"])
    most = F.least(F.lit(top * GROUP_SEQUENCES), F.greatest(F.lit(top * LEAST_SEQUENCES), F.ceil(F.col("w_all") / ORDER_PARTS)))
    return met.withColumns({"before": F.col("w_ahead") + F.col("words_within"), "pieces_before": F.col("p_ahead") + F.col("n_pieces_within"), "most": most})


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, order: list[Column] | None = None) -> DataFrame:
    """(id_col, piece, start, length, bin_id, bin_offset, bin_used, bin_length): one row for each piece of a document.

    A document of more words than the largest length, a very long one too, is cut
    into pieces; start is the first word of a piece. One without words (or null) has
    one piece of length 0 in no bin. Rows that repeat an id are packed separately;
    null ids are packed as others. Among pieces of one length the smaller id goes
    first; rows equal in all but their place in the table get equal treatment. An
    empty table gives no rows; columns besides the two named are ignored.

    Pieces are dealt into groups of bounded words and pieces, each packed by one
    task; bins don't cross groups, which leaves at most a few of them part-filled.
    They are dealt by a hash of the id, of the text and of the row's number among
    equal ones, so that the result depends on the rows alone and not on how Spark
    reads them.

    With order, columns (part, file, row) such as stored_order(), groups are contiguous
    ranges of that order, each at most a 64th of all words (or LEAST_SEQUENCES
    sequences, where that is more), and bin_id ascends with it: by group, and within a
    group by the first of a bin's pieces.
    """
    top = max(lengths)
    place = [c.alias(n) for c, n in zip(order, ("part", "file", "row"), strict=True)] if order else [F.xxhash64(text_col).alias("content")]
    base = docs.select(F.col(id_col).alias("id"), count_words(F.col(text_col)).alias("words"), *place)
    starts = F.when(F.col("words") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(top).cast("long")))
    length = F.least(F.col("words") - F.col("start"), F.lit(top)).alias("length")
    if order:
        base = saved(base.withColumn("n_pieces", F.size(starts).cast("long")), "sizes")
        base = _in_order(base, top)
        pieces = base.select("*", F.posexplode(starts).alias("piece", "start"))
        # both terms only grow along the order, so that equal sums are one range within both bounds
        group = F.floor((F.col("before") + F.col("start")) / F.col("most")) + F.floor((F.col("pieces_before") + F.col("piece")) / GROUP_PIECES)
        pieces = pieces.select("id", "piece", "start", length, group.alias("group"), (F.col("before") + F.col("start")).alias("place"))
        ties = ["place"]
    else:
        # equal rows are one row with a number until they are dealt, however many they are
        base = saved(base.groupBy("id", "words", "content").agg(F.count("*").alias("copies")), "sizes")
        n_pieces = F.greatest(F.ceil(F.col("words") / top), F.lit(1))
        totals = base.agg(F.sum(F.col("words") * F.col("copies")).alias("w"), F.sum(n_pieces * F.col("copies")).alias("p")).first()
        groups = max(1, -(-int(totals["w"] or 0) // (top * GROUP_SEQUENCES)), -(-int(totals["p"] or 0) // GROUP_PIECES))
        copies = base.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        pieces = copies.select("id", "words", "content", "copy", F.posexplode(starts).alias("piece", "start"))
        pieces = pieces.select("id", "piece", "start", length, F.pmod(F.xxhash64("id", "content", "copy", "piece"), F.lit(groups)).alias("group"))
        ties = ["id", "piece", "start"]
    ordered = bool(order)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *ties], ascending=[False] + [True] * len(ties), kind="stable").reset_index(drop=True)
        bins, offsets, sizes = best_fit(pdf["length"].to_numpy(), lengths)
        used = np.bincount(bins, weights=pdf["length"], minlength=len(sizes)).astype(np.int64)
        number = np.arange(len(sizes))
        if ordered:
            first = np.full(len(sizes), np.iinfo(np.int64).max)
            np.minimum.at(first, bins, pdf["place"].to_numpy())
            number[np.argsort(first)] = np.arange(len(sizes))
        out = pdf.assign(bin_id=pdf["group"] * (1 << 32) + number[bins], bin_offset=offsets, bin_used=used[bins], bin_length=sizes[bins])
        return out.drop(columns="place") if ordered else out

    schema = f"id {base.schema['id'].dataType.simpleString()}, piece int, start long, length long, group long, bin_id long, bin_offset long, bin_used long, bin_length long"
    real = pieces.where("length > 0").groupBy("group").applyInPandas(pack, schema).drop("group")
    none = pieces.where("length = 0").select("id", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_used", "bin_length")])
    return real.unionByName(none).withColumnRenamed("id", id_col)
