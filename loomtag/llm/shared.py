"""Helpers of the training-data operators: running sums over range partitions, and Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.scratch import cut, new_path, removed, saved, shared_dir  # noqa: F401

#: ASCII white space, as Java and RE2 both read it; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"

def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda and after filters move."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with a column for each of sums (name: long column): its sum over all rows before this one in order, which must tell all rows apart.

    Rows are range-partitioned and the ranges written, so that each row's range is
    the same when it is read twice; within a range a window sums, and a window over
    one row for each range gives what lies before it. No task sees more than a range.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = saved(ranged.withColumns({f"_{k}": v for k, v in sums.items()}), name)
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    whole = whole.select("_range", *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_before_{k}") for k in sums])
    within = ranged.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inner), F.lit(0)) for k in sums})
    return within.join(F.broadcast(whole), "_range").select(*columns, *[(F.col(k) + F.col(f"_before_{k}")).alias(k) for k in sums])  # one row for each range


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Slices of a batch whose rows have sizes of about `most` together; one large row is a slice of its own."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of a batch whose texts hold about most_bytes; one long text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    yield from row_slices(batch, sizes, most_bytes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply) over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and the number of words of each text (null: none)."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[real], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(real))
    return flat, counts


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts one after the other, and the number of words of each text."""
    flat, counts = split_words(texts, lower=True)
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (table[codes] if len(codes) else np.zeros(0, np.uint64)), counts
