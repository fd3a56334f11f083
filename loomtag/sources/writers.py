"""Writers: tag dictionaries, labelled sessions, split examples, item texts, id maps, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.operators.evaluation import upserted


def tag_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """(item, tags) or counts, as Parquet or JSON lines."""
    df.write.mode("overwrite").format(form).save(path)


def examples(df: DataFrame, path: str) -> None:
    """(user, split, history, target) as tab-separated files in a folder per split, items separated by blanks."""
    flat = df.select("user", "split", F.array_join(F.transform("history", lambda x: x.cast("string")), " ").alias("items"), F.col("target").cast("string").alias("item"))
    flat.write.mode("overwrite").partitionBy("split").csv(path, sep="\t", header=True)


def item_texts(df: DataFrame, path: str) -> None:
    """(idx, text) lines, one blank in the place of tabs and line ends."""
    df.select("idx", F.regexp_replace("text", r"[\t\r\n]+", " ").alias("text")).write.mode("overwrite").csv(path, sep="\t", header=True)


def id_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def labelled_sessions(df: DataFrame, path: str) -> int:
    """(labels, items) as a file with a header: labels as a JSON list in `Class`, then one cell for each item, null behind the last.

    Returns the number of item columns, with which readers.classified_sessions reads it back. Null items go.
    """
    rows = df.select(F.to_json("labels").alias("Class"), F.array_compact(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    width = rows.agg(F.max(F.size("items"))).first()[0] or 0
    rows.select("Class", *[F.get("items", F.lit(i)).alias(f"Event_{i + 1}") for i in range(width)]).write.mode("overwrite").csv(path, header=True, escape='"')
    return width


def upsert_results(spark: SparkSession, old_path: str | None, new: DataFrame, path: str, key: str = "hash") -> DataFrame:
    """The old table with new's rows in place of those with the same key, written to another path."""
    merged = new if old_path is None else upserted(spark.read.schema(new.schema).parquet(old_path), new, key)
    merged.write.mode("errorifexists").parquet(path)
    return spark.read.schema(new.schema).parquet(path)
