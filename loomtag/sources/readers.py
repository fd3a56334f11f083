"""Readers of the input shapes: ragged sessions, labelled sessions, dictionaries, interactions, atomic files, metadata, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtag.scratch import saved

#: A comma outside of quotes.
_CELL = r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"


def _cells(line: Column) -> Column:
    bare = F.transform(F.split(line, _CELL), lambda x: F.trim(x))
    return F.transform(bare, lambda x: F.when(x.rlike(r'^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def ragged_sessions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(items): one session per line, cells of any number; quoted cells may hold commas. Blank cells and blank lines drop out."""
    items = F.filter(_cells(F.col("value")), lambda x: x != "")
    out = spark.read.text(path).select(items.alias("items")).where(F.size("items") > 0)
    return out if most is None else out.where(F.size("items") <= most)


def classified_sessions(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(class, items): a header, a `Class` column with a JSON list, then up to width nullable item columns."""
    schema = ", ".join(["Class string", *[f"e{i} string" for i in range(width)]])
    raw = spark.read.csv(path, header=True, schema=schema, escape='"', enforceSchema=True)
    return raw.select(F.col("Class").alias("class"), F.filter(F.array(*[f"e{i}" for i in range(width)]), lambda x: x.isNotNull()).alias("items"))


def _running(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """pieces (file, block, i, …) with name: the sum of value over all pieces before in the file.

    Within a block by a window, across blocks by one row for each.
    """
    inner = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = pieces.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(F.broadcast(blocks), ["file", "block"]).withColumn(name, F.col(name) + F.col("_ahead")).drop("_ahead")  # one row for each block that Spark reads


def json_dictionary(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of one JSON object per file; value is a Spark type.

    An object may be far larger than a task's memory, on one line or many: Spark reads byte ranges
    of a file as pieces between commas. Running counts of quotes and of brackets
    outside of strings tell which commas separate entries of the object, and the pieces
    between two of those are put together and parsed. An entry is held whole by a task.
    """
    raw = spark.read.option("lineSep", ",").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, which stand in strings alone
    pieces = saved(raw.select("*", F.split(bare, '"').alias("parts")), "pieces")
    pieces = _running(pieces, F.size("parts") - 1, "quotes")
    inside = F.col("quotes") % 2
    outer = F.array_join(F.filter("parts", lambda _, k: k % 2 == inside), "")
    bracket = lambda chars: F.length(outer) - F.length(F.translate(outer, chars, ""))
    pieces = pieces.withColumn("delta", bracket("{[") - bracket("}]")).drop("parts")
    pieces = _running(saved(pieces, "depths"), F.col("delta"), "depth")
    pieces = _running(saved(pieces, "entries"), F.when((inside == 0) & (F.col("depth") == 1), 1).otherwise(0), "before")
    entry = F.col("before") + F.when((inside == 0) & (F.col("depth") == 1), 1).otherwise(0)
    ordered = F.sort_array(F.collect_list(F.struct("block", "i", "value")))
    entries = pieces.groupBy("file", entry.alias("entry")).agg(F.array_join(F.transform(ordered, lambda p: p["value"]), ",").alias("text"), F.sum("delta").alias("delta"))
    text = F.when(F.col("entry") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    # the last entry closes the object, which the first has opened
    closes = F.when(F.col("entry") == 0, F.col("delta") == 0).otherwise(F.col("delta") < 0)
    text = F.when(closes, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    return entries.select(F.explode(F.from_json(F.concat(F.lit("{"), text, F.lit("}")), f"map<string,{value}>")).alias("key", "value"))


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return json_dictionary(spark, path, "array<string>").select(F.col("key").alias("item"), F.col("value").alias("tags"))


def sequence_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return json_dictionary(spark, path, "array<string>").select(F.col("key").alias("user"), F.col("value").alias("seq"))


def interactions(spark: SparkSession, path: str, user: str, item: str, time: str, types: str = "bigint") -> DataFrame:
    """(user, item, ts) of a CSV of timed interactions with a header, whatever the order of its columns."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(user).try_cast(types).alias("user"), F.col(item).try_cast(types).alias("item"), F.col(time).alias("ts"))


def list_literals(spark: SparkSession, path: str, column: str, element: str = "bigint") -> DataFrame:
    """A CSV with a header, one column of which holds list literals; that column becomes an array."""
    return spark.read.csv(path, header=True, escape='"').withColumn(column, F.from_json(column, f"array<{element}>"))


def atomic_interactions(spark: SparkSession, path: str) -> DataFrame:
    """(user, history, target) of a tab-separated file of user, item list and item."""
    raw = spark.read.csv(path, header=True, sep="\t", schema="user string, items string, item string")
    return raw.select("user", F.filter(F.split("items", " "), lambda x: x != "").alias("history"), F.col("item").alias("target"))


def atomic_items(spark: SparkSession, path: str) -> DataFrame:
    """Item features of a tab-separated file whose header names `field:type`: token and other texts stay, float becomes double, *_seq an array at blanks."""
    raw = spark.read.csv(path, header=True, sep="\t", quote="")

    def typed(column: str):
        name, _, kind = column.partition(":")
        value = F.col(f"`{column}`")
        if kind.endswith("_seq"):
            parts = F.filter(F.split(value, " "), lambda x: x != "")
            value = F.transform(parts, lambda x: x.try_cast("double")) if kind == "float_seq" else parts
        elif kind == "float":
            value = value.try_cast("double")
        return value.alias(name)

    return raw.select(*[typed(c) for c in raw.columns])


def candidate_lists(spark: SparkSession, path: str) -> DataFrame:
    """(user, items) of lines `user <tab> item item …`."""
    raw = spark.read.csv(path, sep="\t", schema="user string, items string")
    return raw.select("user", F.filter(F.split("items", " "), lambda x: x != "").alias("items"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(item, user, rating, time); lines that don't parse and exact repeats drop out."""
    schema = "item string, user string, rating double, time bigint"
    return spark.read.csv(path, schema=schema, mode="DROPMALFORMED").where("time IS NOT NULL AND rating IS NOT NULL").dropDuplicates()


def item_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(item, title, brand, category) of JSON lines, gzipped or not; rows without a title drop out, tabs in titles become blanks."""
    raw = spark.read.json(path, schema="asin string, title string, brand string, category array<string>")
    return raw.where(F.length(F.trim("title")) > 0).select(F.col("asin").alias("item"), F.translate("title", "\t", " ").alias("title"), "brand", "category")


def event_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(item, vector) of a Parquet table."""
    return spark.read.parquet(path).select("item", F.col("vector").cast("array<float>").alias("vector"))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def answer_log(spark: SparkSession, path: str) -> DataFrame:
    """(kind, items) of log lines `Here are candidates: […]` and `Here are answer: […]`."""
    raw = spark.read.text(path)
    kind = F.regexp_extract("value", r"Here are (candidates|answer):", 1)
    return raw.select(kind.alias("kind"), F.from_json(F.regexp_replace(F.regexp_extract("value", r"\[.*\]", 0), "'", '"'), "array<string>").alias("items")).where("kind <> ''")
