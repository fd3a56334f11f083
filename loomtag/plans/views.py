"""The driver's tables seen as sessions, labels, tags, sequences, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.operators.tagging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, item): the parts of an order, for operators that take each once themselves."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item"))


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, item): the distinct parts of an order."""
    lines = session_lines(spark, sf_dir)
    return spread(lines, lines.count(), "session_id").distinct()  # hardly any rows repeat within a split


def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, labels): segment, priority, status and region of an order. Customers, nations and regions are dimensions."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = people.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).hint("merge")  # 25 nations; customers grow, however small their file
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    orders = spread(orders, orders.count(), "o_custkey")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("session_id"), F.array("c_mktsegment", "o_orderpriority", "o_orderstatus", "r_name").alias("labels"))


def base_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, tags): brand, type and the words of the name of a part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")).alias("tags"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, ts, action) of the event stream; the item is in its properties."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("item"), "ts", F.col("event_type").alias("action"))


def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, tags) of all parts, with ids as the events write them."""
    return base_tags(spark, sf_dir).select(F.col("item").cast("int").alias("item"), "tags")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, day, session_id) of customers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("day"))
    return orders.hint("merge").join(session_items(spark, sf_dir), "session_id").select("user", "item", "day", "session_id")  # both grow, however small their files


ITEMS_SQL = "session_items AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey AS item FROM lineitem)"
LABELS_SQL = """session_labels AS (
  SELECT o_orderkey AS session_id, [c_mktsegment, o_orderpriority, o_orderstatus, r_name] AS labels
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), session_label AS (SELECT session_id, unnest(labels) AS label FROM session_labels)"""
TAGS_SQL = "base_tags AS (SELECT p_partkey AS item, list_concat([p_brand, p_type], string_split(p_name, ' ')) AS tags FROM part)"
EVENTS_SQL = "ev AS (SELECT user_id AS \"user\", CAST(json_extract_string(props, '$.k') AS INT) AS item, ts, event_type AS action FROM events)"
EVENT_TAGS_SQL = TAGS_SQL + ", event_tags AS (SELECT item::INT AS item, tags FROM base_tags)"
ONLY_PURCHASES_SQL = 'purchases AS (SELECT o_custkey AS "user", item, o_orderdate AS day, session_id FROM orders JOIN session_items ON o_orderkey = session_id)'
PURCHASES_SQL = f"{ITEMS_SQL}, {ONLY_PURCHASES_SQL}"
SEQS_SQL = EVENTS_SQL + ', seqs AS (SELECT "user", list(item ORDER BY ts, item) AS seq FROM ev GROUP BY "user")'
