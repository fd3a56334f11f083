"""Batch runs of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.plans import views as V
from loomtag.plans.registry import query
from loomtag.streaming import label_counts as L


@query("window_label_counts", f"WITH {V.EVENTS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, item, action AS label, count(*) AS cnt FROM ev GROUP BY 1, 2, 3")
def window_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("string").cast("timestamp"), "UTC"))
    return L.window_label_counts(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "item", "label", "cnt")
