"""Tag mining over orders: which labels (segment, priority, status, region) of the sessions describe a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.operators import tagging as T
from loomtag.plans import views as V
from loomtag.plans.registry import query
from loomtag.scratch import saved

CONFIG = T.TagConfig(levels=((0.5, " Preference"), (1.5, " Strong Preference")), least_support=100)
STRICT = 1.0

_COUNTS = f"""{V.ITEMS_SQL}, {V.LABELS_SQL},
counts AS (SELECT item, label, count(*) AS cnt FROM session_items JOIN session_label USING (session_id) GROUP BY item, label)"""
_RELIABLE = """reliable AS (
  SELECT c.* FROM counts c JOIN (SELECT label, sum(cnt) AS inc FROM counts GROUP BY label) USING (label)
  WHERE inc >= (SELECT count(*) FROM orders) / {divisor}
)"""
_Z = """st AS (SELECT label, avg(cnt) AS mean, stddev_pop(cnt) AS std FROM reliable GROUP BY label),
z AS (SELECT item, label, cnt, CASE WHEN std = 0 THEN 0.0 ELSE (cnt - mean) / std END AS z FROM reliable JOIN st USING (label)),
fr AS (SELECT item, sum(cnt) AS freq FROM reliable GROUP BY item),
qs AS (SELECT quantile_cont(freq, 0.25) AS q25, quantile_cont(freq, 0.5) AS q50, quantile_cont(freq, 0.75) AS q75 FROM fr),
adj AS (
  SELECT item, CASE WHEN freq > q75 THEN CASE WHEN q75 = q50 THEN '-infinity'::DOUBLE ELSE -(freq - q75) / (q75 - q50) * 0.3 END
                    WHEN freq < q25 THEN CASE WHEN q50 = q25 THEN 'infinity'::DOUBLE ELSE (q25 - freq) / (q50 - q25) * 0.3 END ELSE 0.0 END AS adjustment
  FROM fr, qs
),
tags AS (
  SELECT item, label, z, z + adjustment AS adjusted, CASE WHEN z >= 1.5 THEN ' Strong Preference' ELSE ' Preference' END AS level,
         row_number() OVER (PARTITION BY item ORDER BY z + adjustment DESC, label) AS rank
  FROM z JOIN adj USING (item) WHERE z >= 0.5 QUALIFY rank <= 6
)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.item_label_counts(V.session_lines(spark, sf_dir), V.session_labels(spark, sf_dir))


def _reliable(spark: SparkSession, sf_dir: str, divisor: float = 20.0, counts: DataFrame | None = None) -> DataFrame:
    """Counts of reliable labels, written: incidences, statistics, frequencies and scores all start from them."""
    n = V.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    return saved(T.reliable(saved(_counts(spark, sf_dir), "counts") if counts is None else counts, n, divisor), "reliable")


@query("item_label_counts", f"WITH {_COUNTS} SELECT item, label, cnt FROM counts")
def item_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query("label_incidences", f"WITH {_COUNTS} SELECT label, sum(cnt)::BIGINT AS incidences FROM counts GROUP BY label")
def label_incidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_incidences(_counts(spark, sf_dir))


@query("label_stats", f"""WITH {_COUNTS} SELECT label, round(avg(cnt), 6) AS mean, round(stddev_pop(cnt), 6) AS std, min(cnt) AS min, max(cnt) AS max,
  quantile_cont(cnt, 0.5) AS median, count(*) AS n_items FROM counts GROUP BY label""")  # fmt: skip
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_statistics(_counts(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("label_percentile", f"WITH {_COUNTS} SELECT round(quantile_cont(inc, 0.6), 6) AS percentile FROM (SELECT sum(cnt) AS inc FROM counts GROUP BY label)")
def label_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_frequency_percentile(_counts(spark, sf_dir), 0.6).select(F.round("percentile", 6).alias("percentile"))


@query("item_freq_quartiles", f"""WITH {_COUNTS}, fr AS (SELECT sum(cnt) AS freq FROM counts GROUP BY item)
SELECT quantile_cont(freq, 0.25) AS q25, quantile_cont(freq, 0.5) AS q50, quantile_cont(freq, 0.75) AS q75 FROM fr""")
def item_freq_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quartiles(T.item_frequencies(_counts(spark, sf_dir)))


def _tags_sql(divisor: float) -> str:
    return f"WITH {_COUNTS}, {_RELIABLE.format(divisor=divisor)}, {_Z} SELECT item, label, round(z, 6) AS z, round(adjusted, 6) AS adjusted, level, rank FROM tags"


def _tags(spark: SparkSession, sf_dir: str, divisor: float) -> DataFrame:
    return T.zscore_tags(_reliable(spark, sf_dir, divisor), CONFIG).withColumns({"z": F.round("z", 6), "adjusted": F.round("adjusted", 6)})


@query("zscore_tags", _tags_sql(20.0))
def zscore_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir, 20.0)


@query("zscore_tags_strict", _tags_sql(STRICT))
def zscore_tags_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only labels with at least as many incidences as there are sessions."""
    return _tags(spark, sf_dir, STRICT)


@query("tag_coverage", f"""WITH {_COUNTS}, {_RELIABLE.format(divisor=20.0)}, {_Z}, inc AS (SELECT label, sum(cnt) AS n FROM counts GROUP BY label)
SELECT count(DISTINCT item) AS tagged_items, count(*) AS tags, count(DISTINCT label) AS used_labels, round(avg(z), 6) AS mean_z,
       (SELECT count(DISTINCT item) FROM reliable) AS items, (SELECT count(DISTINCT label) FROM reliable) AS labels,
       (SELECT count(*) FROM inc) - (SELECT count(DISTINCT label) FROM reliable) AS removed_labels,
       (SELECT count(*) FROM inc WHERE n >= (SELECT quantile_cont(n, 0.6) FROM inc)) AS strong_labels FROM tags""")
def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = saved(_counts(spark, sf_dir), "counts")
    kept = _reliable(spark, sf_dir, counts=counts)
    return T.coverage(counts, kept, saved(T.zscore_tags(kept, CONFIG), "tags")).withColumn("mean_z", F.round("mean_z", 6))


@query("tag_levels", f"WITH {_COUNTS}, {_RELIABLE.format(divisor=20.0)}, {_Z} SELECT level, count(*) AS tags, round(count(*) / (SELECT count(*) FROM tags), 6) AS share FROM tags GROUP BY level")
def tag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.level_counts(T.zscore_tags(_reliable(spark, sf_dir), CONFIG)).withColumn("share", F.round("share", 6))


_PATTERNS = """pat AS (
  SELECT a.label || '+' || b.label AS pattern, 2 AS size, a.session_id FROM session_label a JOIN session_label b ON a.session_id = b.session_id AND a.label < b.label
  UNION ALL
  SELECT a.label || '+' || b.label || '+' || c.label, 3, a.session_id FROM session_label a JOIN session_label b ON a.session_id = b.session_id AND a.label < b.label
  JOIN session_label c ON c.session_id = a.session_id AND b.label < c.label
), sup AS (SELECT pattern, size, count(*) AS support FROM pat GROUP BY pattern, size HAVING count(*) >= 100),
top AS (SELECT * FROM sup ORDER BY support DESC, pattern LIMIT 10)"""


@query("frequent_patterns", f"WITH {V.LABELS_SQL}, {_PATTERNS} SELECT pattern, size, support FROM sup")
def frequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frequent_patterns(V.session_labels(spark, sf_dir), CONFIG.least_support)


@query("top_patterns", f"WITH {V.LABELS_SQL}, {_PATTERNS} SELECT pattern, size, support FROM top")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frequent_patterns(V.session_labels(spark, sf_dir), CONFIG.least_support, CONFIG.most_patterns)


_CELLS = """pc AS (SELECT item, pattern, count(*) AS cnt FROM session_items JOIN pat USING (session_id) WHERE pattern IN (SELECT pattern FROM top) GROUP BY item, pattern),
cell AS (SELECT i.item, p.pattern, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT item FROM pc) i CROSS JOIN (SELECT DISTINCT pattern FROM pc) p
         LEFT JOIN pc ON pc.item = i.item AND pc.pattern = p.pattern),
pst AS (SELECT pattern, avg(cnt) AS mean, stddev_pop(cnt) AS std FROM cell GROUP BY pattern),
pz AS (SELECT item, pattern, cnt, CASE WHEN std = 0 THEN 0.0 ELSE (cnt - mean) / std END AS z FROM cell JOIN pst USING (pattern))"""


def _pattern_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.session_labels(spark, sf_dir)
    top = T.frequent_patterns(labels, CONFIG.least_support, CONFIG.most_patterns)
    return T.pattern_zscores(T.item_pattern_counts(V.session_lines(spark, sf_dir), labels, top))


@query("pattern_zscores", f"WITH {V.ITEMS_SQL}, {V.LABELS_SQL}, {_PATTERNS}, {_CELLS} SELECT item, pattern, cnt, round(z, 5) AS z FROM pz")
def pattern_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pattern_z(spark, sf_dir).withColumn("z", F.round("z", 5))


@query("enhanced_tags", f"""WITH {_COUNTS}, {V.TAGS_SQL}, {_RELIABLE.format(divisor=20.0)}, {_Z}, {_PATTERNS}, {_CELLS},
one AS (SELECT item, string_agg(label || level, '|' ORDER BY rank) AS t FROM tags GROUP BY item),
two AS (SELECT item, string_agg(pattern || CASE WHEN z >= 1.5 THEN ' Strong Preference' ELSE ' Preference' END, '|'
        ORDER BY pattern || CASE WHEN z >= 1.5 THEN ' Strong Preference' ELSE ' Preference' END) AS t FROM pz WHERE z >= 0.5 GROUP BY item)
SELECT b.item, concat_ws('|', array_to_string(tags, '|'), one.t, two.t) AS tags FROM base_tags b LEFT JOIN one USING (item) LEFT JOIN two USING (item)""")
def enhanced_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    singles = T.zscore_tags(_reliable(spark, sf_dir), CONFIG)
    composites = _pattern_z(spark, sf_dir).withColumn("level", T.level(F.col("z"), CONFIG.levels))
    return T.enhanced(V.base_tags(spark, sf_dir), singles, composites).select("item", F.array_join("tags", "|").alias("tags"))


GRID = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]


@query("threshold_grid", f"""WITH {_COUNTS}, {_RELIABLE.format(divisor=20.0)}, {_Z}
SELECT t AS threshold, count(*) AS tags, count(DISTINCT item) AS items, count(DISTINCT label) AS labels
FROM z JOIN (SELECT unnest({GRID}::DOUBLE[]) AS t) ON z >= t GROUP BY t""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.threshold_grid(T.with_zscores(_reliable(spark, sf_dir)), GRID)


@query("parsed_labels", """WITH o AS (SELECT o_orderkey AS session_id, CASE o_orderkey % 4 WHEN 0 THEN '["' || o_orderstatus || '","' || o_orderpriority || '"]' WHEN 1 THEN 'not json' WHEN 2 THEN '{}' END AS cls, o_orderstatus AS a, o_orderpriority AS b FROM orders)
SELECT session_id, CASE WHEN session_id % 4 = 0 THEN a || '|' || b ELSE '' END AS labels FROM o""")
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = V.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.to_json(F.array("o_orderstatus", "o_orderpriority"))).when(k == 1, "not json").when(k == 2, "{}")
    return o.select(F.col("o_orderkey").alias("session_id"), F.array_join(T.parsed_labels(text), "|").alias("labels"))
