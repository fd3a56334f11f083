"""Round trips through the readers and writers, and the threshold search.

Each query writes what the driver's tables hold in an input shape, into the folder
the cluster shares, and reads it with the reader of that shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.operators import corpus as C
from loomtag.operators import evaluation as E
from loomtag.operators import sequences as S
from loomtag.operators import tagging as T
from loomtag.plans import views as V
from loomtag.plans.registry import query
from loomtag.plans.sequence_queries import _HELD, seqs, text
from loomtag.plans.tagging_queries import _COUNTS, _RELIABLE, _Z, _reliable
from loomtag.scratch import saved
from loomtag.scratch import new_path as scratch
from loomtag.sources import readers as R
from loomtag.sources import writers as W


@query("read_ragged", f"WITH {V.ITEMS_SQL} SELECT string_agg(item || ', x', '|' ORDER BY item) AS items FROM session_items GROUP BY session_id")
def read_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ragged")
    cell = F.concat(F.lit('"'), F.col("item").cast("string"), F.lit(', x"'))
    lines = V.session_items(spark, sf_dir).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", cell.alias("c")))), lambda x: x["c"]).alias("c"))
    lines.select(F.concat(F.array_join("c", ","), F.lit(",,")).alias("value")).write.text(path)
    return R.ragged_sessions(spark, path).select(F.array_join("items", "|").alias("items"))


@query("read_classified", """SELECT o_orderpriority || '|' || o_orderstatus AS labels, o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '|' || o_custkey ELSE '' END AS items FROM orders""")
def read_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "classified")
    o = V.table(spark, sf_dir, "orders")
    o.select(F.to_json(F.array("o_orderpriority", "o_orderstatus")).alias("Class"), F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("b"), F.lit(None).cast("string").alias("c")).write.csv(path, header=True, escape='"')
    return R.classified_sessions(spark, path, 3).select(F.array_join(T.parsed_labels(F.col("class")), "|").alias("labels"), F.array_join("items", "|").alias("items"))


@query("read_tags", f"WITH {V.TAGS_SQL} SELECT item::VARCHAR AS item, array_to_string(tags, '|') AS tags FROM base_tags")
def read_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written as JSON objects of a few hundred items each, as id-keyed dictionaries come."""
    path = scratch(spark, "tags")
    t = V.base_tags(spark, sf_dir)
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("item").cast("string"), "tags")))
    objects = t.groupBy(F.floor(F.col("item") / 500).alias("file")).agg(F.to_json(entries).alias("value"))
    objects.repartition("file").write.option("maxRecordsPerFile", 1).partitionBy("file").text(path)
    return R.tag_dictionary(spark, f"{path}/*").select("item", F.array_join("tags", "|").alias("tags"))


@query("read_sequences", f"""WITH {V.SEQS_SQL} SELECT "user"::VARCHAR AS "user", array_to_string(seq, ',') AS seq FROM seqs""")
def read_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sequences")
    s = seqs(spark, sf_dir)
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("user").cast("string"), "seq")))
    s.groupBy(F.pmod("user", F.lit(7)).alias("file")).agg(F.to_json(entries).alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("file").text(path)
    return R.sequence_dictionary(spark, f"{path}/*").select("user", F.array_join("seq", ",").alias("seq"))


@query("read_interactions", f"""WITH {V.SEQS_SQL} SELECT "user", array_to_string(seq, ',') AS seq FROM seqs""")
def read_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed interactions from one CSV per split, united, sorted and collected per user."""
    path = scratch(spark, "interactions")
    e = V.events(spark, sf_dir).select(F.col("ts").cast("string").alias("timestamp"), F.col("item").alias("movieId"), F.col("user").alias("userId"))
    for k, part in enumerate(("train", "val", "test")):
        e.where(F.col("movieId") % 3 == k).write.csv(f"{path}/{part}", header=True)
    got = None
    for part in ("train", "val", "test"):
        one = R.interactions(spark, f"{path}/{part}", "userId", "movieId", "timestamp")
        got = one if got is None else got.unionByName(one)
    return S.collect_sequences(got).select("user", text("seq").alias("seq"))


@query("read_list_literals", f"""WITH {V.SEQS_SQL} SELECT "user"::VARCHAR AS "user", len(seq)::INT AS n, list_sum(seq)::BIGINT AS total FROM seqs""")
def read_list_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lists")
    seqs(spark, sf_dir).select("user", F.to_json("seq").alias("items")).write.csv(path, header=True, escape='"')
    return R.list_literals(spark, path, "items").select("user", F.size("items").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("write_examples", f"""WITH {V.SEQS_SQL}, {_HELD} SELECT "user"::VARCHAR AS "user", split, array_to_string(history, ' ') AS history, target::VARCHAR AS target FROM h""")
def write_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "examples")
    W.examples(S.held_out_examples(S.leave_one_out(seqs(spark, sf_dir))), path)
    out = None
    for split in ("valid", "test"):
        part = R.atomic_interactions(spark, f"{path}/split={split}").select("user", F.lit(split).alias("split"), F.array_join("history", " ").alias("history"), "target")
        out = part if out is None else out.unionByName(part)
    return out


@query("read_candidates", f"""WITH {V.SEQS_SQL} SELECT "user"::VARCHAR AS "user", array_to_string(seq[1:5], ',') AS items FROM seqs""")
def read_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "candidates")
    s = seqs(spark, sf_dir)
    s.select("user", F.array_join(F.transform(F.slice("seq", 1, 5), lambda x: x.cast("string")), " ").alias("items")).write.csv(path, sep="\t")
    return R.candidate_lists(spark, path).select("user", F.array_join("items", ",").alias("items"))


@query("read_ratings", """SELECT DISTINCT 'p' || l_partkey AS item, 's' || l_suppkey AS "user", l_quantity::DOUBLE AS rating, l_orderkey AS time FROM lineitem""")
def read_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ratings")
    lines = V.table(spark, sf_dir, "lineitem").select(F.concat_ws(",", F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), "l_quantity", "l_orderkey").alias("value"))
    lines.union(lines.limit(50)).union(lines.limit(5).select(F.lit("broken,line,x,y"))).write.text(path)
    return R.ratings(spark, path)


@query("read_metadata", """SELECT p_partkey::VARCHAR AS item, p_name || ' x' AS title, p_brand AS brand FROM part WHERE p_partkey % 10 <> 0""")
def read_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metadata")
    p = V.table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.concat("p_name", F.lit("\tx")))
    p.select(F.col("p_partkey").cast("string").alias("asin"), title.alias("title"), F.col("p_brand").alias("brand"), F.array("p_type").alias("category")).write.option("compression", "gzip").json(path)
    return R.item_metadata(spark, path).select("item", "title", "brand")


@query("read_vectors", """SELECT vec_id AS item, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings""")
def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "vectors")
    V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")).write.parquet(path)
    return R.vectors(spark, path).select("item", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("read_answer_log", """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'candidates' ELSE 'answer' END AS kind, p_brand || '|' || p_type AS items FROM part WHERE p_partkey % 5 <> 0""")
def read_answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "log")
    p, k = V.table(spark, sf_dir, "part"), F.col("p_partkey")
    body = F.concat(F.lit(" ['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))
    p.select(F.when(k % 5 == 0, F.concat(F.lit("INFO other"), body)).otherwise(F.concat(F.lit("INFO Here are "), F.when(k % 2 == 0, "candidates:").otherwise("answer:"), body)).alias("value")).write.text(path)
    return R.answer_log(spark, path).select("kind", F.array_join("items", "|").alias("items"))


@query("write_item_texts", """SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR AS idx, p_brand || ' ' || p_type || ' ' || p_name || '.' AS text FROM part""")
def write_item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "texts")
    t = V.base_tags(spark, sf_dir)
    ids = S.dense_ids(t, "item", "idx").join(t, "item")
    W.item_texts(ids.select("idx", F.concat(F.array_join("tags", "\t"), F.lit(".")).alias("text")), path)
    return spark.read.csv(path, sep="\t", header=True)


@query("write_labelled", f"""WITH {V.LABELS_SQL}, {V.ITEMS_SQL}, x AS (SELECT session_id, array_to_string(list(item ORDER BY item), '|') AS items FROM session_items GROUP BY session_id)
SELECT array_to_string(labels, '|') AS labels, items, count(*) AS n FROM session_labels JOIN x USING (session_id) GROUP BY 1, 2""")
def write_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 1 to many items, written with one cell for each and read back."""
    path = scratch(spark, "labelled")
    items = V.session_items(spark, sf_dir).groupBy("session_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    width = W.labelled_sessions(V.session_labels(spark, sf_dir).join(items, "session_id").select("labels", "items"), path)
    got = R.classified_sessions(spark, path, width).select(F.array_join(T.parsed_labels(F.col("class")), "|").alias("labels"), F.array_join("items", "|").alias("items"))
    return got.groupBy("labels", "items").agg(F.count("*").alias("n"))


@query("write_tags", f"WITH {V.TAGS_SQL} SELECT item, array_to_string(tags, '|') AS tags FROM base_tags")
def write_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tagtable")
    t = V.base_tags(spark, sf_dir)
    W.tag_table(t, path, "json")
    return spark.read.schema(t.schema).json(path).withColumn("tags", F.array_join("tags", "|"))


@query("write_results", """WITH o AS (SELECT p_brand AS hash, count(*) AS value FROM part GROUP BY 1), n AS (SELECT p_brand AS hash, count(*) * 10 AS value FROM part WHERE p_brand > 'Brand#2' GROUP BY 1)
SELECT hash, value FROM o WHERE hash NOT IN (SELECT hash FROM n) UNION ALL SELECT hash, value FROM n""")
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = scratch(spark, "results"), scratch(spark, "results")
    part = V.table(spark, sf_dir, "part")
    W.upsert_results(spark, None, part.groupBy(F.col("p_brand").alias("hash")).agg(F.count("*").alias("value")), first)
    return W.upsert_results(spark, first, part.where("p_brand > 'Brand#2'").groupBy(F.col("p_brand").alias("hash")).agg((F.count("*") * 10).alias("value")), second)




@query("read_items", """SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_size::DOUBLE AS size, p_brand || '|' || p_type AS tags FROM part""")
def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item features in a file whose header gives the types of its fields."""
    path = scratch(spark, "items")
    p = V.table(spark, sf_dir, "part")
    p.select(F.col("p_partkey").alias("item_id:token"), F.col("p_name").alias("title:token"), F.col("p_size").alias("size:float"), F.concat_ws(" ", "p_brand", "p_type").alias("tags:token_seq")).write.csv(path, sep="\t", header=True)
    return R.atomic_items(spark, path).withColumn("tags", F.array_join("tags", "|"))


@query("read_event_frame", f"WITH {V.EVENTS_SQL} SELECT \"user\", count(*) AS n, max(item) AS item FROM ev GROUP BY \"user\"")
def read_event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "frame")
    V.events(spark, sf_dir).write.parquet(path)
    return R.event_frame(spark, path).groupBy("user").agg(F.count("*").alias("n"), F.max("item").alias("item"))


@query("read_results", """SELECT config, split, value FROM (SELECT p_brand AS config, p_type AS split, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY split ORDER BY value DESC, config) = 1""")
def read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each split, from result tables of two runs."""
    path = scratch(spark, "results")
    r = V.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("config"), F.col("p_type").alias("split")).agg(F.round(F.avg("p_retailprice"), 4).alias("value"))
    for run in (0, 1):
        r.where(F.pmod(F.length("config"), F.lit(2)) == run).write.mode("append").csv(path, header=True)
    return E.best_rows(R.results(spark, path, "config string, split string, value double"), "value", ("split",))


@query("write_id_map", """SELECT p_partkey::VARCHAR AS item, (row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR AS idx FROM part""")
def write_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    W.id_map(S.dense_ids(V.base_tags(spark, sf_dir), "item", "idx"), path)
    return spark.read.csv(path, sep="\t", schema="item string, idx string")


@query("named_items", f"""WITH {V.ITEMS_SQL} SELECT DISTINCT session_id, item FROM session_items JOIN part ON item = p_partkey WHERE p_size % 5 <> 0""")
def named_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of sessions read as lists of padded names with repeats and blanks, looked up by name."""
    names = V.table(spark, sf_dir, "part").where("p_size % 5 <> 0").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("item"))
    name = F.concat(F.lit(" part "), F.col("item").cast("string"), F.lit(" "))
    cells = V.session_lines(spark, sf_dir).groupBy("session_id").agg(F.collect_list(name).alias("c"))
    cells = cells.select("session_id", F.concat("c", F.array(F.lit(" "), F.lit("nan"), F.lit(None)), "c").alias("c"))
    return T.known_items(cells.select("session_id", F.explode(T.distinct_items(F.col("c"))).alias("name")), names).select("session_id", "item")


#: Negatives of a query of the search.
SEARCH_NEGATIVES = 20


def _search_stage(k: int, thresholds: str) -> str:
    """nd{k} (t, ndcg): the metric at the given thresholds."""
    return f"""th{k} AS MATERIALIZED ({thresholds}),
nt{k} AS (SELECT t, item, label || ' Preference' AS tag FROM z0 JOIN adj0 USING (item) JOIN th{k} ON z >= t QUALIFY row_number() OVER (PARTITION BY t, item ORDER BY z + adjustment DESC, label) <= 6),
cp{k} AS MATERIALIZED (SELECT t, item, tag, count(*) AS w FROM (SELECT t, item, unnest(tags) AS tag FROM base_tags, th{k} UNION ALL SELECT nt{k}.t, nt{k}.item, nt{k}.tag FROM nt{k} SEMI JOIN base_tags USING (item)) GROUP BY ALL),
sz{k} AS (SELECT t, item, sum(w) AS l FROM cp{k} GROUP BY t, item), av{k} AS (SELECT t, avg(l) AS a, count(*) AS n FROM sz{k} GROUP BY t),
tm{k} AS (SELECT t, tag, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM cp{k} JOIN av{k} USING (t) GROUP BY t, tag),
sc{k} AS (SELECT cp.t, c.qid, c.item, round(sum(q.w * idf * cp.w * 2.5::DOUBLE / (cp.w + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 6) AS score
  FROM cand c JOIN cp{k} cp USING (item) JOIN (SELECT * FROM tm{k} WHERE idf > 0) m ON m.t = cp.t AND m.tag = cp.tag JOIN sz{k} sz ON sz.t = cp.t AND sz.item = cp.item JOIN av{k} av ON av.t = cp.t JOIN ask ON ask.qid = c.qid JOIN cp{k} q ON q.t = cp.t AND q.item = ask.item AND q.tag = cp.tag GROUP BY cp.t, c.qid, c.item),
rk{k} AS (SELECT t, c.qid, c.is_pos, row_number() OVER (PARTITION BY t, c.qid ORDER BY coalesce(s.score, 0) DESC, md5('42|' || c.qid || '|' || c.item)) AS rank FROM cand c CROSS JOIN th{k} LEFT JOIN sc{k} s USING (t, qid, item)),
nd{k} AS MATERIALIZED (SELECT t, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg FROM rk{k} WHERE is_pos = 1 GROUP BY t)"""


def _search_sql(rounds: int = 7) -> str:
    """Each round halves the range by the metric at its ends, and adds the metric at the new middle: no other threshold is scored. Seven rounds reach the tolerance."""
    stages = ["bi1 AS (SELECT -2.0::DOUBLE AS l, 2.0::DOUBLE AS r)", _search_stage(1, "SELECT unnest([l, (l + r) / 2, r]) AS t FROM bi1"), "all1 AS MATERIALIZED (SELECT * FROM nd1)"]
    for k in range(2, rounds + 1):
        b, known = f"bi{k - 1}", f"all{k - 1}"
        stages += [
            f"bi{k} AS MATERIALIZED (SELECT CASE WHEN x.ndcg >= y.ndcg THEN l ELSE (l + r) / 2 END AS l, CASE WHEN x.ndcg >= y.ndcg THEN (l + r) / 2 ELSE r END AS r FROM {b} JOIN {known} x ON x.t = l JOIN {known} y ON y.t = r)",
            _search_stage(k, f"SELECT (l + r) / 2 AS t FROM bi{k}"), f"all{k} AS MATERIALIZED (SELECT * FROM {known} UNION ALL SELECT * FROM nd{k})",
        ]
    return f"""WITH {_COUNTS}, {V.TAGS_SQL}, {V.ONLY_PURCHASES_SQL}, {_RELIABLE.format(divisor=20.0)}, {_Z}, z0 AS MATERIALIZED (SELECT * FROM z), adj0 AS MATERIALIZED (SELECT * FROM adj),
sq AS (SELECT "user" AS qid, list(item ORDER BY day, item) AS seq FROM purchases GROUP BY "user" HAVING count(*) >= 3), pos AS MATERIALIZED (SELECT qid, seq[len(seq) - 1] AS item FROM sq), ask AS MATERIALIZED (SELECT qid, seq[len(seq) - 2] AS item FROM sq),
it AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS size FROM part), size AS (SELECT max(size) AS size FROM it),
dr AS (SELECT qid, draw, ('0x' || md5('42|valid|' || qid || '|' || draw)[1:15])::BIGINT % size AS idx FROM (SELECT qid, size, unnest(range({8 * SEARCH_NEGATIVES + 64})) AS draw FROM pos, size WHERE size > {4 * SEARCH_NEGATIVES})),
fr2 AS (SELECT qid, item, '' AS h, min(draw) AS d FROM dr JOIN it USING (idx) GROUP BY qid, item UNION ALL SELECT qid, it.item, md5('42|valid|' || qid || '|' || it.item), 0 FROM pos, it WHERE it.size <= {4 * SEARCH_NEGATIVES}),
cand AS MATERIALIZED (SELECT qid, item, 1 AS is_pos FROM pos UNION ALL SELECT qid, item, 0 FROM (SELECT * FROM fr2 ANTI JOIN pos USING (qid, item) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY h, d, item) <= {SEARCH_NEGATIVES})),
{(',' + chr(10)).join(stages)}
SELECT t AS threshold, ndcg, t = (SELECT t FROM all{rounds} ORDER BY ndcg DESC, t LIMIT 1) AS best FROM all{rounds}"""


@query("threshold_search", _search_sql())
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bisection for the threshold whose tags retrieve best: NDCG@10 of each customer's last part but one, among 20 others, asked for by the part before it.

    Counts, candidates and base tags are made once; a threshold costs tags, an index
    and the scores of the candidates. Returns all evaluated thresholds and marks the best.
    """
    z, base = _reliable(spark, sf_dir), V.base_tags(spark, sf_dir)
    s = saved(S.leave_one_out(S.collect_sequences(V.purchases(spark, sf_dir), order="day")).where(F.size("seq") >= 3).select(F.col("user").alias("qid"), "valid", F.get("train", F.size("train") - 1).alias("last")), "asks")
    pos = s.select("qid", F.col("valid").alias("item"))
    drawn = E.sampled_candidates(pos, E.negatives(pos, S.dense_ids(base, "item", "idx"), SEARCH_NEGATIVES, split="valid"))
    items = saved(T.threshold_items(base, z), "items")
    lists = saved(E.candidate_lists(drawn, s.select("qid", F.col("last").alias("item")), items), "lists")

    def ndcg(t: float) -> float:
        return E.listed_ndcg(lists, items, lambda base, labels: T.threshold_tags(base, labels, t), 10).select(F.round("ndcg", 6)).first()[0] or 0.0

    best, seen = T.bisect_threshold(ndcg)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(v).alias("ndcg"), F.lit(t == best).alias("best")) for t, v in seen.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


@query("best_per_group", f"WITH {V.TAGS_SQL}, e AS (SELECT item % 10 AS g, tag, count(*) AS n FROM (SELECT item, unnest(tags) AS tag FROM base_tags) GROUP BY 1, 2) SELECT g, tag, n FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, tag) = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.edges(V.base_tags(spark, sf_dir)).groupBy((F.col("item") % 10).alias("g"), "tag").agg(F.sum("w").alias("n"))
    return E.best_rows(e, "n", ("g",), "tag")
