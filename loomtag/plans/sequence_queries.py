"""Sequences of the event stream and of customers' purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.operators import sequences as S
from loomtag.operators.evaluation import CATALOGUE
from loomtag.plans import views as V
from loomtag.plans.registry import query
from loomtag.scratch import cut


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collect_sequences(V.events(spark, sf_dir))


def text(c: str | Column) -> Column:
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), ",")


_S = f"WITH {V.SEQS_SQL}"


@query("sequences", f"{_S} SELECT \"user\", array_to_string(seq, ',') AS seq FROM seqs")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("user", text("seq").alias("seq"))


@query("loo_split", f"""{_S} SELECT "user", array_to_string(seq[:len(seq)-2], ',') AS train, seq[len(seq)-1] AS valid, seq[len(seq)] AS test FROM seqs""")
def loo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_one_out(seqs(spark, sf_dir)).select("user", text("train").alias("train"), "valid", "test")


@query("collapse_runs", f"""WITH {V.EVENTS_SQL} SELECT "user", item, ts FROM (SELECT *, lead(item) OVER (PARTITION BY "user" ORDER BY ts) AS nx FROM ev) WHERE nx IS NULL OR nx <> item""")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collapse_runs(V.events(spark, sf_dir)).select("user", "item", "ts")


@query("sliding_examples", f"""{_S}, p AS (SELECT "user", seq, unnest(range(1, len(seq))) AS pos FROM seqs)
SELECT "user", pos::INT AS pos, array_to_string(seq[greatest(pos - 50, 0) + 1 : pos], ',') AS history, seq[pos + 1] AS target FROM p""")
def sliding_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_examples(seqs(spark, sf_dir), 50).select("user", "pos", text("history").alias("history"), "target")


_HELD = """h AS (
  SELECT "user", 'valid' AS split, seq[greatest(len(seq) - 52, 0) + 1 : len(seq) - 2] AS history, seq[len(seq) - 1] AS target FROM seqs WHERE len(seq) >= 3
  UNION ALL SELECT "user", 'test', seq[greatest(len(seq) - 51, 0) + 1 : len(seq) - 1], seq[len(seq)] FROM seqs WHERE len(seq) >= 2)"""


@query("held_out_examples", f"{_S}, {_HELD} SELECT \"user\", split, array_to_string(history, ',') AS history, target FROM h")
def held_out_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.held_out_examples(S.leave_one_out(seqs(spark, sf_dir))).select("user", "split", text("history").alias("history"), "target")


@query("item_based", f"{_S}, {_HELD} SELECT \"user\", split, history[-1] AS history, target FROM h")
def item_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.item_based(S.held_out_examples(S.leave_one_out(seqs(spark, sf_dir)))).select("user", "split", F.get("history", F.lit(0)).alias("history"), "target")


@query("first_occurrence", f"""WITH {V.PURCHASES_SQL} SELECT "user", item, min(day) AS day FROM purchases GROUP BY "user", item""")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_occurrences(V.purchases(spark, sf_dir), order=("day", "session_id")).select("user", "item", "day")


@query("temporal_split", f"""WITH {V.EVENTS_SQL}, e AS (SELECT *, floor(epoch(ts))::DOUBLE AS tm FROM ev), b AS (SELECT min(tm) AS lo, max(tm) - min(tm) AS w FROM e)
SELECT "user", item, ts, CASE WHEN tm - lo <= w * 0.7::DOUBLE THEN 'train' WHEN tm - lo <= w * 0.9::DOUBLE THEN 'valid' ELSE 'test' END AS split FROM e, b""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.temporal_split(V.events(spark, sf_dir)).select("user", "item", "ts", "split")


@query("session_boundary_split", """WITH r AS (SELECT o_orderkey AS session_id, CASE WHEN o_orderdate >= DATE '2000-01-01' THEN 'test' WHEN o_orderkey % 10 = 9 THEN 'valid' ELSE 'train' END AS split FROM orders),
r2 AS (SELECT session_id, CASE WHEN session_id > (SELECT max(session_id) * 0.9 FROM r) THEN 'test' WHEN session_id > (SELECT max(session_id) * 0.8 FROM r) THEN 'valid' ELSE 'train' END AS split FROM r),
b AS (SELECT min(session_id) FILTER (split = 'valid') AS v, min(session_id) FILTER (split = 'test') AS t FROM r2)
SELECT o_orderkey AS session_id, CASE WHEN o_orderkey >= t THEN 'test' WHEN o_orderkey >= v THEN 'valid' ELSE 'train' END AS split FROM orders, b""")
def session_boundary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    most = orders.agg(F.max("session_id").alias("m"))
    marked = orders.withColumn("m", most.scalar())
    part = F.when(F.col("session_id") > F.col("m") * 0.9, "test").when(F.col("session_id") > F.col("m") * 0.8, "valid").otherwise("train")
    return S.boundary_split(orders, marked.select("session_id", part.alias("split"))).select("session_id", "split")


@query("dense_ids", """SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS idx FROM (SELECT DISTINCT p_name FROM part)""")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dense_ids(V.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "name", "idx")


@query("positional_split", """WITH i AS (SELECT o_orderkey AS session_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders))
SELECT session_id, idx, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train' WHEN idx < floor(n * 0.9::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM i""")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = S.dense_ids(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")), "session_id", "idx")
    return S.positional_split(ids, "idx").select("session_id", "idx", "split")


@query("next_item_examples", f"""{_S}, p AS (SELECT "user", seq, unnest(range(len(seq) - 3, len(seq))) AS k FROM seqs WHERE len(seq) > 3)
SELECT "user", (k - (len(seq) - 3))::INT AS k, array_to_string(seq[1:k], ',') AS history, seq[k + 1] AS target FROM p""")
def next_item_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.at_least(seqs(spark, sf_dir), 4)
    past = s.select("user", F.slice("seq", F.lit(1), F.size("seq") - 3).alias("seq"))
    held = s.select("user", S.last_n(F.col("seq"), 3).alias("seq"))
    return S.next_item_examples(past, held).select("user", "k", text("history").alias("history"), "target")


@query("unseen_last_items", f"""{_S}, e AS (SELECT "user", seq, unnest(range(2, len(seq) + 1)) AS k FROM seqs WHERE len(seq) >= 3),
f AS (SELECT "user", k, seq[1 : len(seq) - k] AS history, list_distinct(list_filter(seq[len(seq) - k + 1 :], lambda x: NOT list_contains(seq[1 : len(seq) - k], x))) AS targets FROM e),
g AS (SELECT * FROM f WHERE len(targets) >= 2 QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY k) = 1)
SELECT "user", array_to_string(history, ',') AS history, array_to_string(list_sort(targets), ',') AS targets FROM g WHERE len(history) >= 1""")
def unseen_last_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unseen_last_items(seqs(spark, sf_dir), 2).select("user", text("history").alias("history"), text(F.array_sort("targets")).alias("targets"))


@query("first_item_retrieval", f"""{_S} SELECT "user", seq[1] AS query, array_to_string(seq[2:], ',') AS targets FROM seqs WHERE len(list_distinct(list_filter(seq[2:], lambda x: x <> seq[1]))) >= 30""")
def first_item_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_item_retrieval(seqs(spark, sf_dir), 30).select("user", "query", text("targets").alias("targets"))


def _core_sql(k: int, rounds: int) -> str:
    out = f"WITH {V.PURCHASES_SQL}, c0 AS (SELECT DISTINCT \"user\", item FROM purchases)"
    for r in range(rounds):
        out += f""", d{r} AS (SELECT c{r}.* FROM c{r} WHERE "user" IN (SELECT "user" FROM c{r} GROUP BY "user" HAVING count(*) >= {k})),
c{r + 1} AS (SELECT d{r}.* FROM d{r} WHERE item IN (SELECT item FROM d{r} GROUP BY item HAVING count(*) >= {k}))"""
    return out + f' SELECT "user", item FROM c{rounds}'


@query("kcore", _core_sql(20, 8))
def kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20-core of distinct customers and parts; the SQL unrolls more rounds than the test data need."""
    return S.k_core(V.purchases(spark, sf_dir).select("user", "item").distinct(), 20, 20, cut)


@query("kcore_users_only", f"""WITH {V.PURCHASES_SQL}, c AS (SELECT DISTINCT "user", item FROM purchases) SELECT * FROM c WHERE "user" IN (SELECT "user" FROM c GROUP BY "user" HAVING count(*) >= 30)""")
def kcore_users_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.k_core(V.purchases(spark, sf_dir).select("user", "item").distinct(), 30, 0, cut)


@query("length_hist", f"{_S} SELECT len(seq)::INT AS length, count(*) AS users FROM seqs GROUP BY 1")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.length_histogram(seqs(spark, sf_dir))


@query("interaction_totals", f"""WITH {V.PURCHASES_SQL} SELECT count(DISTINCT "user") AS users, count(DISTINCT item) AS items, count(*) AS interactions FROM purchases""")
def interaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(V.purchases(spark, sf_dir))


@query("known_sessions", f"""{_S} SELECT "user", array_to_string(seq, ',') AS seq FROM seqs WHERE len(list_filter(seq, lambda x: x % 17 = 16)) = 0""")
def known_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users none of whose items is unknown (every seventeenth is)."""
    known = V.event_tags(spark, sf_dir).where("item % 17 <> 16").select("item").union(spark.range(0, 1).select(F.lit(0)))
    return S.only_known_sessions(seqs(spark, sf_dir), known).select("user", text("seq").alias("seq"))


@query("indexed_sequences", f"""{V.EVENT_TAGS_SQL.replace('base_tags AS', 'WITH base_tags AS', 1)}, {V.EVENTS_SQL}, ids AS (SELECT item, row_number() OVER (ORDER BY item DESC) - 1 AS idx FROM event_tags)
SELECT "user", string_agg(idx::VARCHAR, ',' ORDER BY ts, ev.item) AS seq FROM ev JOIN ids USING (item) GROUP BY "user\"""")
def indexed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = S.dense_ids(V.event_tags(spark, sf_dir).select((-F.col("item")).alias("neg")), "neg", "idx").select((-F.col("neg")).alias("item"), "idx")
    return S.indexed(seqs(spark, sf_dir), ids).select("user", text("seq").alias("seq"))


@query("joined_splits", f"{_S} SELECT \"user\", array_to_string(seq, ',') AS seq FROM seqs WHERE len(seq) > 0")
def joined_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.leave_one_out(seqs(spark, sf_dir))
    parts = [s.select("user", F.col(c).alias("seq")) for c in ("train",)] + [s.where(F.col(c).isNotNull()).select("user", F.array(c).alias("seq")) for c in ("valid", "test")]
    return S.joined_splits(*parts).select("user", text("seq").alias("seq"))


@query("skipped_items", f"""WITH {V.SEQS_SQL}, {V.TAGS_SQL} SELECT item, count(*) AS n FROM (SELECT unnest(seq) AS item FROM seqs) WHERE item NOT IN (SELECT item FROM base_tags WHERE item % 7 <> 3) GROUP BY item""")
def skipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.skipped_items(seqs(spark, sf_dir), V.event_tags(spark, sf_dir).where("item % 7 <> 3"))


@query("first_appearance_ids", f"""WITH {V.EVENTS_SQL} SELECT item, row_number() OVER (ORDER BY t, item) - 1 AS idx FROM (SELECT item, min(ts) AS t FROM ev GROUP BY item)""")
def first_appearance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_appearance_ids(V.events(spark, sf_dir), "item", "ts", "idx")


@query("interactions_with_metadata", f"""WITH {V.PURCHASES_SQL} SELECT "user", item, day FROM purchases WHERE item IN (SELECT p_partkey FROM part WHERE p_size > 20)""")
def interactions_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = V.table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("item"))
    return S.with_metadata(V.purchases(spark, sf_dir), meta).select("user", "item", "day")


@query("long_ids", """SELECT o_orderkey AS session_id, array_to_string(list_filter(string_split(o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey, ' '), lambda x: length(x) >= 3), '|') AS ids FROM orders""")
def long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")), " ")
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.array_join(S.long_ids(words, 3), "|").alias("ids"))


@query("session_window", f"""WITH {V.ITEMS_SQL}, s AS (SELECT session_id, count(*) AS n, row_number() OVER (ORDER BY session_id) - 1 AS idx FROM session_items GROUP BY session_id HAVING count(*) <= 4) SELECT session_id, idx, n FROM s WHERE idx >= 10 AND idx < 110""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sessions of at most four items the hundred from the eleventh on."""
    s = V.session_items(spark, sf_dir).groupBy("session_id").agg(F.collect_list("item").alias("seq"))
    short = S.at_most(s, 4)
    ids = S.dense_ids(short, "session_id", "idx")
    return S.window_of_sessions(ids, 10, 100, "idx").join(short, "session_id").select("session_id", "idx", F.size("seq").cast("long").alias("n"))


@query("prediction_domain", f"""WITH {V.EVENTS_SQL}, c AS (SELECT DISTINCT "user", i.item FROM ev, (SELECT DISTINCT item FROM ev) i), s AS (SELECT DISTINCT "user", item FROM ev WHERE action <> 'purchase'),
p AS (SELECT DISTINCT "user", item FROM ev WHERE action = 'purchase')
SELECT "user", item FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION SELECT "user", item FROM p""")
def prediction_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    items = S.dense_ids(e, "item", "idx")
    size = items.count()
    places = F.sequence(F.lit(0), F.lit(size - 1))  # the domain itself is the result: a row for each user and item
    items = F.broadcast(items) if size <= CATALOGUE else items.hint("merge")  # never the exploded side
    candidates = e.select("user").distinct().select("user", F.explode(places).alias("idx")).join(items, "idx").select("user", "item")
    return S.prediction_domain(candidates, e.where("action <> 'purchase'"), e.where("action = 'purchase'"))


@query("user_downsample", f"""WITH {V.EVENTS_SQL}, d AS (SELECT DISTINCT "user" FROM ev ORDER BY md5('42|' || "user"), "user" LIMIT 50) SELECT "user", item, ts FROM ev WHERE "user" IN (SELECT "user" FROM d)""")
def user_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.user_downsample(V.events(spark, sf_dir), 50).select("user", "item", "ts")


@query("block_sample", """SELECT o_orderkey AS session_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey // 25 ORDER BY md5('42|' || o_orderkey), o_orderkey) = 1""")
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_sample(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")), 25)


_KEYED = """k AS (SELECT "user", list(item ORDER BY md5('42|' || "user" || '|' || (pos - 1)), item) AS o FROM (SELECT "user", unnest(seq) AS item, unnest(range(1, len(seq) + 1)) AS pos FROM seqs) GROUP BY "user")"""


@query("masked_history", f"""{_S}, {_KEYED}, m AS (SELECT "user", o, greatest(1, floor(len(o) * 0.2::DOUBLE))::INT AS n FROM k)
SELECT "user", array_to_string(o[n + 1 :], ',') AS kept, array_to_string(o[1 : n], ',') AS hidden FROM m""")
def masked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.masked_history(seqs(spark, sf_dir)).select("user", text("kept").alias("kept"), text("hidden").alias("hidden"))


@query("shuffled_history", f"{_S}, {_KEYED} SELECT \"user\", array_to_string(o, ',') AS seq FROM k")
def shuffled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shuffled_history(seqs(spark, sf_dir)).select("user", text("seq").alias("seq"))


@query("random_history", f"""{_S} SELECT "user", array_to_string(list_transform(range(len(seq)), lambda i: ('0x' || md5('42|' || "user" || '|' || i)[1:8])::BIGINT % 100), ',') AS seq FROM seqs""")
def random_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.random_history(seqs(spark, sf_dir), 100).select("user", text("seq").alias("seq"))
