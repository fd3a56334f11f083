"""Corpora, BM25 and baselines over part tags and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.operators import baselines as P
from loomtag.operators import bm25 as B
from loomtag.operators import corpus as C
from loomtag.operators import sequences as S
from loomtag.plans import views as V
from loomtag.plans.registry import query
from loomtag.plans.sequence_queries import seqs

_T = f"WITH {V.TAGS_SQL}, edge AS (SELECT item, tag, count(*) AS w FROM (SELECT item, unnest(tags) AS tag FROM base_tags) GROUP BY item, tag)"


@query("bipartite_edges", f"{_T} SELECT item, tag, w FROM edge")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edges(V.base_tags(spark, sf_dir))


@query("tag_domain", f"{_T} SELECT tag, sum(w)::BIGINT AS n FROM edge GROUP BY tag")
def tag_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tag_domain(V.base_tags(spark, sf_dir))


@query("top_tags", f"{_T} SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM (SELECT tag, sum(w)::BIGINT AS n FROM edge GROUP BY tag) QUALIFY rank <= 10")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_tags(V.base_tags(spark, sf_dir), 10)


@query("corpus_stats", f"""{_T}, s AS (SELECT (SELECT count(*) FROM base_tags) AS items, count(DISTINCT tag) AS tags, count(*) AS edges FROM edge)
SELECT items, tags, edges, round(edges / (items * tags), 6) AS density, round(edges / tags, 6) AS items_per_tag, round(edges / items, 6) AS tags_per_item FROM s""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.statistics(V.base_tags(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("density", "items_per_tag", "tags_per_item")})


@query("tag_shapes", f"""{_T} SELECT item, array_to_string(tags[2:3], '|') AS masked, array_to_string(list_concat(tags, [item::VARCHAR, item::VARCHAR]), '|') AS with_id, array_to_string(list_transform(tags, lambda t: lower(t)), '|') AS lowered FROM base_tags""")
def tag_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.base_tags(spark, sf_dir).select(
        "item", F.array_join(C.masked_tags(F.col("tags"), 1, 2), "|").alias("masked"), F.array_join(C.with_own_id(F.col("tags"), F.col("item"), 2), "|").alias("with_id"), F.array_join(C.lowered(F.col("tags")), "|").alias("lowered")
    )


@query("corpus_aligned", f"""{_T}, i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM base_tags), a AS (SELECT * FROM base_tags WHERE item % 3 = 0), x AS (SELECT item AS idx, tags FROM base_tags WHERE item % 2 = 0)
SELECT i.item, i.idx, array_to_string(coalesce(a.tags, x.tags, []::VARCHAR[]), '|') AS tags FROM i LEFT JOIN a ON a.item = i.item LEFT JOIN x ON x.idx = i.idx""")
def corpus_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.base_tags(spark, sf_dir)
    return C.aligned(S.dense_ids(t, "item", "idx"), t.where("item % 3 = 0"), t.where("item % 2 = 0").select(F.col("item").alias("idx"), "tags")).withColumn("tags", F.array_join("tags", "|"))


@query("session_tags", f"""WITH {V.ITEMS_SQL}, {V.TAGS_SQL} SELECT session_id, string_agg(array_to_string(tags[1:3], '|'), '|' ORDER BY item) AS tags FROM session_items JOIN base_tags USING (item) GROUP BY session_id""")
def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.session_tags(V.session_items(spark, sf_dir), V.base_tags(spark, sf_dir)).withColumn("tags", F.array_join("tags", "|"))


@query("session_tags_distinct", f"""WITH {V.ITEMS_SQL}, {V.TAGS_SQL}, x AS (SELECT session_id, item, unnest(tags[1:3]) AS tag, unnest(range(3)) AS k FROM session_items JOIN base_tags USING (item)),
y AS (SELECT session_id, tag, min(item * 10 + k) AS o FROM x GROUP BY session_id, tag) SELECT session_id, string_agg(tag, '|' ORDER BY o) AS tags FROM y GROUP BY session_id""")
def session_tags_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag once, at its first place, as sessions of films have them."""
    return C.session_tags(V.session_items(spark, sf_dir), V.base_tags(spark, sf_dir), distinct=True).withColumn("tags", F.array_join("tags", "|"))


def _bm25_sql(corpus: str, k1: float = 1.5, b: float = 0.75, alpha: float | None = 0.0, floor: float | None = None) -> str:
    idf = "idf" if floor is None else f"CASE WHEN idf < 0 THEN {floor} * (SELECT avg(idf) FROM tm) ELSE idf END"
    keep = f"WHERE idf > {alpha}" if floor is None else ""
    return f"""ed AS (SELECT item, tag, count(*) AS w FROM (SELECT item, unnest(tags) AS tag FROM {corpus}) GROUP BY item, tag),
sz AS (SELECT item, len(tags) AS l FROM {corpus}), av AS (SELECT avg(l) AS a, count(*) AS n FROM sz),
tm AS (SELECT tag, count(*) AS df, ln((SELECT n FROM av) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM ed GROUP BY tag),
post AS (SELECT ed.tag, ed.item, {idf} * w * ({k1}::DOUBLE + 1) / (w + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l / a)) AS score FROM ed JOIN sz USING (item) JOIN (SELECT * FROM tm {keep}) tm USING (tag), av)"""


@query("bm25_postings", f"WITH {V.TAGS_SQL}, {_bm25_sql('base_tags')} SELECT tag, item, round(score, 6) AS score FROM post")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.postings(V.base_tags(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("bm25_floor", f"WITH {V.TAGS_SQL}, {_bm25_sql('base_tags', floor=0.25)} SELECT tag, item, round(score, 6) AS score FROM post")
def bm25_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.postings(V.base_tags(spark, sf_dir), floor=0.25).withColumn("score", F.round("score", 6))


@query("bm25_item", f"""WITH {V.EVENT_TAGS_SQL}, {_bm25_sql('event_tags')},
sc AS (SELECT q.item AS qid, p.item, round(sum(q.w * p.score), 6) AS score FROM ed q JOIN post p USING (tag) WHERE q.item % 100 = 0 GROUP BY 1, 2)
SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 10""")
def bm25_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items nearest to each item whose id is divisible by 100, among all."""
    corpus = V.event_tags(spark, sf_dir)
    classes = B.tag_classes(corpus)
    asking = classes.where("item % 100 = 0").select(F.col("item").alias("qid"), "rep")
    asks = B.item_queries(corpus.join(asking.select(F.col("rep").alias("item")).distinct().hint("merge"), "item", "left_semi"))
    best = B.best_items(asks, corpus, classes, 10).withColumnRenamed("qid", "rep")  # items of a class ask alike
    return asking.hint("merge").join(best, "rep").select("qid", "item", "score", "rank")


@query("bm25_documents", r"""WITH t AS (SELECT doc_id AS item, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS tags FROM documents), """ + _bm25_sql("t") + """,
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tag FROM benchmark),
sc AS (SELECT item_id AS qid, post.item, round(sum(score), 6) AS score FROM q JOIN post USING (tag) GROUP BY 1, 2)
SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 10""")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that answer each benchmark passage best."""
    def terms(c):
        return F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text")
    asks = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(terms(F.col("text")))).alias("tag")).withColumn("weight", F.lit(1.0))
    return B.best_documents(asks, docs, terms(F.col("text")), 10)


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.leave_one_out(seqs(spark, sf_dir))
    return s.select(F.col("user").alias("qid"), "train").withColumnRenamed("train", "seq")


_H = f"""WITH {V.SEQS_SQL}, hist AS (SELECT "user" AS qid, seq[1 : len(seq) - 2] AS seq FROM seqs)"""


def _weights_sql(kind: str, reduce: str, most: int | None = None) -> str:
    cut = "seq" if most is None else f"seq[greatest(len(seq) - {most}, 0) + 1 :]"
    longest = "(SELECT max(len(seq)) FROM hc)" if most is None else str(most)
    w = {"linear": "(pos + 1)::DOUBLE", "log2": "1 / log2(2 + (n - 1 - pos)::DOUBLE)", "exp": f"pow(10::DOUBLE, pos * 10::DOUBLE / ({longest} - 1))", "": "1.0::DOUBLE"}[kind]
    return f"""hc AS (SELECT qid, {cut} AS seq FROM hist), lg AS (SELECT qid, len(seq) AS n, unnest(seq) AS item, unnest(range(len(seq))) AS pos FROM hc),
wt AS (SELECT qid, item, {reduce}({w}) AS weight FROM lg GROUP BY qid, item)"""


for _name, _kind, _reduce, _sql_reduce, _most in (
    ("query_weights_linear", "linear", "union", "max", None), ("query_weights_log2", "log2", "sum", "sum", 20), ("query_weights_exp", "exp", "union", "max", 30), ("query_weights_plain", None, "sum", "sum", None),
):

    def _weights(spark: SparkSession, sf_dir: str, kind=_kind, reduce=_reduce, most=_most) -> DataFrame:
        out = B.history_weights(_histories(spark, sf_dir), reduce, kind, most)
        return out.select("qid", "item", F.format_string("%.4e", "weight").alias("weight") if kind == "exp" else F.round("weight", 6).alias("weight"))

    _shown = "printf('%.4e', weight)" if _kind == "exp" else "round(weight, 6)"
    query(_name, f"{_H}, {_weights_sql(_kind or '', _sql_reduce, _most)} SELECT qid, item, {_shown} AS weight FROM wt")(_weights)


@query("query_last", f"{_H} SELECT qid, seq[len(seq)] AS item, 1.0::DOUBLE AS weight FROM hist")
def query_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.history_weights(_histories(spark, sf_dir), "last")


@query("bm25_user", f"""{_H}, {V.EVENT_TAGS_SQL}, {_bm25_sql('event_tags')}, {_weights_sql('log2', 'max', 20)},
qt AS (SELECT qid, tag, sum(weight * w) AS weight FROM wt JOIN ed USING (item) WHERE qid % 100 = 0 GROUP BY qid, tag),
sc AS (SELECT qid, item, round(sum(weight * score), 6) AS score FROM qt JOIN post USING (tag) GROUP BY qid, item)
SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 20""")
def bm25_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all items for each user whose id is divisible by 100."""
    corpus = V.event_tags(spark, sf_dir)
    asks = B.history_queries(B.history_weights(_histories(spark, sf_dir).where("qid % 100 = 0"), "union", "log2", 20), corpus)
    return B.best_items(asks, corpus, B.tag_classes(corpus), 20)


@query("popular", f"WITH {V.EVENTS_SQL} SELECT item, count(*) AS score FROM ev GROUP BY item")
def popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.popularity(V.events(spark, sf_dir))


@query("popular_candidates", f"""WITH {V.EVENTS_SQL}, p AS (SELECT item, count(*) AS score FROM ev GROUP BY item ORDER BY score DESC, item LIMIT 10)
SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM (SELECT DISTINCT "user" AS qid FROM ev), p""")
def popular_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    return P.for_queries(e.select(F.col("user").alias("qid")).distinct(), P.popularity(e), 10)


@query("pop_scaled", f"""{_H}, x AS (SELECT qid, seq, unnest(range(1, len(seq))) AS pos FROM hist), t AS (SELECT seq[pos + 1] AS item FROM x UNION ALL SELECT seq[1] FROM x WHERE pos = 1),
c AS (SELECT item, count(*) AS cnt FROM t GROUP BY item) SELECT item, cnt, round(cnt / (SELECT max(cnt) FROM c), 6) AS score FROM c""")
def pop_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scaled_popularity(S.sliding_examples(_histories(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query("browsed", f"{_H}, lg AS (SELECT qid, unnest(seq) AS item, unnest(range(len(seq))) AS pos FROM hist) SELECT qid, item, (max(pos) + 1)::INT AS score FROM lg GROUP BY qid, item")
def browsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.browsed_scores(_histories(spark, sf_dir))


_MOVES = """mv AS (SELECT item AS prev, lead(item) OVER (PARTITION BY "user" ORDER BY ts) AS nx FROM ev), mc AS (SELECT prev, nx, count(*) AS n FROM mv WHERE nx IS NOT NULL GROUP BY prev, nx),
mp AS (SELECT prev, nx, n / (sum(n) OVER (PARTITION BY prev) + 1e-10) AS p FROM mc)"""


@query("transitions", f"WITH {V.EVENTS_SQL}, {_MOVES} SELECT prev, nx AS next, round(p, 6) AS p FROM mp")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.transitions(V.events(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query("markov", f"""{_H}, {_MOVES}, {_weights_sql('log2', 'max', 20)}, sc AS (SELECT qid, nx AS item, round(sum(weight * p), 6) AS score FROM wt JOIN mp ON wt.item = mp.prev GROUP BY qid, nx)
SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 10""")
def markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.markov_scores(B.history_weights(_histories(spark, sf_dir), "union", "log2", 20), P.transitions(V.events(spark, sf_dir)))
    return B.top_n(scores.withColumn("score", F.round("score", 6)), 10)


@query("random_rank", f"""WITH {V.EVENTS_SQL}, c AS (SELECT DISTINCT "user" AS qid, item FROM ev) SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY md5('42|' || qid || '|' || item), item) AS rank FROM c""")
def random_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.random_ranks(V.events(spark, sf_dir).select(F.col("user").alias("qid"), "item").distinct())
