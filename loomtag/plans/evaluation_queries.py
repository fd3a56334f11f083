"""Evaluation, graph ranking and similarity over the event stream, part tags and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtag.operators import baselines as P
from loomtag.operators import bm25 as B
from loomtag.operators import corpus as C
from loomtag.operators import evaluation as E
from loomtag.operators import graph as G
from loomtag.operators import sequences as S
from loomtag.operators import similarity as N
from loomtag.plans import views as V
from loomtag.plans.ranking_queries import _H, _MOVES, _bm25_sql, _histories, _weights_sql
from loomtag.plans.registry import query
from loomtag.plans.sequence_queries import seqs
from loomtag.scratch import cut, saved


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_one_out(seqs(spark, sf_dir)).select(F.col("user").alias("qid"), F.col("test").alias("item"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, idx): all items of the events, numbered."""
    return S.dense_ids(V.events(spark, sf_dir), "item", "idx")


_POS = """pos AS (SELECT "user" AS qid, seq[len(seq)] AS item FROM seqs)"""
_NEG = """dom AS (SELECT qid, i.item FROM (SELECT DISTINCT "user" AS qid FROM ev), (SELECT DISTINCT item FROM ev) i),
neg AS (SELECT qid, item FROM (SELECT d.*, row_number() OVER (PARTITION BY d.qid ORDER BY md5('42|test|' || d.qid || '|' || d.item), d.item) AS r
        FROM dom d ANTI JOIN pos p ON d.qid = p.qid AND d.item = p.item) WHERE r <= 50),
cand AS (SELECT qid, item, 1 AS is_pos FROM pos UNION ALL SELECT qid, item, 0 FROM neg)"""
_RANK = """rk AS (SELECT c.qid, c.item, c.is_pos, coalesce(s.score, 0)::DOUBLE AS score,
  row_number() OVER (PARTITION BY c.qid ORDER BY coalesce(s.score, 0)::DOUBLE DESC, md5('42|' || c.qid || '|' || c.item)) AS rank
  FROM cand c LEFT JOIN sc s ON c.qid = s.qid AND c.item = s.item)"""
_METRICS = """ks AS (SELECT unnest([1, 5, 10, 20]) AS k), qm AS (
  SELECT qid, k, count(*) FILTER (rank <= k) / least(count(*), k) AS hr, coalesce(sum(1.0::DOUBLE / rank) FILTER (rank <= k), 0) AS mrr,
         coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= k), 0) / list_sum(list_transform(range(1, least(count(*), k) + 1), lambda r: 1 / log2(r + 1.0::DOUBLE))) AS ndcg
  FROM rk, ks WHERE is_pos = 1 GROUP BY qid, k)"""
_BASE = f"{_H}, {_POS}, {_NEG}"
_POPULAR = "sc AS (SELECT d.qid, d.item, p.score FROM dom d JOIN (SELECT item, count(*) AS score FROM ev GROUP BY item) p USING (item))"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all users, written once for the scorers and grids that rank them."""
    pos = _positives(spark, sf_dir)
    return saved(E.sampled_candidates(pos, E.negatives(pos, _catalogue(spark, sf_dir), 50)), "candidates")


def _popular_scores(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    return candidates.select("qid", "item").join(P.popularity(V.events(spark, sf_dir)), "item")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in ("hr", "mrr", "ndcg")})


@query("neg_samples", f"{_BASE} SELECT qid, item FROM neg")
def neg_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.negatives(_positives(spark, sf_dir), _catalogue(spark, sf_dir), 50)


@query("neg_samples_parts", f"""WITH {V.PURCHASES_SQL}, pos AS (SELECT DISTINCT "user" AS qid, item FROM purchases), it AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS size FROM part),
q AS (SELECT qid, count(*) AS p FROM pos GROUP BY qid), sz AS (SELECT max(size) AS size FROM it),
dn AS (SELECT qid FROM q, sz WHERE size <= 80 OR p * 4 >= size),
dr AS (SELECT qid, draw, ('0x' || md5('42|test|' || qid || '|' || draw)[1:15])::BIGINT % size AS idx FROM (SELECT qid, size, unnest(range(224)) AS draw FROM q, sz WHERE qid NOT IN (SELECT qid FROM dn))),
f AS (SELECT qid, item, '' AS h, min(draw) AS d FROM dr JOIN it USING (idx) GROUP BY qid, item UNION ALL SELECT qid, item, md5('42|test|' || qid || '|' || item), 0 FROM dn, it)
SELECT qid, item FROM f ANTI JOIN pos USING (qid, item) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY h, d, item) <= 20""")
def neg_samples_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 parts that a customer never ordered, for every customer."""
    own = V.purchases(spark, sf_dir).select(F.col("user").alias("qid"), "item")
    return E.negatives(own, S.dense_ids(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), "item", "idx"), 20)


@query("random_candidates", f"""WITH {V.SEQS_SQL}, it AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM ev)),
a AS (SELECT "user" AS qid, item, md5('7|candidates|' || "user" || '|' || item) AS h FROM (SELECT DISTINCT "user" FROM ev), it)
SELECT qid, string_agg(item::VARCHAR, ',' ORDER BY h, item) AS items FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY h, item) <= 30) GROUP BY qid""")
def random_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 items drawn for each user from the whole catalogue."""
    users = V.events(spark, sf_dir).select(F.col("user").alias("qid")).distinct()
    return E.random_candidates(users, _catalogue(spark, sf_dir), 30, 7).select("qid", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("ranking_metrics", f"{_BASE}, {_POPULAR}, {_RANK}, {_METRICS} SELECT k, round(avg(hr), 6) AS hr, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM qm GROUP BY k")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return _rounded(E.mean_metrics(E.query_metrics(E.ranked(c, _popular_scores(spark, sf_dir, c)))))


@query("weighted_metrics", f"""{_BASE}, {_POPULAR}, {_RANK}, {_METRICS}, w AS (SELECT "user" AS qid, len(seq)::DOUBLE AS weight FROM seqs)
SELECT k, round(sum(hr * weight) / sum(weight), 6) AS hr, round(sum(mrr * weight) / sum(weight), 6) AS mrr, round(sum(ndcg * weight) / sum(weight), 6) AS ndcg FROM qm JOIN w USING (qid) GROUP BY k""")
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    w = seqs(spark, sf_dir).select(F.col("user").alias("qid"), F.size("seq").cast("double").alias("weight"))
    return _rounded(E.mean_metrics(E.query_metrics(E.ranked(c, _popular_scores(spark, sf_dir, c))), weights=w))


@query("recall_ndcg", f"""{_BASE}, {_POPULAR}, {_RANK}, m AS (SELECT qid, count(*) FILTER (rank <= 10) AS h, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS d FROM rk WHERE is_pos = 1 GROUP BY qid)
SELECT round(sum(h), 6)::DOUBLE AS recall_sum, round(avg(h), 6) AS recall_mean, round(sum(d), 6) AS ndcg_sum, round(avg(d), 6) AS ndcg_mean, count(*) AS queries FROM m""")
def recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    out = E.recall_ndcg(E.ranked(c, _popular_scores(spark, sf_dir, c)), 10)
    return out.withColumns({m: F.round(m, 6) for m in ("recall_sum", "recall_mean", "ndcg_sum", "ndcg_mean")})


@query("metrics_by_negatives", f"""{_BASE}, {_POPULAR}, sz AS (SELECT unnest([10, 50]) AS n_neg), ng AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY md5('42|test|' || qid || '|' || item), item) AS r FROM neg),
cd AS (SELECT n_neg, qid, item, 1 AS is_pos FROM pos, sz UNION ALL SELECT n_neg, qid, item, 0 FROM ng, sz WHERE r <= n_neg),
rn AS (SELECT c.n_neg, c.qid, c.is_pos, row_number() OVER (PARTITION BY c.n_neg, c.qid ORDER BY coalesce(s.score, 0)::DOUBLE DESC, md5('42|' || c.qid || '|' || c.item)) AS rank FROM cd c LEFT JOIN sc s ON c.qid = s.qid AND c.item = s.item)
SELECT n_neg, k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS hr, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= k THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg
FROM rn, (SELECT unnest([1, 5, 10, 20]) AS k) WHERE is_pos = 1 GROUP BY n_neg, k""")
def metrics_by_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for several numbers of negatives; the smaller samples begin the larger ones."""
    pos, items = _positives(spark, sf_dir), _catalogue(spark, sf_dir)
    drawn, out = cut(E.negatives(pos, items, 50, order=True)), None
    for n in (10, 50):
        c = E.sampled_candidates(pos, drawn.where(F.col("_r") <= n))
        m = _rounded(E.mean_metrics(E.query_metrics(E.ranked(c, _popular_scores(spark, sf_dir, c))))).select(F.lit(n).alias("n_neg"), "k", "hr", "mrr", "ndcg")
        out = m if out is None else out.unionByName(m)
    return out


_SCORERS = f"""{_BASE}, {V.EVENT_TAGS_SQL}, {_bm25_sql('event_tags')}, {_weights_sql('log2', 'max', 20)}, {_MOVES},
qt AS (SELECT qid, tag, sum(weight * w) AS weight FROM wt JOIN ed USING (item) GROUP BY qid, tag),
lg2 AS (SELECT qid, unnest(seq) AS item, unnest(range(len(seq))) AS pos FROM hist),
sall AS (SELECT 'bm25' AS config, qid, item, round(sum(weight * score), 6) AS score FROM qt JOIN post USING (tag) GROUP BY qid, item
  UNION ALL SELECT 'markov', qid, nx, round(sum(weight * p), 6) FROM wt JOIN mp ON wt.item = mp.prev GROUP BY qid, nx
  UNION ALL SELECT 'popular', d.qid, d.item, p.score FROM dom d JOIN (SELECT item, count(*) AS score FROM ev GROUP BY item) p USING (item)
  UNION ALL SELECT 'browsed', qid, item, max(pos) + 1 FROM lg2 GROUP BY qid, item),
rc AS (SELECT f.config, c.qid, c.is_pos, row_number() OVER (PARTITION BY f.config, c.qid ORDER BY coalesce(s.score, 0)::DOUBLE DESC, md5('42|' || c.qid || '|' || c.item)) AS rank
  FROM cand c CROSS JOIN (SELECT DISTINCT config FROM sall) f LEFT JOIN sall s ON s.config = f.config AND s.qid = c.qid AND s.item = c.item),
res AS (SELECT config, k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS hr, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= k THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg
  FROM rc, (SELECT unnest([1, 5, 10, 20]) AS k) WHERE is_pos = 1 GROUP BY config, k)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    h, corpus = _histories(spark, sf_dir), V.event_tags(spark, sf_dir)
    w = B.history_weights(h, "union", "log2", 20)
    scorers = {
        "bm25": B.scored(B.history_queries(w, corpus), B.postings(corpus), c).withColumn("score", F.round("score", 6)),
        "markov": P.markov_scores(w, P.transitions(V.events(spark, sf_dir))).withColumn("score", F.round("score", 6)),
        "popular": _popular_scores(spark, sf_dir, c), "browsed": P.browsed_scores(h),
    }
    out = None
    for name, scores in scorers.items():
        m = _rounded(E.mean_metrics(E.query_metrics(E.ranked(c, scores)))).select(F.lit(name).alias("config"), "k", "hr", "mrr", "ndcg")
        out = m if out is None else out.unionByName(m)
    return out


@query("scorer_comparison", f"{_SCORERS} SELECT config, k, hr, mrr, ndcg FROM res")
def scorer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query("grid_best", f"{_SCORERS} SELECT config, k, hr, mrr, ndcg FROM res QUALIFY row_number() OVER (PARTITION BY k ORDER BY ndcg DESC, config) = 1")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_rows(_results(spark, sf_dir), "ndcg", ("k",))


@query("ablation_pivot", f"{_SCORERS} SELECT config, max(ndcg) FILTER (k = 1) AS at_1, max(ndcg) FILTER (k = 5) AS at_5, max(ndcg) FILTER (k = 10) AS at_10, max(ndcg) FILTER (k = 20) AS at_20 FROM res GROUP BY config")
def ablation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pivot(_results(spark, sf_dir), "config", "k", [1, 5, 10, 20], "ndcg")


def _grid_sql(asks: str, grid: str, keys: str) -> str:
    """NDCG@10 for each row of grid g (config columns keys, k1, b) of query tags asks (config columns that it has, qid, tag, weight)."""
    return f"""gs AS (SELECT {keys}, qid, ed.item, round(sum(q.weight * idf * w * (k1 + 1) / (w + k1 * (1 - b + b * l / a))), 6) AS score
  FROM cand c JOIN ed USING (item) JOIN (SELECT * FROM tm WHERE idf > 0) t USING (tag) JOIN sz ON sz.item = ed.item CROSS JOIN av CROSS JOIN {grid} JOIN {asks} GROUP BY {keys}, qid, ed.item),
rg AS (SELECT {keys}, c.qid, c.is_pos, row_number() OVER (PARTITION BY {keys}, c.qid ORDER BY coalesce(s.score, 0) DESC, md5('42|' || c.qid || '|' || c.item)) AS rank FROM cand c CROSS JOIN g LEFT JOIN gs s USING ({keys}, qid, item))
SELECT {keys}, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg FROM rg WHERE is_pos = 1 GROUP BY {keys}"""


def _grid_metrics(c: DataFrame, scores: DataFrame, grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys…, ndcg): NDCG@10 of scores (keys…, qid, item, score) on candidates, for each configuration of the small table grid."""
    every = c.join(F.broadcast(grid)).join(scores.hint("merge"), [*keys, "qid", "item"], "left").fillna(0.0, ["score"])  # a row for each configuration of a stated grid
    order = Window.partitionBy(*keys, "qid").orderBy(F.desc("score"), S.seeded_order(42, F.col("qid"), F.col("item")))
    ranks = every.withColumn("rank", F.row_number().over(order))
    return E.mean_metrics(E.query_metrics(ranks, (10,), keys), keys).select(*keys, F.round("ndcg", 6).alias("ndcg"))


def _bm25_grid(c: DataFrame, corpus: DataFrame, asks: DataFrame, grid: list[tuple[float, float]], own: tuple[str, ...] = ()) -> DataFrame:
    """BM25 of the candidates for all k1 and b at once: the grid is a column, so the joins run once; asks may have configuration columns of its own."""
    totals = corpus.agg(F.avg(F.size("tags")).alias("a"))
    terms = C.edges(corpus).join(B.term_statistics(corpus, 0.0), "tag").join(corpus.select("item", F.size("tags").alias("l")).hint("merge"), "item").withColumn("a", totals.scalar())
    # users and items grow, and what is exploded or checkpointed looks small to the planner
    met = c.select("qid", "item").join(terms.hint("merge"), "item").join(asks.hint("merge"), ["qid", "tag"])
    met = met.select("*", F.explode(F.array(*[F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for k1, b in grid])).alias("g"))
    k1, b = F.col("g.k1"), F.col("g.b")
    score = F.col("weight") * F.col("idf") * F.col("w") * (k1 + 1) / (F.col("w") + k1 * (1 - b + b * F.col("l") / F.col("a")))
    return met.groupBy(*own, k1.alias("k1"), b.alias("b"), "qid", "item").agg(F.round(F.sum(score), 6).alias("score"))


def _table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])).alias("r")).select("r.*")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


_GRID = [(k1, b) for k1 in (0.5, 1.0, 1.5, 2.0) for b in (0.0, 0.5, 0.75)]
_ITEM_GRID = [(k1, b) for k1 in (0.0, 0.5, 1.0, 1.5, 2.0) for b in (0.0, 0.25, 0.5, 0.75)]
#: Longest history (0: all of it), weights.
_USER_GRID = [(most, kind) for most in (0, 15, 20) for kind in ("none", "linear", "log2", "exp")]


@query("bm25_grid", f"""{_BASE}, {V.EVENT_TAGS_SQL}, {_bm25_sql('event_tags')}, {_weights_sql('log2', 'max', 20)}, qt AS (SELECT qid, tag, sum(weight * w) AS weight FROM wt JOIN ed USING (item) GROUP BY qid, tag),
g AS (SELECT k1, b FROM (VALUES {_values(_GRID)}) v(k1, b)), {_grid_sql('qt q USING (qid, tag)', 'g', 'k1, b')}""")
def bm25_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 over a grid of k1 and b, of whole histories."""
    c, corpus = _candidates(spark, sf_dir), V.event_tags(spark, sf_dir)
    asks = B.history_queries(B.history_weights(_histories(spark, sf_dir), "union", "log2", 20), corpus)
    return _grid_metrics(c, _bm25_grid(c, corpus, asks, _GRID), _table(spark, ["k1", "b"], _GRID), ("k1", "b"))


@query("bm25_grid_items", f"""{_BASE}, {V.EVENT_TAGS_SQL}, {_bm25_sql('event_tags')}, qt AS (SELECT qid, tag, w::DOUBLE AS weight FROM hist JOIN ed ON ed.item = seq[len(seq)]),
g AS (SELECT k1, b FROM (VALUES {_values(_ITEM_GRID)}) v(k1, b)), {_grid_sql('qt q USING (qid, tag)', 'g', 'k1, b')}""")
def bm25_grid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 over 20 configurations where the last item of a history asks with its tags."""
    c, corpus = _candidates(spark, sf_dir), V.event_tags(spark, sf_dir)
    asks = B.history_queries(B.history_weights(_histories(spark, sf_dir), "last"), corpus)
    return _grid_metrics(c, _bm25_grid(c, corpus, asks, _ITEM_GRID), _table(spark, ["k1", "b"], _ITEM_GRID), ("k1", "b"))


def _user_asks(spark: SparkSession, sf_dir: str, grid: list[tuple], reducers: tuple[str, ...] = ("sum",)) -> DataFrame:
    """(reduce, most, kind, qid, item, weight) for each configuration of histories."""
    h, out = _histories(spark, sf_dir), None
    for reduce in reducers:
        for most, kind in grid:
            w = B.history_weights(h, reduce, None if kind == "none" else kind, most or None)
            w = w.select(F.lit(reduce).alias("reduce"), F.lit(most).alias("most"), F.lit(kind).alias("kind"), "qid", "item", "weight")
            out = w if out is None else out.unionByName(w)
    return out


def _user_asks_sql(grid: list[tuple], reducers: tuple[str, ...] = ("sum",)) -> str:
    """wa: the same in SQL. Weights of exp count the longest history where no longest is set."""
    w = """CASE kind WHEN 'linear' THEN (pos + 1)::DOUBLE WHEN 'log2' THEN 1 / log2(2 + (n - 1 - pos)::DOUBLE) WHEN 'exp' THEN pow(10::DOUBLE, pos * 10::DOUBLE / ((CASE most WHEN 0 THEN longest ELSE most END) - 1)) ELSE 1.0::DOUBLE END"""
    return f"""ug AS (SELECT most, kind FROM (VALUES {_values(grid)}) v(most, kind)),
hu AS (SELECT most, kind, qid, CASE most WHEN 0 THEN seq ELSE seq[greatest(len(seq) - most, 0) + 1 :] END AS s, (SELECT max(len(seq)) FROM hist) AS longest FROM hist, ug),
lu AS (SELECT most, kind, qid, longest, len(s) AS n, unnest(s) AS item, unnest(range(len(s))) AS pos FROM hu),
wa AS ({' UNION ALL '.join(f"SELECT '{r}' AS reduce, most, kind, qid, item, {'sum' if r == 'sum' else 'max'}({w}) AS weight FROM lu GROUP BY most, kind, qid, item" for r in reducers)})"""


@query("bm25_grid_users", f"""{_BASE}, {V.EVENT_TAGS_SQL}, {_bm25_sql('event_tags')}, {_user_asks_sql(_USER_GRID)}, qt AS (SELECT most, kind, qid, tag, sum(weight * w) AS weight FROM wa JOIN ed USING (item) GROUP BY ALL),
g AS (SELECT most, kind, 0.5::DOUBLE AS k1, 0.25::DOUBLE AS b FROM ug), gs AS (SELECT most, kind, qid, ed.item, round(sum(q.weight * idf * w * 1.5::DOUBLE / (w + 0.5::DOUBLE * (1 - 0.25::DOUBLE + 0.25::DOUBLE * l / a))), 6) AS score
  FROM cand c JOIN ed USING (item) JOIN (SELECT * FROM tm WHERE idf > 0) t USING (tag) JOIN sz ON sz.item = ed.item CROSS JOIN av JOIN qt q USING (qid, tag) GROUP BY most, kind, qid, ed.item),
rg AS (SELECT most, kind, c.qid, c.is_pos, row_number() OVER (PARTITION BY most, kind, c.qid ORDER BY coalesce(s.score, 0) DESC, md5('42|' || c.qid || '|' || c.item)) AS rank FROM cand c CROSS JOIN g LEFT JOIN gs s USING (most, kind, qid, item))
SELECT most, kind, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg FROM rg WHERE is_pos = 1 GROUP BY most, kind""")
def bm25_grid_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 over 12 configurations of summed histories: their longest length and their weights."""
    c, corpus = _candidates(spark, sf_dir), V.event_tags(spark, sf_dir)
    asks = _user_asks(spark, sf_dir, _USER_GRID).join(C.edges(corpus).hint("merge"), "item").groupBy("most", "kind", "qid", "tag").agg(F.sum(F.col("weight") * F.col("w")).alias("weight"))
    scores = _bm25_grid(c, corpus, asks, [(0.5, 0.25)], ("most", "kind")).drop("k1", "b")
    return _grid_metrics(c, scores, _table(spark, ["most", "kind"], _USER_GRID), ("most", "kind"))


@query("result_upsert", """WITH o AS (SELECT p_brand AS hash, count(*) AS value FROM part GROUP BY 1), n AS (SELECT p_brand AS hash, count(*) * 10 AS value FROM part WHERE p_size > 25 AND p_brand > 'Brand#2' GROUP BY 1 UNION ALL SELECT 'new', 1)
SELECT hash, value FROM o WHERE hash NOT IN (SELECT hash FROM n) UNION ALL SELECT hash, value FROM n""")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    old = part.groupBy(F.col("p_brand").alias("hash")).agg(F.count("*").alias("value"))
    new = part.where("p_size > 25 AND p_brand > 'Brand#2'").groupBy(F.col("p_brand").alias("hash")).agg((F.count("*") * 10).alias("value"))
    new = new.union(part.agg(F.lit("new").alias("hash"), F.lit(1).cast("long").alias("value")))
    return E.upserted(old, new)


_LISTS = f"""WITH {V.EVENTS_SQL}, dis AS (SELECT DISTINCT "user" AS qid, item FROM ev), li AS (SELECT qid, list(item ORDER BY md5('42|' || qid || '|' || item), item) AS items FROM dis GROUP BY qid),
pl AS (SELECT list(item ORDER BY n DESC, item) AS items FROM (SELECT item, count(*) AS n FROM ev GROUP BY item ORDER BY n DESC, item LIMIT 20))"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = V.events(spark, sf_dir)
    own = e.select(F.col("user").alias("qid"), "item").distinct()
    pairs = F.array_sort(F.collect_list(F.struct(S.seeded_order(42, F.col("qid"), F.col("item")).alias("o"), "item")))
    a = own.groupBy("qid").agg(F.transform(pairs, lambda x: x["item"]).alias("items"))
    best = P.popularity(e).orderBy(F.desc("score"), "item").limit(20).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item"))).alias("b"))
    b = a.select("qid", best.select(F.transform("b", lambda x: x["item"]).alias("items")).scalar().alias("items"))
    return a, b


@query("source_mix", f"{_LISTS} SELECT qid, array_to_string(list_concat(li.items[1:5], pl.items[1:3]), ',') AS items FROM li, pl")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lists(spark, sf_dir)
    return E.mixed_sources([a, b], [5, 3]).select("qid", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("source_disagreement", f"{_LISTS} SELECT qid FROM li WHERE qid % 7 = 0 OR qid % 5 = 0 AND qid % 7 <> 0")
def source_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lists(spark, sf_dir)
    return E.disagreeing(a.where("qid % 7 <> 0"), b.where("qid % 5 <> 0 OR qid % 7 = 0"))


@query("candidates_with_truth", f"""{_LISTS}, s AS (SELECT "user" AS qid, max_by(item, ts) AS truth FROM ev GROUP BY "user"), r AS (SELECT qid, truth, list_filter(items, lambda x: x <> truth)[1:9] AS rest FROM li JOIN s USING (qid))
SELECT qid, array_to_string(list_concat(rest[1:2], list_concat([truth], rest[3:])), ',') AS items FROM r""")
def candidates_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _lists(spark, sf_dir)
    truth = V.events(spark, sf_dir).groupBy(F.col("user").alias("qid")).agg(F.max_by("item", "ts").alias("truth"))
    out = a.join(truth, "qid").select("qid", E.with_truth(F.col("items"), F.col("truth"), 10, 3).alias("items"))
    return out.select("qid", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("pop_by_rank", f"""{_LISTS}, p AS (SELECT item, count(*) AS score FROM ev WHERE action = 'purchase' GROUP BY item), u AS (SELECT unnest(items) AS item, unnest(range(len(items))) AS pos FROM li)
SELECT pos::INT AS pos, round(avg(score), 6) AS popularity FROM u JOIN p USING (item) GROUP BY pos""")
def pop_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _lists(spark, sf_dir)
    return E.popularity_by_rank(a, P.popularity(V.events(spark, sf_dir).where("action = 'purchase'"))).withColumn("popularity", F.round("popularity", 6))


@query("rank_fusion", f"""WITH {V.EVENTS_SQL}, dis AS (SELECT DISTINCT "user" AS qid, item FROM ev), b AS (SELECT unnest([1, 2, 3]) AS seed),
r AS (SELECT qid, item, 10 - row_number() OVER (PARTITION BY qid, seed ORDER BY md5(seed || '|' || qid || '|' || item), item) + 1 AS s FROM dis, b)
SELECT qid, item, sum(s)::BIGINT AS score FROM r WHERE s > 0 GROUP BY qid, item""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three shuffled repeats, each worth 10 for its first place down to 1, added up."""
    own = V.events(spark, sf_dir).select(F.col("user").alias("qid"), "item").distinct()
    out = None
    for seed in (1, 2, 3):
        r = P.random_ranks(own, seed).where("rank <= 10").select("qid", "item", (11 - F.col("rank")).alias("score"))
        out = r if out is None else out.unionByName(r)
    return E.fused(out)


_GRAPH = f"""WITH RECURSIVE {V.EVENT_TAGS_SQL}, ed AS (SELECT item, tag, count(*)::DOUBLE AS w FROM (SELECT item, unnest(tags) AS tag FROM event_tags) GROUP BY item, tag),
dg AS (SELECT ed.*, sum(w) OVER (PARTITION BY item) AS di, sum(w) OVER (PARTITION BY tag) AS dt FROM ed), sm AS (SELECT item, tag, w / sqrt(di * dt) AS s FROM dg),
ta AS (SELECT x.tag AS a, y.tag AS b, sum(x.s * y.s) AS t FROM sm x JOIN sm y USING (item) GROUP BY 1, 2)"""


def _stop_sql(moved: str) -> str:
    """stop: the round at which the operator stops, the first fifth one at which the step is small."""
    return f"stop AS (SELECT min(r) AS r FROM ({moved}) WHERE r % 5 = 0 AND r > 0)"


#: A stated query set of birank_item, birank_reach and pagerank_item: items whose id is divisible by this ask; all items answer.
ASKING = 100


def _push_sql(start: str, bound: str, rounds: int = 40) -> str:
    """vs (qid, tag, v): forward push at alpha x beta = 0.36; a round without a residual above bound changes nothing."""
    return f"""u(n, qid, tag, p, r) AS (SELECT 0, qid, tag, 0.0::DOUBLE, v FROM ({start}) UNION ALL
SELECT n, qid, tag, sum(p), sum(r) FROM (
  SELECT u.n + 1 AS n, qid, unnest(CASE WHEN abs(r) > {bound}::DOUBLE THEN list_prepend(struct_pack(tag := tag, p := p + r, r := 0.0::DOUBLE), list_transform(m.m, lambda x: struct_pack(tag := x.b, p := 0.0::DOUBLE, r := r * x.t * 0.36::DOUBLE))) ELSE [struct_pack(tag := tag, p := p, r := r)] END, recursive := true)
  FROM u JOIN tl m ON m.a = u.tag WHERE u.n < {rounds}
) GROUP BY n, qid, tag),
vs AS (SELECT qid, tag, p + r AS v FROM u WHERE n = {rounds})"""


_ITEM_START = "SELECT qid, tag, sum(weight * s) AS v FROM q JOIN sm USING (item) GROUP BY qid, tag"
_ITEM_Q = f"q AS (SELECT item AS qid, item, 1.0::DOUBLE AS weight FROM event_tags WHERE item % {ASKING} = 0), tl AS (SELECT a, list(struct_pack(b := b, t := t)) AS m FROM ta GROUP BY a)"
#: Residuals that BiRank leaves where they are.
_BOUND = "1e-8"


@query("birank_item", f"""{_GRAPH}, {_ITEM_Q}, {_push_sql(_ITEM_START, _BOUND)},
al AS (SELECT qid, item, sum(v * s) * 0.36::DOUBLE AS v FROM vs JOIN sm USING (tag) GROUP BY qid, item UNION ALL SELECT qid, item, weight FROM q) SELECT qid, item, round(sum(v) * 0.4::DOUBLE, 8) AS score FROM al GROUP BY qid, item""")
def birank_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = V.event_tags(spark, sf_dir)
    asks = corpus.where(f"item % {ASKING} = 0").select(F.col("item").alias("qid"), "item", F.lit(1.0).alias("weight"))
    return G.birank_items(asks, C.edges(corpus), cut, 0.6, 0.6, float(_BOUND), 8)


@query("birank_reach", f"""{_GRAPH}, {_ITEM_Q}, {_push_sql(_ITEM_START, '1e-3')} SELECT qid, count(*) AS touched, round(sum(v), 8) AS mass FROM vs GROUP BY qid""")
def birank_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tags each query touches at a coarse bound, and what it leaves on them."""
    corpus = V.event_tags(spark, sf_dir)
    s = cut(G.normalised(C.edges(corpus)))
    start = corpus.where(f"item % {ASKING} = 0").select(F.col("item").alias("qid"), "item").join(s, "item").select("qid", "tag", F.col("s").alias("v"))
    found = G.push(start, G.tag_transitions(s), 0.36, cut, 1e-3)
    return found.groupBy("qid").agg(F.count("*").alias("touched"), F.round(F.sum("v"), 8).alias("mass"))


@query("birank_tag", f"""{_GRAPH}, q AS (SELECT item AS qid, tag, w AS v FROM ed), tl AS (SELECT a, list(struct_pack(b := b, t := t)) AS m FROM ta GROUP BY a), {_push_sql('SELECT * FROM q', _BOUND)}
SELECT qid, item, round(sum(v * s) * (0.6::DOUBLE * 0.4::DOUBLE), 8) AS score FROM vs JOIN sm USING (tag) GROUP BY qid, item""")
def birank_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items ask with their tags, and all items answer."""
    corpus = V.event_tags(spark, sf_dir)
    asks = C.edges(corpus).select(F.col("item").alias("qid"), "tag", F.col("w").cast("double").alias("weight"))
    return G.birank_tags(asks, C.edges(corpus), cut, 0.6, 0.6, float(_BOUND), 8)


_ITEM_ALPHA, _USER_ALPHA = (0.5, 0.75, 0.85, 0.9), (0.75, 0.85, 0.9)
_HISTORY_GRID = [(most, kind) for most in (0, 15, 20) for kind in ("none", "linear", "log2")]
_REDUCE = ("sum", "union")


def _birank_grid(spark: SparkSession, sf_dir: str, asks: Callable[[DataFrame], DataFrame], alphas: tuple[float, ...], names: list[str], own: list[tuple]) -> DataFrame:
    """(names…, alpha, beta, ndcg) for each of own (names…), whose weightings asks makes of histories, and each alpha and beta."""
    pairs = [(x, y) for x in alphas for y in alphas]
    found = G.grid_gains(_candidates(spark, sf_dir), _histories(spark, sf_dir), asks, C.edges(V.event_tags(spark, sf_dir)), len(own), pairs, cut)
    grid = [(i, *o, *p) for i, (o, p) in enumerate((o, p) for o in own for p in pairs)]
    return _table(spark, ["at", *names, "alpha", "beta"], grid).join(found, "at").select(*names, "alpha", "beta", F.round("ndcg", 6).alias("ndcg"))


def _birank_grid_sql(asks: str, alphas: tuple[float, ...], own: str = "", grid: str = "") -> str:
    """asks defines aw (own, qid, item, weight) after the graph; grid names a table of own's configurations."""
    pairs = _values([(x, y, x * y) for x in alphas for y in alphas])
    factors = ", ".join(f"{c}::DOUBLE" for c in sorted({x * y for x in alphas for y in alphas}))
    keys = f"{own}alpha, beta"
    return f"""{_GRAPH}, {_BASE.removeprefix('WITH ')}, {asks}, pr AS (SELECT alpha, beta, c FROM (VALUES {pairs}) x(alpha, beta, c)),
v(r, c, o, tag, v) AS (SELECT 0, c, tag, tag, 1.0::DOUBLE FROM (SELECT DISTINCT tag FROM ed), (SELECT unnest([{factors}]) AS c) UNION ALL SELECT r + 1, c, o, b, sum(v * t * c) FROM v JOIN ta ON tag = a WHERE r < 160 GROUP BY r, c, o, b),
vs AS (SELECT c, o, tag, sum(v) AS v FROM v GROUP BY c, o, tag),
qs AS (SELECT {own}qid, tag, sum(weight * s) AS q FROM aw JOIN sm USING (item) GROUP BY {own}qid, tag),
sp AS (SELECT {own}c, qid, vs.tag, sum(q * v) AS v FROM qs JOIN vs ON qs.tag = vs.o GROUP BY {own}c, qid, vs.tag),
bk AS (SELECT {own}c, qid, item, sum(v * s) * c AS v FROM cand JOIN sm USING (item) JOIN sp USING (qid, tag) GROUP BY {own}c, qid, item),
al AS (SELECT {own}alpha, beta, qid, item, v FROM bk JOIN pr USING (c) UNION ALL SELECT {own}alpha, beta, qid, item, weight FROM cand JOIN aw USING (qid, item), pr),
gs AS (SELECT {own}alpha, beta, qid, item, round(sum(v) * (1 - alpha), 9) AS score FROM al GROUP BY {own}alpha, beta, qid, item),
g AS (SELECT {own}alpha, beta FROM pr{grid}),
rg AS (SELECT {keys}, c.qid, c.is_pos, row_number() OVER (PARTITION BY {keys}, c.qid ORDER BY coalesce(s.score, 0) DESC, md5('42|' || c.qid || '|' || c.item)) AS rank FROM cand c CROSS JOIN g LEFT JOIN gs s USING ({keys}, qid, item))
SELECT {keys}, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg FROM rg WHERE is_pos = 1 GROUP BY {keys}"""


@query("birank_grid", _birank_grid_sql("aw AS (SELECT qid, seq[len(seq)] AS item, 1.0::DOUBLE AS weight FROM hist)", _ITEM_ALPHA))
def birank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 over 16 pairs of alpha and beta where the last item of a history asks."""
    last = lambda h: h.where(F.size("seq") > 0).select("group", "qid", F.element_at("seq", -1).alias("item"), F.array(F.lit(1.0)).alias("weights"))
    return _birank_grid(spark, sf_dir, last, _ITEM_ALPHA, [], [()])


@query("birank_grid_users", _birank_grid_sql(_user_asks_sql(_HISTORY_GRID, _REDUCE).replace("wa AS (", "aw AS ("), _USER_ALPHA, "reduce, most, kind, ", ", ug, (SELECT unnest(['sum', 'union']) AS reduce)"))
def birank_grid_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 over 162 configurations of whole histories: alpha, beta, longest length, weights, reduction."""
    own = [(r, most, kind) for r in _REDUCE for most, kind in _HISTORY_GRID]
    asks = lambda h: B.history_grid(h, [(r, None if kind == "none" else kind, most or None) for r, most, kind in own])
    return _birank_grid(spark, sf_dir, asks, _USER_ALPHA, ["reduce", "most", "kind"], own)


def _whole_sql(up: str, down: str, hits: bool = False) -> str:
    """Both sides at once: a row of x is a node of a side in a round."""
    mixed = "sum(e.w * x.v) * 0.85::DOUBLE + (1 - 0.85::DOUBLE) * max(e.base)"
    step = f"SELECT x.r + 1 AS r, e.side, e.dst AS node, {mixed} AS v FROM x JOIN e ON e.src = x.node AND e.side <> x.side WHERE x.r < 200 GROUP BY x.r, e.side, e.dst"
    if hits:
        step = f"SELECT r, side, node, v / sum(v) OVER (PARTITION BY side) FROM ({step})"
    return f"""{_GRAPH}, n AS (SELECT 1.0::DOUBLE / count(DISTINCT item) AS d0, 1.0::DOUBLE / count(DISTINCT tag) AS p0 FROM dg),
e AS (SELECT 'tag' AS side, item::VARCHAR AS src, tag AS dst, {up} AS w, p0 AS base FROM dg, n UNION ALL SELECT 'item', tag, item::VARCHAR, {down}, d0 FROM dg, n),
x(r, side, node, v) AS (SELECT DISTINCT 0, side, dst, base FROM e UNION ALL {step}),
d AS (SELECT a.r, a.side, sum(abs(a.v - b.v)) AS moved FROM x a JOIN x b ON b.r = a.r - 1 AND b.side = a.side AND b.node = a.node GROUP BY a.r, a.side),
{_stop_sql('SELECT r FROM d GROUP BY r HAVING max(moved) < 1e-4::DOUBLE')}
SELECT side, node, round(v, 8) AS score FROM x WHERE r = (SELECT coalesce(min(r), 200) FROM stop)"""


for _name, _norm, _up, _down in (("hits", "HITS", "w", "w"), ("cohits", "CoHITS", "w / di", "w / dt"), ("bgrm", "BGRM", "w / (di * dt)", "w / (di * dt)"), ("birank", "BiRank", "w / sqrt(di * dt)", "w / sqrt(di * dt)")):

    def _whole(spark: SparkSession, sf_dir: str, norm=_norm) -> DataFrame:
        return G.birank(C.edges(V.event_tags(spark, sf_dir)), norm, cut).withColumn("score", F.round("score", 8))

    query(f"bipartite_{_name}", _whole_sql(_up, _down, _name == "hits"))(_whole)


def _pagerank_sql(start: str) -> str:
    """Moves of weight 0 from a node to itself keep the nodes that a round would leave."""
    return f"""{_GRAPH}, g AS (SELECT 'i:' || item AS src, 't:' || tag AS dst, w FROM ed UNION ALL SELECT 't:' || tag, 'i:' || item, w FROM ed), mv AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS m FROM g UNION ALL SELECT DISTINCT src, src, 0.0::DOUBLE FROM g), {start},
x(r, qid, node, v) AS (SELECT 0, qid, node, x0 FROM st UNION ALL
  SELECT s.r, s.qid, s.node, s.v + coalesce(st.x0, 0) * (1 - 0.85::DOUBLE) FROM (SELECT x.r + 1 AS r, x.qid, mv.dst AS node, sum(x.v * mv.m * 0.85::DOUBLE) AS v FROM x JOIN mv ON x.node = mv.src WHERE x.r < 120 GROUP BY x.r, x.qid, mv.dst) s LEFT JOIN st ON st.qid = s.qid AND st.node = s.node),
d AS (SELECT a.r, a.qid, sum(abs(a.v - coalesce(b.v, 0))) AS moved FROM x a LEFT JOIN x b ON b.r = a.r - 1 AND b.qid = a.qid AND b.node = a.node WHERE a.r > 0 GROUP BY a.r, a.qid),
{_stop_sql('SELECT r FROM d GROUP BY r HAVING max(moved) < 1e-4::DOUBLE')}
SELECT qid, node, round(v, 8) AS score FROM x WHERE r = (SELECT r FROM stop)"""


@query("pagerank_item", _pagerank_sql(f"st AS (SELECT item AS qid, 'i:' || item AS node, 1.0::DOUBLE AS x0 FROM event_tags WHERE item % {ASKING} = 0)"))
def pagerank_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = V.event_tags(spark, sf_dir)
    start = corpus.where(f"item % {ASKING} = 0").select(F.col("item").alias("qid"), "item", F.lit(1.0).alias("x0"))
    return G.pagerank_items(start, C.edges(corpus), cut, digits=8)


@query("pagerank_user", _pagerank_sql(f"""{V.EVENTS_SQL}, ui AS (SELECT "user" AS qid, item, count(*) AS n FROM ev JOIN event_tags USING (item) GROUP BY 1, 2), st AS (SELECT qid, 'i:' || item AS node, n / sum(n) OVER (PARTITION BY qid) AS x0 FROM ui)"""))
def pagerank_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users ask with the items of their events."""
    corpus = V.event_tags(spark, sf_dir)
    own = V.events(spark, sf_dir).groupBy(F.col("user").alias("qid"), "item").agg(F.count("*").alias("n"))
    own = own.join(corpus.select("item").hint("merge"), "item", "left_semi")
    start = own.select("qid", "item", (F.col("n") / F.sum("n").over(Window.partitionBy("qid"))).alias("x0"))
    return G.pagerank_items(start, C.edges(corpus), cut, digits=8)


@query("homogeneous_edges", f"WITH {V.TAGS_SQL}, ed AS (SELECT item, tag, count(*) AS w FROM (SELECT item, unnest(tags) AS tag FROM base_tags) GROUP BY item, tag) SELECT 'i:' || item AS src, 't:' || tag AS dst, w FROM ed UNION ALL SELECT 't:' || tag, 'i:' || item, w FROM ed")
def homogeneous_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.homogeneous(C.edges(V.base_tags(spark, sf_dir)))


_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS n FROM v)"


@query("similar_pairs", f"WITH {_VEC} SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.n, b.n), 6) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_inner_product(a.n, b.n) > 0.3")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.similar_pairs(V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.3).withColumn("cosine", F.round("cosine", 6))


@query("embedding_topk", f"""WITH {_VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS item, list_inner_product(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 100 = 0)
SELECT qid, item, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 10""")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    asks = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return N.nearest(asks, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 10).withColumn("score", F.round("score", 6))


_MERGE = f"""WITH RECURSIVE {_VEC}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.n, b.n) > 0.3),
l AS (SELECT 'v' || vec_id AS tag, vec_id, 1 + vec_id % 7 AS n, row_number() OVER (ORDER BY 1 + vec_id % 7 DESC, 'v' || vec_id) AS o FROM embeddings),
e AS (SELECT x.o AS a, y.o AS b FROM p JOIN l x ON x.vec_id = p.a JOIN l y ON y.vec_id = p.b WHERE y.o < x.o), nb AS (SELECT o, (SELECT list(b) FROM e WHERE e.a = o) AS bs FROM l),
r AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS leaders UNION ALL SELECT r.o + 1, CASE WHEN len(list_intersect(coalesce(nb.bs, []), r.leaders)) = 0 THEN list_append(r.leaders, r.o + 1) ELSE r.leaders END FROM r JOIN nb ON nb.o = r.o + 1),
z AS (SELECT unnest(leaders) AS o FROM (SELECT leaders FROM r ORDER BY o DESC LIMIT 1)), f AS (SELECT a AS o, min(b) AS lo FROM e JOIN z ON z.o = e.b WHERE a NOT IN (SELECT o FROM z) GROUP BY a UNION ALL SELECT o, o FROM z)
SELECT l.tag, m.tag AS leader FROM f JOIN l ON l.o = f.o JOIN l m ON m.o = f.lo"""


@query("tag_merge", _MERGE)
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy merging of vectors as tags, at cosine 0.3."""
    e = V.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("tag"), (1 + F.col("vec_id") % 7).alias("n"), F.col("embedding").alias("vector"))
    return N.merged_vectors(e, 0.3)


@query("tag_rewrite", f"""WITH {V.TAGS_SQL}, m AS (SELECT tag, upper(tag[1:3]) AS t FROM (SELECT DISTINCT unnest(tags) AS tag FROM base_tags) WHERE length(tag) % 2 = 0),
x AS (SELECT item, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM base_tags) SELECT item, string_agg(t, '|' ORDER BY pos) AS tags FROM x JOIN m USING (tag) GROUP BY item""")
def tag_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = V.base_tags(spark, sf_dir)
    mapping = C.tag_domain(corpus).where(F.length("tag") % 2 == 0).select("tag", F.upper(F.substring("tag", 1, 3)).alias("to"))
    return C.rewritten(corpus, mapping).withColumn("tags", F.array_join("tags", "|"))
