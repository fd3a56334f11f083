"""Edge rules on small tables."""

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtag import scratch
from loomtag.functions import text as X
from loomtag.operators import bm25 as B
from loomtag.operators import corpus as C
from loomtag.operators import evaluation as E
from loomtag.operators import graph as G
from loomtag.operators import quantiles as Q
from loomtag.operators import sequences as S
from loomtag.operators import similarity as N
from loomtag.operators import tagging as T
from loomtag.plans.sequence_queries import cut
from loomtag.sources import readers as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_zero_deviation_gives_zero_z(spark):
    counts = spark.createDataFrame([(1, "a", 3), (2, "a", 3)], "item long, label string, cnt long")
    assert [r["z"] for r in T.with_zscores(counts).collect()] == [0.0, 0.0]


def test_empty_quartile_gap_does_not_divide(spark):
    df = spark.createDataFrame([(9.0,), (1.0,), (5.0,)], "f double")
    got = df.select("f", T.frequency_adjustment(F.col("f"), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("a")).collect()
    assert {r["f"]: r["a"] for r in got} == {9.0: -math.inf, 1.0: math.inf, 5.0: 0.0}


def test_bad_labels_are_empty(spark):
    df = spark.createDataFrame([("not json",), ("{}",), (None,), ("[]",), ('["a"]',)], "c string")
    assert [r[0] for r in df.select(T.parsed_labels(F.col("c"))).collect()] == [[], [], [], [], ["a"]]


def test_repeated_label_counts_once_unless_asked(spark):
    items = spark.createDataFrame([(1, "x")], "session_id long, item string")
    labels = spark.createDataFrame([(1, ["a", "a"])], "session_id long, labels array<string>")
    assert rows(T.item_label_counts(items, labels)) == [("x", "a", 1)]
    assert rows(T.item_label_counts(items, labels, dedup=False)) == [("x", "a", 2)]


def test_pattern_zero_cells_enter_mean_and_deviation(spark):
    counts = spark.createDataFrame([("x", "p", 4), ("y", "q", 2)], "item string, pattern string, cnt long")
    got = {(r["item"], r["pattern"]): r["z"] for r in T.pattern_zscores(counts).collect()}
    assert got == {("x", "p"): 1.0, ("y", "p"): -1.0, ("x", "q"): -1.0, ("y", "q"): 1.0}


def test_raising_the_threshold_never_adds(spark):
    z = spark.createDataFrame([(i, "a", float(i) / 4 - 1) for i in range(12)], "item long, label string, z double")
    got = {r["threshold"]: r["tags"] for r in T.threshold_grid(z, [-1.0, 0.0, 1.0, 9.0]).collect()}
    assert got == {-1.0: 12, 0.0: 8, 1.0: 4}


def test_bisection_finds_a_peak():
    best, seen = T.bisect_threshold(lambda t: -abs(t + 1.5))
    assert abs(best + 1.5) <= 0.13 and len(seen) <= 10


def test_short_sequences(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])], "user long, seq array<string>")
    got = {r["user"]: (r["train"], r["valid"], r["test"]) for r in S.leave_one_out(df).collect()}
    assert got == {1: ([], None, None), 2: (["a"], None, "b"), 3: (["a"], "b", "c")}
    assert S.at_least(df, 2).count() == 2 and S.at_most(df, 2).count() == 2


def test_runs_keep_their_last_event(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabba")], "user long, ts long, item string")
    assert [r["ts"] for r in S.collapse_runs(df).orderBy("ts").collect()] == [1, 3, 4]


def test_unseen_suffix(spark):
    df = spark.createDataFrame([(1, list("abccb"))], "user long, seq array<string>")
    one = S.unseen_last_items(df, 1).collect()[0]
    assert (one["history"], one["targets"]) == (["a", "b"], ["c"])
    two = S.unseen_last_items(df, 2).collect()[0]
    assert (two["history"], sorted(two["targets"])) == (["a"], ["b", "c"])


def test_k_core_meets_both_bounds_and_can_be_empty(spark):
    df = spark.createDataFrame([(u, i) for u in range(6) for i in range(6) if (u + i) % 3 or u < 2], "user long, item long")
    core = S.k_core(df, 4, 4, cut)
    for key in ("user", "item"):
        assert core.groupBy(key).count().where("count < 4").isEmpty()
    assert S.k_core(df, 50, 0, cut).isEmpty()


def plain_core(edges, user_min, item_min):
    while True:
        users, items = Counter(u for u, _ in edges), Counter(i for _, i in edges)
        kept = [(u, i) for u, i in edges if users[u] >= user_min and items[i] >= item_min]
        if len(kept) == len(edges):
            return sorted(kept)
        edges = kept


def test_k_core_of_a_path_is_empty_and_circles_stay(spark):
    # 2,000 nodes in a path: user k has items k and k + 1
    path = [(k, k + d) for k in range(1000) for d in (0, 1)]
    path.pop()
    circle = [(5000 + k, 5000 + (k + d) % 6) for k in range(6) for d in (0, 1)]
    tail = [(6000 + k, 6000 + k + d) for k in range(50) for d in (0, 1)] + [(5000, 6000)]
    twice = [(7000, 7000)] * 2 + [(7000, 7001), (7002, 7001)]
    df = spark.createDataFrame(path, "user long, item long")
    assert S.k_core(df, 2, 2, cut).isEmpty()
    df = spark.createDataFrame(circle + tail + twice + [(None, 1), (9, None)], "user long, item long")
    assert rows(S.k_core(df, 2, 2, cut)) == sorted(circle + [(7000, 7000)] * 2)


@pytest.mark.parametrize("least", [(2, 2), (3, 2), (0, 3)])
def test_k_core_equals_peeling_in_rounds(spark, least):
    rng = random.Random(sum(least))
    edges = [(rng.randrange(150), rng.randrange(120)) for _ in range(330)]
    df = spark.createDataFrame([(u, i, f"x{k}") for k, (u, i) in enumerate(edges)], "user long, item long, more string")
    got = S.k_core(df, *least, cut)
    assert got.columns == df.columns and rows(got.select("user", "item")) == plain_core(edges, *least)


def test_unseen_suffix_of_a_long_sequence(spark):
    # 20,000 items, the last fresh one 3 from the end; quadratic forms do not end here
    long = [i % 5000 for i in range(19_996)] + [7001, 7000, 3, 3]
    df = spark.createDataFrame([(1, long), (2, [1, 1, 1]), (3, [4, 5]), (4, []), (5, [None, 1, None])], "user long, seq array<int>")
    got = {r["user"]: r for r in S.unseen_last_items(df, 2).collect()}
    assert set(got) == {1} and got[1]["targets"] == [7001, 7000] and len(got[1]["history"]) == 19_996
    assert {r["user"]: (r["history"], r["targets"]) for r in S.unseen_last_items(df, 1).where("user > 1").collect()} == {3: ([4], [5]), 5: ([None], [1])}


def test_completions_as_models_write_them(spark):
    df = spark.createDataFrame([("a: 1. tag one; tag two (x)\n2. *Bold*, y_z 3d-print\n3. end",)], "c string")
    one = lambda c: df.select(c.alias("t")).first()["t"]
    # a digit or an underscore beside a run of letters is no end of a word
    assert one(X.numbered_tags(F.col("c"))) == ["tag one", "tag two", "x", "bold", "-print", "end"]
    assert one(X.numbered_tags(F.lit("no list"))) == [] and one(X.numbered_tags(F.lit(None).cast("string"))) == []
    assert one(X.numbered_tags(F.col("c"), 0, -2)) == ["tag one", "tag two", "x"] and one(X.numbered_tags(F.col("c"), 2, 3)) == ["end"]
    beams = F.array(F.col("c"), F.lit("1. q\n2. a, b's, c.d"), F.lit("1. q\n2. r"))
    assert one(X.beam_tags(beams, 1, 3, 2)) == ["bold", "end", "a", "b's", "c.d"]
    assert one(X.beam_tags(beams, 1, 2, include_input=True)) == ["tag one", "tag two", "x", "bold", "a", "b's", "c.d", "r"]
    assert one(X.normalised_labels(F.lit("[a;b"))) == ["[a", "b"] and one(X.normalised_labels(F.lit('["a", 1, {"b": 2}]'))) == ["a"] and one(X.normalised_labels(F.lit('{"predicted_classes": "x", "predicted_class": " y;z "}'))) == ["y;z"]
    assert one(X.category_names(F.lit('Category 1: "A", Category 2: "B"'))) == ["A", "B"] and one(X.category_names(F.lit('{"a": 1} Category 3 - b/c'))) == ["b/c"]


def test_one_large_object_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    odd = ['a,b', '{"x": [1, 2]}', 'quote " and \\ end\\', '}],{[', '', ' é中\u2028,"', "\\\\,", 'line\nend,']
    data = {f"k{i} {rng.choice(odd)}": [rng.choice(odd) + str(i) for _ in range(rng.randrange(4))] for i in range(6000)}
    (tmp_path / "one.json").write_text(json.dumps(data))
    (tmp_path / "two.json").write_text(json.dumps({"z,": ["}"], "y": []}, indent=1, ensure_ascii=False))
    (tmp_path / "empty.json").write_text(" {} \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["key"]: r["value"] for r in R.json_dictionary(spark, str(tmp_path), "array<string>").collect()}
        assert spark.read.option("lineSep", ",").text(str(tmp_path / "one.json")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == data | {"z,": ["}"], "y": []}


def test_percentiles_are_those_of_one_task(spark):
    rng = random.Random(4)
    values = [(rng.choice("ab"), rng.choice([None, *map(float, range(-3, 4)), 0.5])) for _ in range(500)] + [("c", 2.0), (None, 1.0), (None, 5.0), ("d", None)]
    df = spark.createDataFrame(values, "g string, v double")
    shares = {"q25": 0.25, "mid": 0.5, "p60": 0.6, "least": 0.0, "most": 1.0}
    plain = [F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items()]
    assert rows(Q.percentiles(df, "v", shares)) == rows(df.agg(*plain))
    order = lambda rs: sorted(map(tuple, rs), key=str)
    assert order(Q.percentiles(df, "v", shares, ("g",)).collect()) == order(df.where("v IS NOT NULL").groupBy("g").agg(*plain).collect())
    assert rows(Q.percentiles(df.where("false"), "v", shares)) == [(None,) * 5]


def test_dense_ids_are_the_ranks(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "a"]], "k string")
    assert rows(S.dense_ids(df, "k", "i")) == [("a", 0), ("b", 1), ("c", 2)]


def test_metrics_with_one_and_two_positives(spark):
    ranks = spark.createDataFrame([(1, 1, 1), (2, 3, 1), (3, 9, 1), (4, 1, 1), (4, 2, 1), (5, 1, 0)], "qid long, rank int, is_pos int")
    got = {r["qid"]: r for r in E.query_metrics(ranks, (5,)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["ndcg"] == 1.0 and got[2]["mrr"] == pytest.approx(1 / 3) and got[3]["hr"] == 0.0
    assert got[4]["hr"] == 1.0 and got[4]["mrr"] == 1.5 and got[4]["ndcg"] == pytest.approx(1.0)


def _corpus(spark):
    return spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b"]), (3, ["c"]), (4, ["a", "d", "e"]), (5, ["f"]), (6, ["g"])], "item long, tags array<string>")


def test_folded_history_equals_item_to_item(spark):
    corpus = _corpus(spark)
    index = B.postings(corpus, alpha=0.0)
    w = spark.createDataFrame([(9, 1, 2.0), (9, 2, 0.5)], "qid long, item long, weight double")
    folded = {r["item"]: r["score"] for r in B.scored(B.history_queries(w, corpus), index).collect()}
    items = B.scored(B.item_queries(corpus), index).collect()
    expected = {}
    for r in items:
        weight = {1: 2.0, 2: 0.5}.get(r["qid"], 0)
        if weight:
            expected[r["item"]] = expected.get(r["item"], 0) + weight * r["score"]
    assert folded == pytest.approx(expected)


def test_history_weights(spark):
    h = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "qid long, seq array<string>")
    got = {(r["qid"], r["item"]): r["weight"] for r in B.history_weights(h, "sum", "linear").collect()}
    assert got == {(1, "a"): 4.0, (1, "b"): 2.0, (2, "c"): 1.0}
    assert {(r["qid"], r["item"]) for r in B.history_weights(h, "intersection").collect()} == {(2, "c")}
    own = B.history_weights(h, lambda c: F.avg(c), "linear").where("item = 'a'").first()
    assert own["weight"] == 2.0
    assert B.history_weights(h, "union", "exp", 1).count() == 2


def test_tag_side_iteration_equals_the_item_side_sum(spark):
    import numpy as np

    corpus = _corpus(spark)
    edges = C.edges(corpus)
    items, tags = sorted({r["item"] for r in edges.collect()}), sorted({r["tag"] for r in edges.collect()})
    g = np.zeros((len(items), len(tags)))
    for r in edges.collect():
        g[items.index(r["item"]), tags.index(r["tag"])] = r["w"]
    s = g / np.sqrt(g.sum(1, keepdims=True) * g.sum(0, keepdims=True))
    full = 0.4 * np.linalg.inv(np.eye(len(items)) - 0.36 * s @ s.T)
    q = spark.createDataFrame([(1, 1, 1.0)], "qid long, item long, weight double")
    got = {r["item"]: r["score"] for r in G.birank_items(q, edges, cut, 0.6, 0.6).collect()}
    for i, item in enumerate(items):
        assert got.get(item, 0.0) == pytest.approx(full[i, items.index(1)], abs=1e-9)


def test_bounded_blocks_give_the_same_top(spark):
    # 4,000 items of 8 tags: two of 20 common ones, six of the 300 of the item's own group
    rng = random.Random(9)
    corpus = [(i, [f"c{rng.randrange(20)}", f"c{rng.randrange(20)}"] + [f"g{i % 40}-{rng.randrange(30)}" for _ in range(6)]) for i in range(4000)]
    df = spark.createDataFrame(corpus, "item long, tags array<string>")
    index = scratch.saved(B.postings(df), "index")
    asks = scratch.saved(B.item_queries(df.where("item % 100 = 0")), "asks")
    every = B.scored(asks, index)
    found = scratch.saved(B.bounded_scores(asks, *B.blocked_postings(index, 100), 10), "found")
    plain = lambda d: [(r["qid"], r["rank"], r["item"], round(r["score"], 9)) for r in B.top_n(d, 10).orderBy("qid", "rank").collect()]
    assert plain(found) == plain(every) and len(plain(found)) == 400
    read, total = found.agg(F.sum("read")).first()[0], asks.join(index, "tag").count()
    assert found.select("qid", "item").distinct().count() == found.count() and read < 0.5 * total, (read, total)


def test_pagerank_keeps_its_mass_and_converges(spark):
    graph = G.homogeneous(C.edges(_corpus(spark)))
    start = spark.createDataFrame([(1, "i:1", 1.0)], "qid long, node string, x0 double")
    got = G.pagerank(start, graph, cut).agg(F.sum("score")).first()[0]
    assert got == pytest.approx(1.0)


def _clustered(spark, n, dims=16, size=50, spread=0.05):
    """n vectors around n / size directions, with norms over three orders of magnitude."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // size, dims))
    v = (centres / np.linalg.norm(centres, axis=1, keepdims=True))[np.arange(n) % len(centres)] + rng.normal(size=(n, dims)) * spread
    v *= 10 ** rng.uniform(-1.5, 1.5, size=(n, 1))
    return v, spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "vector": v.tolist()}), "id long, vector array<double>")


def test_clustered_pairs_ship_no_more_rows_each_as_they_grow(spark):
    shipped = []
    for n in (2_000, 20_000):
        v, df = _clustered(spark, n)
        home, visiting = N.meetings(df, 0.95, block_rows=800)
        shipped.append((home.count() + visiting.count()) / n)
        if n == 2_000:
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            x, y = np.nonzero(np.triu(u @ u.T > 0.95, 1))
            got = N.similar_pairs(df, 0.95, block_rows=800).collect()
            assert sorted((r["a"], r["b"]) for r in got) == sorted(zip(x.tolist(), y.tolist())) and len(got) > 10_000
    assert shipped[0] < 3 and shipped[1] < 5, shipped  # every pair of blocks: 3 and 26


def test_search_by_norms_leaves_most_pairs_out(spark):
    shares = []
    for n in (1_000, 8_000):
        v, df = _clustered(spark, n)
        items, asks = df.withColumnRenamed("id", "item"), df.where("id % 100 = 0").withColumnRenamed("id", "qid")
        got = {(r["qid"], r["rank"]): r["item"] for r in N.nearest(asks, items, 10, item_rows=400).collect()}
        for q in range(0, n, 100):
            score = v @ v[q]
            assert [got[q, r] for r in range(1, 11)] == sorted(range(n), key=lambda i: (-score[i], i))[:10]
        _, late, rows = N.visits(asks, items, 10, item_rows=400)
        sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
        scored = sum(late.select("k", b).withColumnRenamed(b, "block").join(sizes, "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for b in ("block",))
        first = late.select("k", "seen").distinct().select(F.explode("seen").alias("block")).join(sizes, "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shares.append((scored + first) / (n * n / 100))
    assert shares[0] < 0.8 and shares[1] < 0.5 and shares[1] < shares[0], shares


def test_search_with_few_zero_and_missing_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.0]), (5, [1.0, 0.0])], "item long, vector array<double>")
    asks = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "qid long, vector array<double>")
    assert rows(N.nearest(asks, items, 10)) == [(7, 1, 2.0, 1), (7, 2, 0.0, 3), (7, 4, -2.0, 4), (7, 5, 2.0, 2), (8, 1, 0.0, 1), (8, 2, 0.0, 2), (8, 4, 0.0, 3), (8, 5, 0.0, 4)]
    assert rows(N.nearest(asks, items.where("false"), 10)) == [] and rows(N.similar_pairs(items.where("false"), 0.5, key="item")) == []


@pytest.mark.parametrize("normalizer", ["HITS", "CoHITS", "BGRM", "BiRank"])
def test_birank_converges(spark, normalizer):
    got = G.birank(C.edges(_corpus(spark)), normalizer, cut, rounds=60)
    assert got.where("score IS NULL OR isnan(score)").isEmpty() and got.count() == 6 + 7


def test_merging_to_a_reference_takes_the_first_match(spark):
    similar = spark.createDataFrame([("x", "r2"), ("x", "r1"), ("y", "r2")], "tag string, ref string")
    reference = spark.createDataFrame([("r1", 0), ("r2", 1)], "ref string, pos int")
    assert rows(C.merged_to_reference(similar, reference)) == [("x", "r1"), ("y", "r2")]


def test_merging_decides_a_long_chain_to_its_end(spark):
    n = 105  # one tag is decided in a round
    similar = spark.createDataFrame([(f"t{i:03}", f"t{i + 1:03}") for i in range(n - 1)], "a string, b string").coalesce(1)
    frequency = spark.createDataFrame([(f"t{i:03}", n - i) for i in range(n)], "tag string, n int").coalesce(1)
    assert rows(C.merged_tags(similar, frequency, cut)) == [(f"t{i:03}", f"t{i - i % 2:03}") for i in range(n)]


def test_answers_by_text_and_subsequence(spark):
    answers = spark.createDataFrame([(1, "Sure\n1. red shoes\n2. grean hat now\n3. red shoes")], "qid long, answer string")
    candidates = spark.createDataFrame([(1, 0, "i0", "green hat now"), (1, 1, "i1", "red shoes"), (1, 2, "i2", "blue sky")], "qid long, pos int, item string, text string")
    assert rows(X.ranked_by_text(answers, candidates, 5)) == [(1, "i0", 4), (1, "i1", 5)]


def test_label_shapes(spark):
    df = spark.createDataFrame([("a;b ,a",), (None,), ('["x", " x", "y"]',), ("[]",), ('{"predicted_class": "a, b; c"}',)], "c string")
    assert [r[0] for r in df.select(X.normalised_labels(F.col("c"))).collect()] == [["a", "b ,a"], ["Unknown"], ["x", "y"], ["Unknown"], ["a, b; c"]]
    assert df.select(X.normalised_labels(F.col("c"), separator=",")).first()[0] == ["a;b", "a"]


def test_truth_is_placed(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "c array<int>")
    for place, expected in ((1, [2, 1, 3]), (None, [1, 3, 2]), (9, [1, 3, 2])):
        assert df.select(E.with_truth(F.col("c"), F.lit(2), 3, place)).first()[0] == expected


def test_stream_and_batch_agree(spark, tmp_path):
    from loomtag.streaming import label_counts as L

    rows_in = [(1, "2024-01-01 00:00:00", 7, "view"), (1, "2024-01-01 00:10:00", 7, "view"), (1, "2024-01-03 05:00:00", 8, "buy"), (2, "2024-01-09 00:00:00", 7, "view")]
    df = spark.createDataFrame(rows_in, "user long, t string, item int, action string").select("user", F.col("t").cast("timestamp").alias("ts"), "item", "action")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.window_label_counts(stream).writeStream.outputMode("update").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.table("counts")) == rows(L.window_label_counts(df))
    assert L.session_counts(df).count() == 3


def test_negatives_of_a_large_catalogue_are_new_and_no_positives(spark):
    items = spark.range(500).select((F.col("id") + 1000).alias("item"), F.col("id").alias("idx"))
    # query 3 has most of the catalogue as positives, 4 all of it but five
    rows = [(1, 1000), (1, 1001), (2, 1499)] + [(3, 1000 + i) for i in range(400)] + [(4, 1000 + i) for i in range(495)]
    pos = spark.createDataFrame(rows, "qid long, item long")
    got = {}
    for r in E.negatives(pos, items, 40).collect():
        got.setdefault(r["qid"], []).append(r["item"])
    assert {q: len(v) for q, v in got.items()} == {1: 40, 2: 40, 3: 40, 4: 5}
    assert all(len(set(v)) == len(v) and not {(q, i) for i in v} & set(rows) and all(1000 <= i < 1500 for i in v) for q, v in got.items())
    assert sorted(map(tuple, E.negatives(pos, items, 40).collect())) == sorted((q, i) for q, v in got.items() for i in v)
    assert E.negatives(pos, items.where("false"), 40).count() == 0


def test_similar_pairs_and_nearest_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{i}", rng.normal(size=6).tolist()) for i in range(120)] + [("zero", [0.0] * 6), ("none", None)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    real = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    expected = {(a, b) for a in real for b in real if a < b and real[a] @ real[b] > 0.5}
    for size in (17, 1000):
        got = N.similar_pairs(df, 0.5, block_rows=size).collect()
        assert {(r["a"], r["b"]) for r in got} == expected and len(got) == len(expected)
        assert all(abs(r["cosine"] - real[r["a"]] @ real[r["b"]]) < 1e-12 for r in got)
    asks = spark.createDataFrame([(i, v) for i, v in enumerate([rows[0][1], rows[7][1]])], "qid int, vector array<double>")
    items = df.where("vector IS NOT NULL").withColumnRenamed("id", "item")
    for sizes in ((1, 13), (100, 1000)):
        got = {(r["qid"], r["rank"]): r["item"] for r in N.nearest(asks, items, 5, *sizes).collect()}
        for q, v in enumerate([rows[0][1], rows[7][1]]):
            best = sorted((-float(np.dot(v, w)), i) for i, w in rows if w)[:5]
            assert [got[q, r] for r in range(1, 6)] == [i for _, i in best]


def test_common_subsequence_equals_the_table():
    rng = random.Random(4)
    words = ["", "a", "same", "same"] + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(40))) for _ in range(60)]
    pairs = [(x, y) for x in words[:20] for y in words]

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    got = X.common_subsequence.func(pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs]))
    assert got.tolist() == [table(x, y) for x, y in pairs]


def test_lines_without_numbers_name_candidates_too(spark):
    answers = spark.createDataFrame([(1, "Here are the candidate movies:\n1. Red Widget\nblue ring of old\n2. red widget\n\nGrean Bolt"), (2, "")], "qid int, answer string")
    candidates = spark.createDataFrame([(1, 0, 10, "blue ring"), (1, 1, 11, "Green Bolt"), (1, 2, 12, "Red Widget"), (2, 0, 10, "x")], "qid int, pos int, item int, text string")
    got = {(r["qid"], r["item"]): r["score"] for r in X.ranked_by_text(answers, candidates, 5, share=0.8).collect()}
    assert got == {(1, 12): 5, (1, 10): 4, (1, 11): 3}


def test_bisection_evaluates_both_ends_and_the_middle_before_it_stops():
    seen = []
    best, values = T.bisect_threshold(lambda t: seen.append(t) or -abs(t - 0.3))
    assert seen[:3] == [-2.0, 0.0, 2.0] and len(seen) == len(set(seen)) and best == max(values, key=values.get)
    assert T.bisect_threshold(lambda t: 0.0)[0] == -2.0
    assert len(T.bisect_threshold(lambda t: t, most_rounds=1)[1]) == 3


def test_best_row_of_all(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "config string, m double")
    assert [tuple(r) for r in E.best_rows(df, "m").collect()] == [("a", 1.0)]
    assert E.best_rows(df.where("false"), "m").count() == 0


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "none"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_resolvents_and_push_equal_the_series(spark):
    edges = spark.createDataFrame([(i, f"t{(i * k) % 5}", 1) for i in range(12) for k in (1, 2, 3)], "item int, tag string, w int").groupBy("item", "tag").agg(F.sum("w").alias("w"))
    s = G.normalised(edges)
    moves = scratch.saved(G.tag_transitions(s), "moves")
    start = s.select(F.col("tag").alias("qid"), "tag", F.lit(1.0).alias("v")).distinct()
    factors = [0.36, 0.81, 0.0]
    got = {(r["c"], r["qid"], r["tag"]): r["v"] for r in G.resolvents(start, moves, factors, scratch.cut).collect()}
    assert len(got) == len(factors) * (1 + 4 * 4)  # t0 is alone
    tags = sorted({r["a"] for r in moves.collect()})
    a = np.zeros((len(tags), len(tags)))
    for r in moves.collect():
        a[tags.index(r["a"]), tags.index(r["b"])] = r["t"]
    for c in factors[:2]:
        full = np.linalg.inv(np.eye(len(tags)) - c * a)
        one = {(q, t): full[i, j] for i, q in enumerate(tags) for j, t in enumerate(tags) if (c, q, t) in got}
        assert all(got[c, *k] == pytest.approx(v, abs=1e-11) for k, v in one.items())
        near = G.push(start, moves, c, scratch.cut, 1e-7).collect()
        assert all(abs(r["v"] - one[r["qid"], r["tag"]]) < 1e-6 and r["left"] <= 1e-7 for r in near)
    assert all(got[0.0, q, t] == pytest.approx(float(q == t), abs=1e-12) for c, q, t in got if c == 0.0)


def test_push_touches_what_it_reaches_alone(spark):
    # a path of 200 items and tags: a query at its end leaves all but a few tags alone
    edges = spark.createDataFrame([(i, f"t{j:03}", 1) for i in range(200) for j in (i, i + 1)], "item int, tag string, w int")
    s = scratch.saved(G.normalised(edges), "s")
    start = spark.createDataFrame([(1, "t000", 1.0)], "qid int, tag string, v double")
    found = G.push(start, scratch.saved(G.tag_transitions(s), "moves"), 0.36, scratch.cut, 1e-4)
    assert 3 < found.count() < 15

def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_counts_never_broadcast_sessions_and_gather_items_first(spark):
    items = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (3, None)], "session_id long, item long")
    labels = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", None]), (3, ["c"]), (4, ["a"])], "session_id long, labels array<string>")
    assert {tuple(r) for r in T.item_label_counts(items, labels).collect()} == {(10, "a", 2), (10, "b", 1), (11, "a", 1), (11, "b", 1), (None, "c", 1)}
    assert {tuple(r) for r in T.item_label_counts(items, labels, dedup=False).where("item = 10 AND label = 'a'").collect()} == {(10, "a", 3)}
    plan = physical(T.item_label_counts(items, labels))
    assert "Broadcast" not in plan and "REBALANCE_PARTITIONS_BY_COL" in plan


def test_negatives_of_a_large_catalogue_broadcast_nothing_and_keep_the_order_of_draws(spark):
    items = spark.range(70_000).select((F.col("id") * 2).alias("item"), F.col("id").alias("idx"))
    own = spark.createDataFrame([(q, q * 2 + k) for q in range(30) for k in (0, 2)] + [(99, None)], "qid long, item long")
    got = E.negatives(own, items, 5, order=True)
    assert "Broadcast" not in physical(got)
    expected = set()
    for q in [*range(30), 99]:
        mine, new = {r[1] for r in own.collect() if r[0] == q} if q < 30 else set(), []
        for d in range(104):
            item = int(hashlib.md5(f"42|test|{q}|{d}".encode()).hexdigest()[:15], 16) % 70_000 * 2
            if item not in mine and item not in new:
                new.append(item)
        expected |= {(q, item, k) for k, item in enumerate(new[:5], 1)}
    assert {tuple(r) for r in got.collect()} == expected


def test_prediction_domain_broadcasts_neither_the_domain_nor_the_events(spark):
    domain = spark.range(3).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("item"))
    seen = spark.range(2).select((F.col("id") * 2).alias("user"), (F.col("id") + 1).cast("int").alias("item"))  # (0, 1), (2, 2)
    bought = spark.range(1).select(F.col("id").alias("user"), F.lit(1).alias("item"))
    got = S.prediction_domain(domain, seen, bought)
    assert "Broadcast" not in physical(got)
    assert rows(got) == [(u, i) for u in range(3) for i in range(4) if (u, i) != (2, 2)]


def test_tasks_of_the_counts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_ROWS", 10)
    items = spark.range(100).select((F.col("id") % 50).alias("session_id"), (F.col("id") % 25).alias("item"))
    labels = spark.range(50).select(F.col("id").alias("session_id"), F.array(F.lit("a")).alias("labels"))
    counts = T.item_label_counts(items, labels)
    plan = physical(counts)
    # one shuffle of the items, before repeated ones go, by sessions alone
    assert "hashpartitioning(session_id#" in plan and ", 10), REPARTITION_BY_NUM" in plan and "keys=[session_id" in plan
    assert rows(counts) == [(i, "a", 2) for i in range(25)]


def test_coverage_counts_once(spark, monkeypatch):
    from compare import SF
    from loomtag.plans import tagging_queries as Q2

    made, real = [], T.item_label_counts
    monkeypatch.setattr(T, "item_label_counts", lambda *a: made.append(1) or real(*a))
    Q2.tag_coverage(spark, SF).collect()
    assert len(made) == 1


def test_preference_histogram_query_shuffles_by_rows(spark, monkeypatch):
    from compare import SF
    from loomtag.plans import text_queries as Q3

    monkeypatch.setattr(T, "TASK_ROWS", 1000)  # 6,000 lines
    plan = physical(Q3.preference_hist(spark, SF))
    assert "Broadcast" not in plan and plan.count(", 6), REPARTITION_BY_NUM") == 3


def test_grids_never_broadcast_users_or_items(spark):
    from loomtag.plans import evaluation_queries as V2

    corpus = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"])], "item int, tags array<string>")
    asks = spark.createDataFrame([(7, "a", 1.0), (8, "c", 1.0)], "qid long, tag string, weight double")
    c = spark.createDataFrame([(7, 1, 1), (7, 2, 0), (8, 3, 1)], "qid long, item int, is_pos int")
    plan = physical(G.normalised(C.edges(corpus)))
    assert "SortMergeJoin [item#" in plan
    plan = physical(V2._bm25_grid(c, corpus, asks, [(0.5, 0.5)]))
    assert plan.count("SortMergeJoin [item#") == 2 and "SortMergeJoin [qid#" in plan
    scores = V2._bm25_grid(c, corpus, asks, [(0.5, 0.5)])
    plan = physical(V2._grid_metrics(c, scores, V2._table(spark, ["k1", "b"], [(0.5, 0.5)]), ("k1", "b")))
    assert any("SortMergeJoin" in x and "LeftOuter" in x for x in plan.splitlines())


def test_items_with_equal_tags_are_scored_once(spark, monkeypatch):
    random_ = random.Random(3)
    bags = [random_.sample("abcdefgh", 3) for _ in range(12)]
    corpus = spark.createDataFrame([(i, random_.sample(bags[i % 12], 3)) for i in range(120)], "item int, tags array<string>")
    asks = spark.createDataFrame([(q, t, 1.0) for q, b in enumerate(bags) for t in b], "qid long, tag string, weight double")
    plain = B.top_n(B.scored(asks, B.postings(corpus)).withColumn("score", F.round("score", 6)), 7)
    seen, real = [], B.bounded_scores
    monkeypatch.setattr(B, "bounded_scores", lambda q, p, *a, **k: seen.append(p.select("item").distinct().count()) or real(q, p, *a, **k))
    best = B.best_items(asks, corpus, B.tag_classes(corpus), 7)
    assert rows(best.select("qid", "item", "score", "rank")) == rows(plain.select("qid", "item", "score", "rank"))
    assert 0 < seen[0] <= 12


def _twins(spark):
    """60 items of 7 sets of tags, one item apart from the rest and one set in another order."""
    bags = [["a", "b"], ["b", "c", "c"], ["c", "d"], ["d", "a", "e"], ["e", "f"], ["f", "b"], ["g"]]
    return scratch.saved(C.edges(spark.createDataFrame([(i, bags[i % 7][:: 1 if i % 2 else -1]) for i in range(60)], "item int, tags array<string>")), "edges")


def test_birank_computes_equal_items_and_queries_once(spark, monkeypatch):
    edges = _twins(spark)
    asks = spark.createDataFrame([(q, i, 1.0) for q, i in ((1, 0), (2, 7), (3, 1), (4, 8), (4, 15), (5, 99), (6, 3), (7, 3), (7, 99))], "qid int, item int, weight double")
    s = G.normalised(edges)
    full = scratch.saved(G.tag_transitions(s), "t")
    seen, real = [], G.push
    monkeypatch.setattr(G, "push", lambda start, *a, **k: seen.append(start.select("asks").distinct().count()) or real(start, *a, **k))
    got = {(r["qid"], r["item"]): r["score"] for r in G.birank_items(asks, edges, scratch.cut, 0.6, 0.6, 1e-12).collect()}
    assert seen == [5]  # 1 and 2 ask alike; 5 asks for nothing known, 6 and 7 differ by such an item
    start = asks.join(s, "item").groupBy("qid", "tag").agg(F.sum(F.col("weight") * F.col("s")).alias("v"))
    expected = {(r["qid"], r["item"]): 0.4 * 0.36 * r["v"] for r in real(start, full, 0.36, scratch.cut, 1e-12).join(s, "tag").groupBy("qid", "item").agg(F.sum(F.col("v") * F.col("s")).alias("v")).collect()}
    for q, i, w in asks.collect():
        expected[q, i] = expected.get((q, i), 0.0) + 0.4 * w
    assert got == pytest.approx(expected, abs=1e-10) and len(got) > 200
    tagged = edges.where("item < 15").select(F.col("item").alias("qid"), "tag", F.col("w").cast("double").alias("weight"))
    got = {(r["qid"], r["item"]): r["score"] for r in G.birank_tags(tagged, edges, scratch.cut, 0.6, 0.6, 1e-12).collect()}
    assert seen == [5, 7]
    start = tagged.select("qid", "tag", F.col("weight").alias("v"))
    expected = {(r["qid"], r["item"]): 0.24 * r["v"] for r in real(start, full, 0.36, scratch.cut, 1e-12).join(s, "tag").groupBy("qid", "item").agg(F.sum(F.col("v") * F.col("s")).alias("v")).collect()}
    assert got == pytest.approx(expected, abs=1e-10)


def test_pagerank_over_tags_equals_the_walk_over_all_nodes(spark):
    edges = _twins(spark)
    start = spark.createDataFrame([(1, 0, 1.0), (2, 7, 1.0), (3, 1, 0.25), (3, 8, 0.5), (3, 4, 0.25), (4, 6, 1.0), (5, 99, 1.0)], "qid int, item int, x0 double")
    nodes = start.select("qid", F.concat(F.lit("i:"), F.col("item").cast("string")).alias("node"), "x0")
    for stop in ({"tol": 0.03}, {"rounds": 2, "tol": 0.0}):
        got = {(r["qid"], r["node"]): r["score"] for r in G.pagerank_items(start, edges, scratch.cut, **stop).collect()}
        expected = {(r["qid"], r["node"]): r["score"] for r in G.pagerank(nodes, G.homogeneous(edges), scratch.cut, **stop).collect()}
        assert got == pytest.approx(expected, abs=1e-12), stop


def test_a_row_without_structure_is_shipped_once_for_a_part(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(2000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    home, visiting = N.meetings(df, 0.5, 250)
    # 8 parts of about 250 rows: half of them at most, and what dealing adds; 64 small blocks would be some 30 visits each
    assert home.select("k").distinct().count() == 2000 and visiting.count() < 8 * 2000
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = int((np.triu(unit @ unit.T, 1) > 0.5).sum())
    got = N.similar_pairs(df, 0.5, 250)
    assert got.count() == expected == got.select("a", "b").distinct().count()


def test_parts_in_which_items_are_counted_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_ROWS", 10)
    items = spark.range(100).select((F.col("id") % 50).alias("session_id"), (F.col("id") % 25).alias("item"))
    labels = spark.range(50).select(F.col("id").alias("session_id"), F.array(F.lit("a")).alias("labels"))
    counts = T.item_label_counts(items, labels)
    assert ", 10), REBALANCE_PARTITIONS_BY_COL" in physical(counts)
    assert rows(counts) == [(i, "a", 2) for i in range(25)]


def test_merging_vectors_needs_no_pairs(spark, monkeypatch):
    from compare import SF
    from loomtag.plans import evaluation_queries as V2

    rng = np.random.default_rng(12)
    tags = [(f"v{i}", 1 + i % 7, rng.normal(size=6).tolist()) for i in range(150)] + [("zero", 9, [0.0] * 6), ("none", 0, None)] + [(f"c{i}", 1, [1.0] * 6) for i in range(60)]
    df = spark.createDataFrame(tags, "tag string, n long, vector array<double>").repartition(3)
    merged = C.merged_tags(N.similar_pairs(df, 0.6, key="tag"), df.select("tag", "n"), cut)
    plain = sorted(map(tuple, merged.collect()))
    monkeypatch.setattr(N, "similar_pairs", None)  # its rows grow with the square of the tags
    for batch_rows, part_rows in ((40, 17), (4096, 16_384)):
        got = N.merged_vectors(df, 0.6, batch_rows, part_rows)
        assert sorted(map(tuple, got.collect())) == plain and len(plain) == 212
    assert N.merged_vectors(df.where("tag = 'none'"), 0.6).collect() == [("none", "none")] and N.merged_vectors(df.where("false"), 0.6).count() == 0
    assert V2.tag_merge(spark, SF).count() == 500  # all vectors of sf0.001


def test_documents_are_scored_where_they_lie(spark, monkeypatch):
    from compare import SF
    from loomtag.plans import ranking_queries as R

    random_ = random.Random(8)
    texts = [" ".join(random_.choices("abcdefghijklmnop", range(1, 17), k=random_.randrange(1, 30))) for _ in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9] + ["", None])], "item long, text string")
    asks = spark.createDataFrame([(q, t, w) for q in range(12) for t, w in ((random_.choice("abcdefg"), 1.0), (random_.choice("hijk"), 0.5), ("absent", 2.0))], "qid long, tag string, weight double")
    tags = F.filter(F.split("text", " "), lambda t: t != "")
    index = B.postings(docs.select("item", tags.alias("tags")), terms=asks)
    plain = B.top_n(B.scored(asks, index).withColumn("score", F.round("score", 6)), 5).select("qid", "item", "score", "rank")
    monkeypatch.setattr(B, "TASK_SCORES", 100)
    best = B.best_documents(asks, docs, tags, 5)
    assert rows(best.select("qid", "item", "score", "rank")) == rows(plain) and len(rows(plain)) > 50
    assert rows(B.best_documents(asks, docs.where("false"), tags, 5)) == []
    import pyarrow.parquet as pq

    pairs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).num_rows * pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id"]).num_rows
    monkeypatch.setattr(B, "TASK_SCORES", pairs // 9)
    plan = physical(R.bm25_documents(spark, SF))
    # documents go to tasks that follow their number, then only asked terms and the best of a task are shuffled
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("REPARTITION_BY_NUM") == 1, plan
    assert any("hashpartitioning(item#" in x and (", 9), REPARTITION_BY_NUM" in x or ", 10), REPARTITION_BY_NUM" in x) for x in plan.splitlines()) and "SortMergeJoin" not in plan, plan


def test_birank_over_tags_is_asked_by_every_item(spark):
    from compare import SF

    from loomtag.plans import catalog

    got = catalog.QUERIES["birank_tag"](spark, SF)
    asked = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey")
    assert rows(got.select(F.col("qid").cast("long")).distinct()) == rows(asked)


def test_pagerank_is_asked_by_every_user(spark):
    from compare import SF

    from loomtag.plans import catalog

    got = catalog.QUERIES["pagerank_user"](spark, SF)
    asked = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct()
    assert rows(got.select("qid").distinct()) == rows(asked)


def test_equal_items_and_queries_are_given_back_as_arrays_in_tasks_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_ROWS", 100)
    monkeypatch.setattr(G, "TOGETHER", 3)
    twins = spark.createDataFrame([(i, i % 5) for i in range(60)], "item int, rep int")
    same = spark.createDataFrame([(q, q % 2) for q in range(20)], "qid int, asks int")
    found = spark.createDataFrame([(a, r, a + r / 10) for a in range(2) for r in range(5)], "asks int, rep int, score double")
    got = G.given_back(found, twins, same, name=F.concat(F.lit("i:"), F.col("item").cast("string")))
    plan = physical(got)
    assert plan.count("Generate explode") == 2 and "Broadcast" not in plan and plan.count(", 12), REPARTITION_BY_NUM") == 2
    assert rows(got) == sorted((q, f"i:{i}", q % 2 + (i % 5) / 10) for q in range(20) for i in range(60))


def test_transitions_never_broadcast_items(spark):
    edges = scratch.saved(_twins(spark), "edges")
    for moves in (G.tag_transitions(scratch.cut(G.normalised(edges))), G.class_transitions(G.normalised_classes(G.classes(edges)[1]))):
        assert "Broadcast" not in physical(moves)
    full = {(r["a"], r["b"]): r["t"] for r in G.tag_transitions(G.normalised(edges)).collect()}
    few = {(r["a"], r["b"]): r["t"] for r in G.class_transitions(G.normalised_classes(G.classes(edges)[1])).collect()}
    assert few == pytest.approx(full, abs=1e-12)


@pytest.mark.parametrize("normalizer", ["HITS", "BiRank"])
def test_whole_graph_ranking_moves_one_item_for_all_alike(spark, monkeypatch, normalizer):
    edges = _twins(spark).collect()
    seen = []

    def watched(df):
        seen.append(df.count())
        return scratch.cut(df)

    got = {(r["side"], r["node"]): r["score"] for r in G.birank(_twins(spark), normalizer, watched, rounds=3, tol=0.0).collect()}
    assert max(seen) == 7 + 7  # classes and tags
    items, tags = sorted({r["item"] for r in edges}), sorted({r["tag"] for r in edges})
    w = np.zeros((len(items), len(tags)))
    for r in edges:
        w[items.index(r["item"]), tags.index(r["tag"])] = r["w"]
    s = w if normalizer == "HITS" else w / np.sqrt(w.sum(1)[:, None] * w.sum(0)[None, :])
    i, t = np.full(len(items), 1 / len(items)), np.full(len(tags), 1 / len(tags))
    for _ in range(3):
        i, t = 0.85 * s @ t + 0.15 / len(items), 0.85 * s.T @ i + 0.15 / len(tags)
        if normalizer == "HITS":
            i, t = i / i.sum(), t / t.sum()
    assert got == pytest.approx({("item", str(k)): v for k, v in zip(items, i)} | {("tag", k): v for k, v in zip(tags, t)}, abs=1e-12)


def test_history_grid_equals_each_weighting(spark):
    h = spark.createDataFrame([(1, [5, 6, 5, 7]), (2, [6]), (3, []), (4, [7, 7, 5])], "qid int, seq array<int>")
    grid = [(r, kind, most) for r in ("sum", "union") for kind in (None, "linear", "log2", "exp") for most in (None, 2, 3)]
    got = B.history_grid(h, grid).collect()
    for i, (r, kind, most) in enumerate(grid):
        one = {(x["qid"], x["item"]): x["weights"][i] for x in got if x["weights"][i] is not None}
        assert one == pytest.approx({(x["qid"], x["item"]): x["weight"] for x in B.history_weights(h, r, kind, most).collect()}), (r, kind, most)


def test_grid_is_ranked_in_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(G, "GROUP_CELLS", 30)
    random_ = random.Random(5)
    edges = _twins(spark)
    h = spark.createDataFrame([(q, [random_.randrange(62) for _ in range(1 + q % 4)]) for q in range(12)], "qid int, seq array<int>")
    c = spark.createDataFrame([(q, i, int(j < 1 + q % 2)) for q in range(11) for j, i in enumerate(random_.sample(range(63), 15))], "qid int, item int, is_pos int")
    own, pairs = [("sum", None, None), ("union", "linear", 2)], [(0.5, 0.5), (0.5, 0.9), (0.9, 0.5)]
    got = G.grid_gains(c, h, lambda x: B.history_grid(x, own), edges, 2, pairs, scratch.cut)
    assert physical(got).count("FlatMapCoGroupsInPandas") == 1
    got = {r["at"]: r["ndcg"] for r in got.collect()}
    for at, o, (a, b) in ((1, own[0], pairs[1]), (5, own[1], pairs[2])):
        scores = G.birank_items(B.history_weights(h, *o), edges, scratch.cut, a, b, 1e-13, 9)
        m = E.mean_metrics(E.query_metrics(E.ranked(c, scores), (10,))).first()
        assert got[at] == pytest.approx(m["ndcg"], abs=1e-9), (o, a, b)
    assert len(got) == 6


@pytest.mark.parametrize("alike", [False, True])
def test_lists_are_ranked_for_a_threshold_without_a_shuffle_of_candidates(spark, alike):
    random_ = random.Random(9)
    labels = [f"l{j}" for j in range(9)]
    # alike: most items have the same frequency, so the quartile gaps are empty and adjustments infinite
    counts = spark.createDataFrame([(i, l, 1 + j if alike and i % 6 else random_.randrange(1, 9)) for i in range(24) for j, l in enumerate(labels)], "item int, label string, cnt long")
    base = spark.createDataFrame([(i, random_.choices("abcd", k=3)) for i in range(26)], "item int, tags array<string>")
    c = scratch.saved(spark.createDataFrame([(q, i, int(j == 0)) for q in range(20) for j, i in enumerate(random_.sample(range(28), 14))], "qid int, item int, is_pos int"), "c")
    asks = spark.createDataFrame([(q, [q % 27]) for q in range(20)], "qid int, seq array<int>")
    items = scratch.saved(T.threshold_items(base, counts), "items")
    lists = scratch.saved(E.candidate_lists(c, asks.select("qid", F.get("seq", F.lit(0)).alias("item")), items), "lists")
    none = counts.where("false").select("item", F.lit("").alias("pattern"), F.lit("").alias("level"))
    for t in (-2.0, 0.3):
        corpus = scratch.saved(T.enhanced(base, T.zscore_tags(counts, T.TagConfig(levels=((t, " Preference"),))), none), "corpus")
        made = items.select("item", T.threshold_tags(F.col("base"), F.col("labels"), t).alias("tags"))
        assert rows(made) == rows(corpus)
        scores = B.scored(B.history_queries(B.history_weights(asks, "last"), corpus), B.postings(corpus), c).withColumn("score", F.round("score", 6))
        expected = E.mean_metrics(E.query_metrics(E.ranked(c, scores), (10,))).first()["ndcg"]
        found = E.listed_ndcg(lists, items, lambda base, labels: T.threshold_tags(base, labels, t), 10)
        assert physical(found).split("Subquery")[0].count("Exchange") == 1  # that of the mean
        assert found.first()["ndcg"] == pytest.approx(expected, abs=1e-12)
