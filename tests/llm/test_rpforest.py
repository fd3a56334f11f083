import numpy as np

from loomtag.llm import rpforest


def brute(rows, queries, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(float(np.float32(x)) for x in v)), None)
    out = []
    for q in sorted({(i, v) for i, v in good if i in queries}):
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(q[1], v, strict=True)))), i) for i, v in good if i != q[0])
        near = sorted(set(near))[:k]
        out += [(q[0], r, i, round(s, 9)) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(300, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    rows += [(400, None), (500, [0.0] * 4), (600, [1.0, None, 2.0, 3.0]), (700, [float("nan"), 1.0, 1.0, 1.0]), (800, [float("inf"), 1.0, 1.0, 1.0]), (900, [1.0, 2.0]), (1000, [-0.0, 0.0, 0.0, 1.0]), (1001, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, score int, `key` string")
    got = rpforest.search(df, df.where("vec_id % 100 = 0"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect())
    assert found == brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0})
    assert rpforest.search(df.where("false"), df.where("false")).count() == 0
    assert rpforest.search(df, df.where("false")).count() == 0


def recall(df, **options):
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in rpforest.search(df, df.where("vec_id % 100 = 0"), **options).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len({*best} & {*got[q]}), total + 10
        assert all(abs(s - d[ids == i][0]) < 1e-12 for i, s in got[q].items())
    return hits / total


def test_recall_with_many_leaves(spark):
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), leaf_rows=64) >= 0.9


def test_recall_where_the_sample_ends_before_the_leaves_do(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "SAMPLE", 128)
    monkeypatch.setattr(rpforest, "MOST_SLABS", 4)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(df, leaf_rows=8) >= 0.9  # 8 leaves of 4 slabs, in blocks


def test_slabs_belong_to_their_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    forest = rpforest._with_slabs(rpforest.fit(x[:64], 2, trees=2), spark.createDataFrame([(v.tolist(),) for v in x], "vector array<double>"), 5)
    own = rpforest.leaves(forest, x)
    assert own.max() == 19 and all(np.bincount(own[t], minlength=20).min() > 5 for t in (0, 1))
    for i in range(20):
        order = rpforest.visits(forest, x[i], 100)
        assert len(order) == len(set(order)) == 40 and {(0, own[0][i]), (1, own[1][i])} <= {*order[:4]}  # a row on the edge of a slab lies in two


def test_one_queue_visits_every_leaf_once():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(256, 8))
    forest = rpforest.fit(sample, 3, trees=2)
    order = rpforest.visits(forest, sample[0], 100)
    assert len(order) == len(set(order)) == 16
    own = rpforest.leaves(forest, sample[:1])[:, 0]
    assert order[0] == (0, own[0]) and (1, own[1]) in order[:3]
