import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import WORD, edge_docs, empty_docs
from pyspark.sql import functions as F

from loomtag.llm import ordinal


def test_held_out_grades(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    graded = labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = ordinal.learn(docs, graded.where("doc_id % 2 = 0"), levels=3)
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.grades(docs.where("doc_id % 2 = 1"), model).join(graded, "doc_id").collect()
    good, bad = [r for r in got if r["grade"] == 2], [r for r in got if r["grade"] < 2]
    assert np.mean([r["tail_prob"] >= 0.5 for r in good]) >= 0.97
    assert np.mean([r["tail_prob"] < 0.5 for r in bad]) >= 0.95
    assert np.mean([r["expected_grade"] for r in bad]) < np.mean([r["expected_grade"] for r in good])


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    for levels in (2, 3, 5):
        scores, th = rng.normal(0, 2, 40), np.cumsum(rng.uniform(0.3, 2, levels - 1)) - 2
        y, cost = rng.integers(0, levels, 40), rng.uniform(0.2, 3, 40)
        _, g_s, g_th = ordinal.loss_and_gradients(scores, th, y, cost)
        for x, g in ((scores, g_s), (th, g_th)):
            for i in range(len(x)):
                sides = []
                for step in (1e-5, -1e-5):
                    moved = x.copy()
                    moved[i] += step
                    sides.append(ordinal.loss_and_gradients(moved if x is scores else scores, moved if x is th else th, y, cost)[0])
                assert g[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-5)


def test_likelihood_equals_plain_python():
    scores, th, y, cost = np.array([0.3, -1.2, 2.0]), np.array([-0.5, 1.0]), np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])
    p = lambda z: 1 / (1 + math.exp(-z))
    chances = [p(-0.5 - 0.3), p(1.0 + 1.2) - p(-0.5 + 1.2), 1 - p(1.0 - 2.0)]
    assert ordinal.loss_and_gradients(scores, th, y, cost)[0] == pytest.approx(-sum(c * math.log(x) for c, x in zip(cost, chances)), abs=1e-9)


def test_weights_go_both_ways():
    lists = [np.array([1, 9]), np.array([2, 9]), np.array([3, 9])] * 40
    model = ordinal.train([np.sort(x) for x in lists], np.array([0, 1, 2] * 40), 3, steps_least=600)
    assert model.weights[1] < model.weights[2] < model.weights[3] and model.weights[3] > 0 > model.weights[1]
    grades = ordinal.cumulative(model, ordinal._scores(model.weights, np.concatenate(lists[:3]), np.repeat([0, 1, 2], 2), 3)).sum(axis=1)
    assert grades[0] < 0.4 and 0.6 < grades[1] < 1.4 and grades[2] > 1.6


def plain_features(text):
    """Words without marks, last two characters, and shares of words that repeat the one before."""
    w = WORD.findall(text or "")
    names = [(x.lower().strip(ordinal._MARKS) or x) for x in w] + ["$" + x[-2:] for x in w]
    again = sum(a == b for a, b in zip(w, w[1:]))
    names += [f"same again {k}" for k in ordinal.REPEATED if again * k > len(w)]
    return {xxhash.xxh32_intdigest(x) % ordinal.FEATURES for x in names}


def test_query_scores_equal_plain_python(spark):
    docs = edge_docs(spark)
    rng = np.random.default_rng(1)
    model = ordinal.Model(rng.normal(size=ordinal.FEATURES), np.array([-1.0, 0.4]))
    got = sorted((str(r["doc_id"]), round(r["expected_grade"], 9), round(r["tail_prob"], 9)) for r in ordinal.grades(docs, model).collect())
    expected = []
    for r in docs.collect():
        score = sum(model.weights[f] for f in plain_features(r["text"]))
        above = [1 / (1 + math.exp(-(min(40, max(-40, score - t))))) for t in model.thresholds]
        expected.append((str(r["doc_id"]), round(sum(above), 9), round(above[-1], 9)))
    assert got == sorted(expected)


def test_a_binding_bound_draws_the_same_rows(spark):
    docs = edge_docs(spark, [(i, f"word{i % 5} text {i}", "en", "a") for i in range(300)])
    graded = spark.createDataFrame([(i, i % 3) for i in range(300)], "doc_id long, grade int")
    models = [ordinal.learn(d, graded, levels=3, per_grade=8) for d in (docs, docs.repartition(5))]
    assert (models[0].weights == models[1].weights).all() and (models[0].thresholds == models[1].thresholds).all()


def test_probabilities_are_ordered():
    model = ordinal.Model(np.zeros(ordinal.FEATURES), np.array([-1.0, 0.5, 2.0]))
    above = ordinal.cumulative(model, np.linspace(-5, 5, 11))
    assert (np.diff(above, axis=1) < 0).all() and (np.diff(above, axis=0) > 0).all()


def test_features_are_distinct_within_a_text():
    f, owner = ordinal.features(pa.array(["a a a a", None, "", "b c. b c."]))
    assert set(owner) == {0, 3} and len({*zip(f, owner, strict=True)}) == len(f)


def test_awkward_documents_and_labels(spark):
    docs = edge_docs(spark)
    graded = spark.createDataFrame([(1, 2), (2, 2), (4, 0), (None, 1), (8, None), (10, 0), (99, 1), (7, 9)], "doc_id long, grade int")
    model = ordinal.learn(docs, graded, levels=3)
    got = ordinal.grades(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    nothing = ordinal.learn(empty_docs(spark), graded, levels=3)
    assert not nothing.weights.any() and ordinal.grades(empty_docs(spark), nothing).count() == 0
