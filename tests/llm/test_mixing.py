import pytest
from compare import assert_same
from fixtures import SF, edge_docs, empty_docs, words
from pyspark.sql import functions as F

from loomtag.llm import mixing, queries


def test_query_equals_sql(spark):
    assert_same(queries.op3_curriculum(spark, SF), mixing.SQL)


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, total, stopped = set(names), float(sum(sizes.values())), {}
    while True:
        share = (total - sum(stopped.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if share * weight[s] > 3 * sizes[s]]
        if not over:
            return stopped | {s: share * weight[s] for s in left}
        for s in over:
            stopped[s] = 3.0 * sizes[s]
            left.remove(s)


def test_targets_and_copies_on_awkward_documents(spark):
    docs = edge_docs(spark)
    got = mixing.assigned(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    targets = filled(sizes)
    assert len(got) == docs.count()
    taken = {}
    for r in got:
        s = r["row"]["source"]
        assert r["size"] == len(words(r["row"]["text"])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(targets[s]) and r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(r["size"] for r in got if r["row"]["source"] == s)


def test_positions_invert_the_demand(spark):
    knots = ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5))
    df = spark.range(0, 11).select((F.col("id") / 10).alias("s")).withColumn("t", mixing.inverse_demand(F.col("s"), knots))

    def area(t):
        a = lambda x, t0, r0, slope: r0 * (x - t0) + slope * (x - t0) ** 2 / 2
        return a(min(t, 0.5), 0, 0.5, 2.0) + (a(t, 0.5, 1.5, -2.0) if t > 0.5 else 0)

    for r in df.collect():
        assert area(r["t"]) / area(1.0) == pytest.approx(r["s"], abs=1e-9)


def test_another_schedule_changes_the_positions_and_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.curriculum(docs).collect()
    flat = (((0.0, 1.0), (1.0, 1.0)),) * 3
    other = {r["doc_id"]: r for r in mixing.curriculum(docs, schedules=flat).collect()}
    late_first = {r["doc_id"]: r["position_1"] for r in mixing.curriculum(docs, schedules=mixing.SCHEDULES[::-1]).collect()}
    firsts = [r["position_1"] for r in rows if r["position_1"] is not None]
    assert firsts == sorted(firsts) and all(r["position_1"] is None for r in rows[len(firsts) :])
    assert all((other[r["doc_id"]]["taken"], other[r["doc_id"]]["target"]) == (r["taken"], r["target"]) for r in rows)
    assert sum(other[r["doc_id"]]["position_1"] != r["position_1"] for r in rows) > 0.8 * len(rows)
    order = [r["doc_id"] for r in rows if r["position_1"] is not None]
    assert order != sorted(order, key=lambda i: (late_first[i], i))
    for r in rows:
        copies = [r[f"position_{k}"] for k in (1, 2, 3) if r[f"position_{k}"] is not None]
        assert copies == sorted(copies) and len(copies) * r["size"] == r["taken"]


def test_many_sources_of_which_one_is_hot(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "hot" if i % 3 == 0 else f"host{i % 1009:04d}") for i in range(6000)] + [(None, "a b", None, None)] * 3
    docs = edge_docs(spark, rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets = filled(sizes)
    taken, got = {}, mixing.assigned(docs).collect()
    for r in got:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 7 for s, t in targets.items())


def test_training_order_keeps_columns_and_repeats(spark):
    docs = edge_docs(spark)
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(len(r["positions"]) for r in mixing.assigned(docs).collect())
    assert mixing.training_order(empty_docs(spark)).count() == 0
    assert sorted(map(str, mixing.assigned(docs).collect())) == sorted(map(str, mixing.assigned(docs).collect()))
