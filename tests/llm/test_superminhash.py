import random

import numpy as np
import pytest
from fixtures import SF, TEXTS, edge_docs, empty_docs, near_groups

from loomtag.llm import components, superminhash


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = near_groups([(r["doc_id"], r["text"]) for r in docs.collect()], size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(docs, shingle=size).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in expected.items()}


def test_large_group_of_near_copies_with_isolated_members(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(len(w)), rng.randrange(0, 14)):
            w[p] = f"z{i}p{p}"
        rows.append((i, " ".join(w), "en", "a"))
    expected = near_groups([(r[0], r[1]) for r in rows], 2)
    for rounds in (0, 1, 3):
        got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(edge_docs(spark, rows), shingle=2, star_rounds=rounds).collect()}
        assert got == {i: c for i, (_, c) in expected.items()}
    assert 1 < len(set(got.values())) < 150


def templated(n, shared, own, seed=5):
    rng = random.Random(seed)
    frame = [f"t{rng.randrange(10**6)}" for _ in range(shared)]
    return [(i, " ".join(frame[: shared // 2] + [f"o{i}x{j}" for j in range(own)] + frame[shared // 2 :]), "en", "a") for i in range(n)]


def test_templates_around_own_words_are_no_copies(spark):
    # at 0.6 and just below 0.8 nothing links; near copies of some pages do
    for own in (40, 15):
        rows = templated(600, 120, own)
        rows += [(1000 + i, text + " more", "en", "b") for i, text, _, _ in rows[:40]]
        expected = near_groups([(r[0], r[1]) for r in rows], 2)
        got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(edge_docs(spark, rows), shingle=2).collect()}
        assert got == {i: c for i, (_, c) in expected.items()}


def test_templates_make_no_candidates(spark):
    sets = spark.createDataFrame([(r[0], r[1]) for r in templated(3000, 120, 40)], "id long, text string").mapInArrow(superminhash._full_sets(2), "id long, n long, hashes array<long>, bits array<long>")
    assert superminhash._rare_pairs(sets.selectExpr("id AS rep", "id AS comp"), sets, 80).count() == 0


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(6)
    often = rng.integers(0, 200, 1 << superminhash.SKETCH_BITS).astype(np.uint8)
    pool = rng.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, rng.integers(4, 60))) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) - int(rng.integers(0, 4))], rng.choice(pool, 2)])) for s in sets]
    n = np.array([len(s) for s in sets])
    owner, token, place, indexed = superminhash.prefixes(np.concatenate(sets), n, often, 80)
    rows = [{(int(t)): (int(p), bool(i)) for t, p, i in zip(token[owner == k], place[owner == k], indexed[owner == k])} for k in range(len(sets))]
    linked = 0
    for x in range(len(sets)):
        for y in range(len(sets)):
            both = len({*sets[x].tolist()} & {*sets[y].tolist()})
            if x != y and n[x] <= n[y] and 100 * both >= 80 * (n[x] + n[y] - both):
                linked += 1
                assert any(i and t in rows[y] and min(n[x] - p, n[y] - rows[y][t][0]) * 180 >= 80 * (n[x] + n[y]) for t, (p, i) in rows[x].items())
    assert linked > 20


def test_tiny_sets_share_a_key():
    rng = np.random.default_rng(9)
    for n in range(4, 10):
        for _ in range(50):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            for y in (x, x[1:], np.concatenate([x[1:], x[:1] + np.uint64(1)])):
                both = len({*x.tolist()} & {*y.tolist()})
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    owner, key = superminhash.tiny_keys(np.concatenate([x, y]), np.array([len(x), len(y)]), 80)
                    assert {*key[owner == 0].tolist()} & {*key[owner == 1].tolist()}


def test_awkward_documents(spark):
    docs = edge_docs(spark)
    got = superminhash.near_duplicates(docs, shingle=2).collect()
    expected = near_groups([(i, t) for i, t, _, _ in TEXTS if i is not None], 2)
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
    one = superminhash.one_of_each(docs, shingle=2)
    assert one.columns == docs.columns
    ids = sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, c in expected.values()}) and one.where("doc_id IS NULL").count() == 2
    assert superminhash.near_duplicates(empty_docs(spark)).count() == 0


def test_signatures_estimate_the_similarity():
    h = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = np.concatenate([h[:200], h[100:]])
    sig = superminhash.super_minhash(both, np.repeat([0, 1], 200), 2)
    assert (sig >> np.uint64(48)).max() < superminhash.SLOTS
    assert np.mean(sig[0] == sig[1]) == pytest.approx(1 / 3, abs=0.09)
    alone = superminhash.super_minhash(h[:1], np.zeros(1, np.int64), 1)
    assert sorted((alone[0] >> np.uint64(48)).tolist()) == list(range(superminhash.SLOTS))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 5), (101, 100)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
