import corpus_pipeline as P
from fixtures import SF, TEXTS, edge_docs, empty_docs, near_groups, words
from test_lines import brute

from loomtag.llm.shared import saved


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = saved(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["language_id"]
    assert after.count() >= 0.95 * before.count()
    before, after = seen["line_dedup"]
    assert sorted(r["doc_id"] for r in before.collect()) == sorted(r["doc_id"] for r in after.collect())
    before, after = seen["near_dedup"]
    groups = near_groups([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in groups.values()})
    before, after = seen["mixing"]
    counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 and set(counts) <= {r["doc_id"] for r in before.collect()}
    packed = P.pack(spark, docs, SF).collect()
    assert sum(r["length"] for r in packed) == sum(len(words(r["text"])) for r in docs.collect())


def test_stages_on_awkward_and_empty_documents(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        columns, kept = docs.columns, {}
        for name, stage in P.STAGES[:-1]:
            docs = saved(stage(spark, docs, SF), "stage")
            assert docs.columns == columns
            kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        packed = P.pack(spark, docs, SF).collect()
        if not kept["language_id"]:
            assert not packed and not any(kept.values())
            continue
        # texts without a letter go, and lines on most pages of a small site; one of each group of copies stays, all rows without an id
        own = [(i, t) for i, t, *_ in TEXTS]
        assert kept["language_id"] == sorted(((i, t) for i, t in own if t and any(c.isalpha() for c in t)), key=str)
        rows = [r for r in TEXTS if r[1] and any(c.isalpha() for c in r[1])]
        assert kept["line_dedup"] == [(i, t) for i, t, _, _ in brute(rows, P.lines.RATIO)]
        groups = near_groups([(i, t) for i, t in kept["line_dedup"] if i is not None], 5)
        assert kept["near_dedup"] == sorted([(i, t) for i, t in dict((r for r in kept["line_dedup"] if r[0] is not None)).items() if groups[i][1] == i] + [r for r in kept["line_dedup"] if r[0] is None], key=str)
        assert set(kept["mixing"]) <= set(kept["near_dedup"]) and sum(r["length"] for r in packed) == sum(len(words(t)) for _, t in kept["mixing"])


def test_lines_go_at_any_size_of_a_site(spark):
    # "small" is on all of 19 pages, "hot" on 80 of 3,000 (2.7 %), "once" on 25 of 3,000 (0.8 %)
    rows = [(i, f"small\nown {i}", "en", "a") for i in range(19)]
    rows += [(100 + i, ("hot\n" if i < 80 else "once\n" if i < 105 else "") + f"own {100 + i}", "en", "b") for i in range(3000)]
    got = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, edge_docs(spark, rows), SF).collect()}
    assert all(got[i] == f"own {i}" for i in (0, 18, 100, 179)) and got[180] == "once\nown 180" and len(got) == 3019


def test_sequences_follow_the_order_of_training(spark):
    docs = edge_docs(spark, [(i, " ".join(f"w{i}" for _ in range(50 + i * 37 % 400)), "en", "abc"[i % 3]) for i in range(3000)])
    # the order itself: each copy with its position, as the mixing stage sorts them
    order = [(r["doc_id"], r["position"]) for r in P.mixing.assigned(docs).selectExpr("row.doc_id", "explode(positions) AS position").orderBy("position").collect()]
    copies = saved(P.mix(spark, docs, SF), "mixed")
    rows = sorted((r for r in P.pack(spark, copies, SF).collect() if r["length"]), key=lambda r: (r["bin_id"], r["bin_offset"]))
    assert len(rows) == len(order)
    groups = {}
    for r in rows:
        groups.setdefault(r["bin_id"] >> 32, []).append(r["doc_id"])
    at, off = 0, 0
    assert len(groups) > 20
    for g in sorted(groups):
        # a group holds the documents of the next stretch of the order, each as often as it occurs there
        expected = sorted(i for i, _ in order[at : at + len(groups[g])])
        off += len(expected) - sum(a == b for a, b in zip(expected, sorted(groups[g]), strict=True))
        at += len(groups[g])
    assert off == 0


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is P.run and [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    assert {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")} == set(range(1, 14))
