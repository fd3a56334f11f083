import numpy as np
from fixtures import SF, edge_docs, empty_docs, words
from pyspark.sql import functions as F

from loomtag.llm import packing


def check(docs, got, lengths=packing.LENGTHS):
    sizes = sorted((str(r["doc_id"]), len(words(r["text"]))) for r in docs.collect())
    by_bin, by_piece = {}, {}
    for r in got:
        if r["length"]:
            by_bin.setdefault(r["bin_id"], []).append(r)
            assert r["length"] <= max(lengths)
        else:
            assert r["bin_id"] is None
        by_piece.setdefault((str(r["doc_id"]), r["piece"]), []).append(r["length"])
    for rows in by_bin.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert at == rows[0]["bin_used"] and rows[0]["bin_length"] == min(c for c in lengths if c >= at)
    assert sum(r["length"] for r in got) == sum(n for _, n in sizes)
    for key in {k for k, _ in sizes}:
        assert sum(r["length"] for r in got if str(r["doc_id"]) == key) == sum(n for k, n in sizes if k == key)
    return by_bin


def test_every_word_has_one_place(spark):
    for docs in (edge_docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.packed(docs).collect()
        assert check(docs, got)
    assert packing.packed(empty_docs(spark)).count() == 0


def test_bins_follow_the_stored_order(spark, tmp_path):
    # files of unequal sizes, which Spark does not read in the order of their names
    docs = edge_docs(spark, [(i, " ".join(["w"] * (20 + i * 37 % 300 if i % 50 else 5000)), "en", "a") for i in range(2000)])
    docs.withColumn("p", F.pow("doc_id", F.lit(1.3))).repartitionByRange(7, "p").sortWithinPartitions("p").drop("p").write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    got = packing.packed(stored, order=packing.stored_order()).collect()
    bins = check(stored, got)
    at = [[(r["doc_id"], r["piece"]) for r in bins[b]] for b in sorted(bins)]
    groups = [b >> 32 for b in sorted(bins)]
    assert len(set(groups)) > 10
    for (g, x), (h, y) in zip(zip(groups, at), zip(groups[1:], at[1:])):
        assert min(x) < min(y)
        assert g == h or max(z for k, b in zip(groups, at) if k == g for z in b) < min(z for k, b in zip(groups, at) if k == h for z in b)
    assert sum(b[0]["bin_used"] for b in bins.values()) / sum(b[0]["bin_length"] for b in bins.values()) > 0.95


def test_bins_depend_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_SEQUENCES", 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 30").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"))
    seen = []
    for df in (docs, docs.repartition(7), docs.repartition(3, "text").sortWithinPartitions("text")):
        got = packing.packed(df).collect()
        check(docs, got)
        seen.append(sorted(map(str, got)))
    assert len({r["bin_id"] >> 32 for r in got if r["length"]}) > 3
    assert seen[0] == seen[1] == seen[2]


def test_bins_are_well_filled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins = check(docs, packing.packed(docs).collect())
    assert sum(b[0]["bin_used"] for b in bins.values()) / sum(b[0]["bin_length"] for b in bins.values()) > 0.95


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(7)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 33, rng.integers(1, 60)))[::-1]
        bins, offsets, lengths = packing.best_fit(sizes, (8, 16, 32), lambda c: c + 1)
        free: list[list[int]] = []
        for i, size in enumerate(sizes.tolist()):
            fits = [(f[0], b) for b, f in enumerate(free) if f[0] >= size]
            if fits:
                assert free[bins[i]][0] == min(fits)[0]  # the least space that holds it
            else:
                assert bins[i] == len(free)
                rest = sizes[i + 1 :]
                costs = [((c + 1) / (size + min(c - size, int(rest[rest <= c - size].sum()))), c) for c in (8, 16, 32) if c >= size]
                free.append([min(costs)[1]])
            free[bins[i]][0] -= size
        used = np.bincount(bins, weights=sizes)
        assert all(length == min(c for c in (8, 16, 32) if c >= u) for length, u in zip(lengths, used, strict=True))
    assert packing.best_fit(np.zeros(0, np.int64))[2].size == 0
