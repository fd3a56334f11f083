import random
from collections import Counter

from fixtures import SF, WORD, edge_docs, empty_docs

from loomtag.llm import queries, rules


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    more = [(50, "a b c d e " * 9, "en", "x"), (51, "a a a a a a a", "en", "x"), (52, "a b c d e x a b c d e y", "en", "x"), (53, "###\n###\n \n### b", "en", "x"), (54, "a b c d e a b c d", "en", "x")]
    for docs in (edge_docs(spark).unionByName(edge_docs(spark, more)), spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(tuple(r[c] for c in rules.BASE) for r in rules.statistics(docs).collect())
        assert got == sorted(plain(r["text"]) for r in docs.collect())
    assert rules.statistics(empty_docs(spark)).count() == 0


def test_learned_list_separates_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_decision_list(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r for r in got if r["quality"] == 0], [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad) and sum(r["kept"] for r in good) >= 0.97 * len(good)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_covering_finds_planted_rules_in_order():
    rows = []
    for i in range(600):
        row = dict.fromkeys(rules.STATS, 1.0) | {"mean_word": float(i % 10), "upper_share": (i % 7) / 7, "n_words": float(i)}
        rows.append((row, row["mean_word"] > 7 and row["upper_share"] > 0.5 or row["n_words"] <= 60))
    found = rules.cover(rows)
    assert found and found == rules.cover(rows)
    assert all(any(rules._covers(r, row) for r in found) == bad for row, bad in rows) or sum(any(rules._covers(r, row) for r in found) != bad for row, bad in rows) < 20
    assert rules.cover([]) == [] and rules.cover([(rows[0][0], False)] * 30) == []


def test_no_rules_keep_all_that_passes(spark):
    got = rules.judged(edge_docs(spark), []).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
    assert rules.learn(edge_docs(spark), spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")) == []


def test_expression_equals_the_list_in_plain_python(spark):
    rng = random.Random(2)
    rows = [{s: (float(rng.randrange(6)) if s not in ("n_words", "n_dup_lines") else rng.randrange(6)) for s in rules.STATS} for _ in range(400)]
    df = spark.createDataFrame([tuple(r[s] for s in rules.STATS) for r in rows], ", ".join(f"{s} {'long' if s in ('n_words', 'n_dup_lines') else 'double'}" for s in rules.STATS))
    for _ in range(5):
        found = [tuple(rules.Condition(rng.choice(rules.STATS), rng.choice(["<=", ">"]), rng.choice([1.0, 2.5, 3.0, 4.5])) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))]
        got = sorted((*(r[s] for s in rules.STATS), r["kept"]) for r in df.withColumn("kept", rules.as_column(found)).collect())
        assert got == sorted((*(r[s] for s in rules.STATS), not any(rules._covers(x, r) for x in found)) for r in rows)


def test_a_binding_bound_learns_the_same_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert rules.learn(docs, labels, sample=60) == rules.learn(docs.repartition(5), labels.repartition(3), sample=60)
