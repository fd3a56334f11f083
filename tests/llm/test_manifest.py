import hashlib
import zlib

from compare import assert_same
from fixtures import SF, TEXTS, edge_docs, empty_docs
from pyspark.sql import functions as F

from loomtag.llm import manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, i):
    """The siblings on the way up from place i, as (before, after) of each level, and the top."""
    way = []
    while len(nodes) > 1:
        run = nodes[i - i % 3 : i - i % 3 + 3]
        way.append((run[: i % 3], run[i % 3 + 1 :]))
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        i //= 3
    return way, nodes[0]


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    leaves = {n: [leaf(r) for r in groups[n]] for n in names}
    tops = [climb(leaves[n], 0)[1] for n in names]
    out = []
    for g, n in enumerate(names):
        over, root = climb(tops, g)
        for i, r in enumerate(groups[n]):
            way = climb(leaves[n], i)[0] + over
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf((*r[:4], r[4].replace("\n", "") if odd and r[4] is not None else r[4]))
            for before, after in way:
                x = h(*before, x, *after)
            out.append((r[0], leaves[n][i], tops[g], root, h(*(d for b, a in way for d in b + a)), x, x == root))
    return sorted(out, key=str)


def found(docs):
    rows = manifest.manifest(docs, manifest.tampered())
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=str)


def test_query_equals_sql(spark):
    assert_same(queries.op12_merkle_manifest(spark, SF), manifest.SQL)


def test_awkward_and_empty_documents(spark):
    docs = edge_docs(spark)
    rows = [(i, source, lang, 7, text) for i, text, lang, source in TEXTS] + [(None, None, None, 7, "a\nb")] * 3 + [(2, "a", "en", 7, f"other {i}") for i in range(5)] + [(-5, "a", None, 7, "x\n"), (2**40, "a", "en", 7, "far\n"), (-(2**63), "a", "en", 7, "least"), (63, "a", "en", 7, "\n")]
    more = spark.createDataFrame(rows[len(TEXTS) :], "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).withColumn("n_chars", F.lit(7).cast("long"))
    assert found(docs) == brute(rows)
    assert found(empty_docs(spark)) == []


def test_one_leaf_is_its_own_root(spark):
    docs = edge_docs(spark, [(5, "a\nb", "en", "s")])
    assert found(docs) == brute([(5, "s", "en", None, "a\nb")])


def test_several_tiers_of_slots(spark):
    # "hot" has 2,000 leaves (two tiers), 800 sources have one each (two tiers of subroots), ids are sparse
    rows = [(i * 1009 - 500_000, "hot" if i < 2000 else f"s{i % 1000}", "en", 1, f"text\n{i}") for i in range(2800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs) == brute(rows)


def test_a_third_of_all_rows_with_one_id(spark):
    rows = [(7 if i % 3 == 0 else i, "a", "en", 1, f"t{i % 50}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs) == brute(rows)
