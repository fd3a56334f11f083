import math
from collections import Counter

from compare import assert_same
from fixtures import SF, TEXTS, edge_docs, empty_docs
from pyspark.sql import functions as F

from loomtag.llm import lines, queries


def test_query_equals_sql(spark):
    assert_same(queries.op5_site_lines(spark, SF), lines.SQL)


def limit(n, pages, z):
    if pages < 2:
        return -1
    p, m = (n - 1) / (pages - 1), pages - 1
    return (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)


def brute(rows, ratio, errors=lines.ERRORS):
    pages, seen = Counter(), Counter()
    for _, text, _, host in rows:
        if host is not None:
            pages[host] += 1
            for x in {y.strip(" \t\r\v\f") for y in (text or "").split("\n")} - {""}:
                seen[host, x] += 1
    out = []
    for i, text, _, host in rows:
        kept = None if text is None else [x for x in text.split("\n") if not (host is not None and seen[host, x.strip(" \t\r\v\f")] > 1 and limit(seen[host, x.strip(" \t\r\v\f")], pages[host], errors) > ratio)]
        n = 0 if text is None else len(text.split("\n"))
        out.append((i, None if kept is None else "\n".join(kept), n, n - len(kept or [])))
    return sorted(out, key=str)


def test_awkward_documents(spark):
    docs = edge_docs(spark)
    got = lines.without_boilerplate(docs, ratio=0.3, errors=0.5).collect()
    assert sorted(((r["row"]["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=str) == brute(TEXTS, 0.3, 0.5)
    out = lines.cleaned(docs, ratio=0.3, errors=0.5)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.cleaned(empty_docs(spark)).count() == 0


def test_only_frequent_lines_of_the_own_site_go(spark):
    rows = [(i, f"menu\nbody {i}\n menu", "en", "a" if i < 30 else "b") for i in range(60)] + [(99, "menu\nrare", "en", "c")]
    got = {r["row"]["doc_id"]: r["text"] for r in lines.without_boilerplate(edge_docs(spark, rows)).collect()}
    assert got[0] == "body 0" and got[45] == "body 45" and got[99] == "menu\nrare"


def test_the_ratio_decides_at_every_size_of_a_site(spark):
    # at sf0.01 (50 pages a site) and sf0.1 (500) no ratio, the own one and twice that drop different lines
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        dropped = [lines.without_boilerplate(docs, ratio=r).agg(F.sum("n_dropped")).first()[0] for r in (0, lines.RATIO, 2 * lines.RATIO)]
        assert dropped[0] > dropped[1] > dropped[2] > 0, (sf, dropped)


def test_least_counts_by_size(spark):
    sizes = spark.createDataFrame([(n, p) for p in (2, 10, 50, 500, 5000) for n in range(1, p + 1)], "n long, pages long")
    least = {r["pages"]: r["least"] for r in sizes.where(lines.lower_share(F.col("n"), F.col("pages")) > lines.RATIO).groupBy("pages").agg(F.min("n").alias("least")).collect()}
    assert least == {p: next(n for n in range(1, p + 1) if limit(n, p, lines.ERRORS) > lines.RATIO) for p in (2, 10, 50, 500, 5000)}
    assert least[50] == 5 and least[500] == 15 and all(n > 1 for n in least.values())
    plain = sizes.where(lines.lower_share(F.col("n"), F.col("pages"), 0.0) > 0.5).groupBy("pages").agg(F.min("n").alias("least"))
    assert {r["pages"]: r["least"] for r in plain.collect()} == {p: next(n for n in range(1, p + 1) if (n - 1) / (p - 1) > 0.5) for p in (2, 10, 50, 500, 5000)}


def test_hosts_of_urls(spark):
    urls = {"http://A.example/x": "a.example", "https://user:pw@b.example:8080/?q": "b.example", "HTTP://c.example.": "c.example", "http://[2001:DB8::1]:80/": "[2001:db8::1]", "mailto:x@y": None, "http:///x": None, "": None, None: None, "no url": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["h"] for r in df.select("u", lines.host_of(F.col("u")).alias("h")).collect()} == urls


def test_thousands_of_hosts_by_their_urls(spark):
    # each of 2,000 hosts has 6 pages with a menu of its own; one has a third of all pages, in other spellings of its name
    rows = [(i, f"menu of {i % 2000}\nbody {i}", "en", f"http://h{i % 2000}.example/p{i}") for i in range(12_000)]
    rows += [(20_000 + i, f"hot menu\nbody {i}" + ("\nrare" if i < 5 else "\noften" if i < 300 else ""), "en", f"https://{'HOT' if i % 2 else 'hot'}.example:{i % 7 + 80}/{i}") for i in range(6_000)]
    docs = edge_docs(spark, rows)
    got = {r["row"]["doc_id"]: r["text"] for r in lines.without_boilerplate(docs, host=lines.host_of(F.col("source"))).collect()}
    by_host = [(i, t, l, lines_host(u)) for i, t, l, u in rows]
    assert sorted(got.items()) == sorted((i, t) for i, t, _, _ in brute(by_host, lines.RATIO))
    assert got[7] == "body 7" and got[20_000] == "body 0\nrare" and got[20_010] == "body 10"


def lines_host(url):
    return url.split("://")[1].split("/")[0].split(":")[0].lower()
