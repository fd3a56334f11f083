"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import SF, assert_same, duck

from loomtag.plans import catalog


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rank_parse_text():
    """Answers of three lines, the second misspelt, against the parts of an order."""
    names = dict(duck().sql("SELECT p_partkey, p_name || ' no ' || p_partkey FROM part").fetchall())
    orders = {}
    for order, item in sorted(duck().sql("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem").fetchall()):
        orders.setdefault(order, []).append(item)
    out = []
    for order, items in orders.items():
        texts, found = [names[i] for i in items], []
        for k, text in enumerate(texts[:3], 1):
            said = text.replace("e", "a") if k == 2 else text
            hit = next((i for i, t in zip(items, texts) if t in said or said in t or subsequence(t, said) > 0.9 * len(t)), None)
            if hit is not None and hit not in found:
                found.append(hit)
                out.append((order, hit, 10 - len(found) + 1))
    return out


PLAIN = {"rank_parse_text": rank_parse_text}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert_same(df, catalog.SQL[name])
    else:
        assert name in PLAIN, f"{name} has neither SQL nor a plain form"
        assert sorted(map(tuple, df.collect())) == sorted(PLAIN[name]())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
