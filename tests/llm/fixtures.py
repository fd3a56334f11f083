"""Small tables with every awkward case, and plain-Python forms of what the operators compute."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score double, `key` string, rep long, comp long, size long, position double, word_count int"

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (3, "ONE two three four five six seven eight nine ten eleven twelve x", "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, None),
    (6, "   \n\t ", "de", "c"),
    (7, "!!! 123 --- 456", "de", "c"),
    (8, "alone", "de", "a"),
    (9, "alone", None, "é"),
    (None, "one two three four five six seven eight nine ten eleven twelve", "fr", "a"),
    (None, None, None, None),
    (10, LONG, "fr", "a"),
    (11, LONG + " more", "fr", "a"),
    (12, "line one\nline two\nline one\n\nline two \n", "fr", "b"),
    (13, "\U0001f600 token = \"abcdefghijklmnop123\" and \U0001f600 token=secret:abcdefghijklmnop", "en", "b"),
]


def edge_docs(spark, texts=TEXTS):
    """The awkward documents, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*t, None, 7, "r", 0.5, "k", 1, 2, 3, 0.1, None) for t in texts], SCHEMA)


def empty_docs(spark):
    return edge_docs(spark).where("false")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_groups(texts, k, percent=80):
    """{id: (set size, least id of its component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
