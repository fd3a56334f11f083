import math
import re

from compare import assert_same
from fixtures import LOWER, SF, TEXTS, edge_docs, empty_docs

from loomtag.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = licenses.TEMPLATES[12][1]
MORE = [
    (30, "Work under CC BY-NC and cc\n\nby. The GENERAL public   license; all rights reserved, all RIGHTS, reserved. " + "x " * 50 + "CC by", None, None),
    (31, "Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software and associated\ndocumentation files to deal in the Software without restriction", None, None),
    (32, " ".join(f"w{i}" for i in range(5000)) + " " + MIT.replace("charge", "cost") + " " + " ".join(f"v{i}" for i in range(5000)), None, None),
    (33, MIT.replace("charge", "cost").replace("person", "body").replace("files", "sheets").replace("deal", "work"), None, None),
    (34, "Released under the MIT Lıcense. KELVIN K ccé by; released under the MIT licence", None, None),
    (35, "Released Under THE mit license.", None, None),
    (36, "released\n" + "y " * 40 + "under the mit license", None, None),
    (37, "licensed under cc by 4.0", None, None),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows):
    out = []
    for i, text, *_ in rows:
        found, at, base = words(text), [], set()
        for phrase, label in licenses.PHRASES:
            parts = phrase.split()
            here = [k for k in range(len(found)) if found[k : k + len(parts)] == parts]
            at += here
            base |= {label} if here else set()
        labels, best = set(base), 0.0
        for label, wording in licenses.TEMPLATES:
            own, n = set(words(wording)), len(words(wording))
            step = max(8, 1 << (n - 1).bit_length())
            for k in range(0, len(found), step):
                share = len(own & set(found[k : k + 2 * step]))
                if share >= math.ceil(round(licenses.THRESHOLD * len(own), 9)):
                    labels.add(label)
                    best = max(best, share / len(own))
        out.append((i, len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else best))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    assert got(queries.op11_license_join(spark, SF)) == want
    assert_same(queries.op11_license_join(spark, SF), licenses.SQL)
    assert {"apache-2.0", "mit"} <= {x for r in want for x in r[6].split(",")}


def test_awkward_documents(spark):
    rows = TEXTS + MORE
    want = brute(rows)
    labels = {r[0]: r[6] for r in want}
    assert labels[31] == labels[32] == "mit" and labels[33] == labels[34] == labels[36] == "" and labels[35] == "mit" and labels[37] == "cc-by"
    assert got(licenses.licenses(edge_docs(spark, rows))) == want
    assert got(licenses.licenses(empty_docs(spark))) == []


def test_prefixes_follow_the_frequency_in_the_corpus(spark):
    rows = licenses.scanned(edge_docs(spark, [(i, "the license" if i % 2 else "the mit", None, None) for i in range(9)]))
    assert licenses.ordered_words(rows, ["license", "mit", "the", "under"]).first()["words"] == ["under", "license", "mit", "the"]


def test_no_python_workers(spark):
    df = licenses.licenses(edge_docs(spark))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
