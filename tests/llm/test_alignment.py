import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from fixtures import SF, TEXTS, edge_docs, empty_docs

from loomtag.llm import alignment, queries

A, B = (f"{queries.TOKENIZERS}/{f}" for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
pytestmark = pytest.mark.skipif(not Path(A).exists(), reason="no vocabularies here")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MORE = [
    (20, "<|endoftext|> and <s> </s> <0x41> <unk>", None, None), (21, "a▁b c", None, None), (22, " two  blanks \n\n\t and more   x", None, None),
    (23, "café 中文字 \U0001f600\U0001f601 \u0000 é �", None, None), (24, "x" * 3000, None, None), (25, "don't we'll 's ’s 12345678 !!??", None, None),
    (26, " ", None, None), (27, " ", None, None), (28, "one two\x1cthree \x1c four\x85 five", None, None), (29, "word " * 400 + "a▁b", None, None),
]


def encoded(texts):
    """Ids and bytes of the tokens of whole texts, or None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    for t in texts:
        if not t:
            yield None
            continue
        x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(t))]
        yield (x, y) if b"".join(p for _, p in x) == b"".join(p for _, p in y) == (" " + t).encode() else None


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts):
    found, df = [], Counter()
    for pair in encoded(texts):
        links, groups, n = [], "", 0
        if pair:
            x, y = map(spans, pair)
            j = 0
            for i, s, e in x:
                while y[j][2] <= s:
                    j += 1
                k = j
                while k < len(y) and y[k][1] < e:
                    links.append((i, y[k][0]))
                    k += 1
            ends = sorted({e for *_, e in x} & {e for *_, e in y})
            n, parts, p, q = len(ends), [], 0, 0
            for end in ends:
                u, v = p, q
                while u < len(x) and x[u][2] <= end:
                    u += 1
                while v < len(y) and y[v][2] <= end:
                    v += 1
                parts.append(",".join(str(i) for i, *_ in x[p:u]) + "|" + ",".join(str(i) for i, *_ in y[q:v]))
                p, q = u, v
            groups = hashlib.sha256(";".join(parts).encode()).hexdigest()
        df.update(set(links))
        found.append((len(pair[0]) if pair else 0, len(pair[1]) if pair else 0, n, links, groups))
    best = {}
    for (a, _), c in df.items():
        best[a] = max(best.get(a, 0), c)
    return [(na, nb, n, len(ls), sum(df[x] == best[x[0]] for x in ls), sum(df[x] for x in ls), g) for na, nb, n, ls, g in found]


def expected(rows):
    return sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True)), key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_whole_texts_encoded_at_once(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op13_token_alignment(spark, SF)) == expected(docs)


def test_awkward_documents_in_ranges_and_without(spark):
    rows = TEXTS + MORE
    docs, want = edge_docs(spark, rows), expected(rows)
    assert sum(r[1] > 0 for r in want) > 20 and want != []
    for options in ({}, {"chunk": 100}, {"chunk": 33, "most_pairs": 0}):
        assert got(alignment.links(docs, A, B, **options)) == want, options
    assert got(alignment.links(empty_docs(spark), A, B)) == []


def test_fragments_are_a_monoid():
    units, rng = alignment.units_of(A, B), random.Random(5)
    text = "Tokenisers disagree about unbelievable internationalisation; café 中文 " * 3
    which = units.numbers(units.split(text))
    whole = units.stream(which, 0)
    end = int(whole.a_ends[-1])
    one = alignment.Fragment.of(whole, units.b_n).whole(units.b_n)
    assert ";" in one.text and len(one.suffix.a) == 0
    same = lambda x, y: (x.cut, x.text, x.groups, x.pairs.tolist(), x.counts.tolist(), *([getattr(o, n).tolist() for o in (x.prefix, x.suffix) for n in o.__slots__])) == (y.cut, y.text, y.groups, y.pairs.tolist(), y.counts.tolist(), *([getattr(o, n).tolist() for o in (y.prefix, y.suffix) for n in o.__slots__]))
    for _ in range(60):
        at = [0, *sorted(rng.randrange(1, end) for _ in range(rng.randrange(1, 40))), end]
        parts = [alignment.Fragment.of(whole.between(x, y), units.b_n) for x, y in zip(at, at[1:], strict=False)]
        while len(parts) > 1:  # composed in any order
            i = rng.randrange(len(parts) - 1)
            if len(parts) > 2 and i + 2 < len(parts):
                a, b, c = parts[i : i + 3]
                assert same(a.then(b, units.b_n).then(c, units.b_n), a.then(b.then(c, units.b_n), units.b_n))
            parts[i : i + 2] = [parts[i].then(parts[i + 1], units.b_n)]
        assert same(parts[0].whole(units.b_n), one)
    assert any(not alignment.Fragment.of(whole.between(x, x + 1), units.b_n).cut for x in range(end))
    assert np.array_equal(one.counts, one.counts.clip(1))


def test_ranges_cover_the_text_once():
    units = alignment.units_of(A, B)
    text = "short words here " + "x" * 500 + " and more short words  behind it\n" * 20
    raw = (" " + text).encode()
    found = list(alignment._ranges(units, text, 64))
    assert [f[1] for f in found[1:]] == [f[2] for f in found[:-1]] and found[0][1] == 0 and found[-1][2] == len(raw)
    assert all(start <= low and start + len(part.encode()) + 1 >= high and (" " + part).encode() == raw[start : start + len(part.encode()) + 1] for start, low, high, part in found)


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 9973}x{i % 13}" for i in range(150_000))
    assert len(text) > 4 * alignment.CHUNK
    rows = [(1, text, "en", "a"), (2, text[:300], "en", "a"), (3, text + "▁", "en", "a")]
    assert got(alignment.links(edge_docs(spark, rows), A, B)) == expected(rows)
