import numpy as np
import pyarrow as pa
import pytest
from fixtures import edge_docs, empty_docs

from loomtag.llm import langid


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {"x": rng.normal(0, 0.5, (2, 256, 24)), "u": rng.normal(0, 0.3, (2, 8, 24)), "v": rng.normal(0, 0.3, (16, 3)), "c": np.zeros(3)}
    seq, mask, label = rng.integers(0, 256, (4, 6)), np.ones((4, 6)), rng.integers(0, 3, 4)
    mask[1, 4:] = 0
    _, g = langid._loss_and_gradients(p, seq, mask, label)
    for name in p:
        for _ in range(5):
            at = tuple(int(rng.integers(0, s)) for s in p[name].shape)
            at = (at[0], int(seq[0, 0]), at[2]) if name == "x" else at
            losses = []
            for step in (1e-3, -1e-3):
                q = {n: w.copy() for n, w in p.items()}
                q[name][at] += step
                losses.append(langid._loss_and_gradients(q, seq, mask, label)[0])
            assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_awkward_documents(spark):
    docs = edge_docs(spark)
    got = langid.predictions(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] in (4, 5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de", "fr")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {4, 5, 6, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_nothing_to_learn(spark):
    assert langid.predictions(empty_docs(spark)).count() == 0
    got = langid.predictions(edge_docs(spark, [(1, "some text", None, "a")])).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_documents_pool_all_their_positions():
    import pyarrow as pa

    model = langid.train([("a", "abab" * 16), ("b", "xyxy" * 16)] * 20, steps=40)
    text = "ab" * 500 + "xy" * 100
    prob = langid.document_probabilities(model, pa.array([text, None, "", "xy" * 600]))
    assert prob[0, 0] == pytest.approx(1000 / 1200, abs=0.08) and prob[3, 1] > 0.9
    assert prob[1].sum() == 0 and prob[2].sum() == 0


def plain_pool(model, data):
    """Position probabilities of one text by the gates as they are written down, one byte at a time."""
    squash = lambda a: a / (1 + np.abs(a))
    n, total = langid.UNITS, np.zeros(len(model.languages))
    for at in range(0, len(data), langid.SEGMENT):
        part = data[at : at + langid.SEGMENT]
        states = []
        for d, order in enumerate((range(len(part)), range(len(part) - 1, -1, -1))):
            h, found = np.zeros(n), {}
            for t in order:
                xg, hg = model.x[d][part[t]].astype(np.float64), h @ model.u[d].astype(np.float64)
                z, r = ((1 + squash(xg[i : i + n] + hg[i : i + n])) / 2 for i in (0, n))
                h = z * h + (1 - z) * squash(xg[2 * n :] + r * hg[2 * n :])
                found[t] = h
            states.append(found)
        for t in range(len(part)):
            logits = np.concatenate([states[0][t], states[1][t]]) @ model.v + model.c
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / max(1, len(data))


def test_forward_pass_equals_plain_python_and_the_trained_loss():
    import pyarrow as pa

    model = langid.train([("a", "abab cd é" * 8), ("b", "xyxy zé" * 8), ("c", "mnop" * 12)] * 20, steps=30)
    texts = ["abc", "é" * 100, "x" * 128, "y" * 129, "mixed text, mnop xyxy abab " * 20, "q"]
    prob = langid.document_probabilities(model, pa.array(texts))
    for text, p in zip(texts, prob, strict=True):
        assert p == pytest.approx(plain_pool(model, text.encode()), abs=2e-5)
    # the loss that training lowers is that of the same probabilities
    p = {"x": model.x, "u": model.u, "v": model.v, "c": model.c}
    data = np.frombuffer(texts[4].encode()[:100], np.uint8).astype(np.int64)[None, :]
    sums = langid.position_sums(model, data[0].astype(np.uint8), np.arange(100), np.ones(100, np.int64))
    alone = [langid._loss_and_gradients(p, data[:, i : i + 1], np.ones((1, 1), np.float32), np.array([2]))[0] for i in range(100)]
    assert np.exp(-np.array(alone)) == pytest.approx(sums[2], abs=2e-5)


def test_learning_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = [langid.learn(d, per_language=10) for d in (docs, docs.repartition(5))]
    assert models[0].languages == models[1].languages and (models[0].x == models[1].x).all() and (models[0].v == models[1].v).all()
    with pytest.raises(ValueError):
        langid.learn(docs, most_languages=1)


def test_many_languages_are_labelled_in_small_lots(monkeypatch):
    rng = np.random.default_rng(2)
    n = 300
    model = langid.Model(tuple(f"l{i}" for i in range(n)), *(rng.normal(0, 0.3, shape).astype(np.float32) for shape in ((2, 256, 24), (2, 8, 24), (16, n), (n,))))
    texts = pa.array(["some words " * 3 * k for k in range(60)] + [None, ""])
    seen, inner = [], langid.position_sums
    monkeypatch.setattr(langid, "position_sums", lambda m, d, s, l: seen.append(len(s)) or inner(m, d, s, l))
    small = langid.document_probabilities(model, texts)
    assert max(seen) * n <= langid.LOT and len(seen) > 1
    monkeypatch.setattr(langid, "LOT", 1 << 30)
    assert np.allclose(small, langid.document_probabilities(model, texts), atol=1e-6)
    assert np.allclose(small.sum(axis=1)[1:60], 1, atol=1e-3)
