"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of SEGMENT bytes, all of them read. In each segment two
gated recurrent layers run over the bytes, one from either end; every position gets
language probabilities from both states, and a document's probabilities are the mean
over all its positions. The network is trained in numpy by backpropagation through
time on a bounded sample of labelled excerpts.

The gates use x / (1 + |x|) as squashing function (and half of it plus a half as
sigmoid), which costs a fraction of exp and has an equally simple derivative.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtag.llm.shared import text_slices

#: Bytes of a segment, units of a direction.
SEGMENT, UNITS = 128, 8
#: Bound of the training sample: documents a language, excerpts a document, characters an excerpt.
PER_LANGUAGE, EXCERPTS, EXCERPT_CHARS = 600, 4, 64
#: Languages that one network is learned for.
MOST_LANGUAGES = 512
#: Segments times languages that are labelled at once: 4,096 segments of up to 16 languages, fewer of more.
LOT = 65_536
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """languages, and weights: x (2, 256, 3H) per byte, u (2, H, 3H) recurrent, v (2H, C) and c (C) output."""

    languages: tuple[str, ...]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray


def _squash(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


def _loss_and_gradients(p: dict[str, np.ndarray], seq: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions of seq (B, T) and its gradients, through time in both directions."""
    (b, t_all), h_n = seq.shape, p["u"].shape[1]
    states = np.zeros((2, t_all, b, h_n), np.float32)
    saved: list[list[tuple]] = [[], []]
    orders = (range(t_all), range(t_all - 1, -1, -1))
    for d, order in enumerate(orders):
        h = np.zeros((b, h_n), np.float32)
        for t in order:
            xg, hg = p["x"][d][seq[:, t]], h @ p["u"][d]
            sz, sr = _squash(xg[:, :h_n] + hg[:, :h_n]), _squash(xg[:, h_n : 2 * h_n] + hg[:, h_n : 2 * h_n])
            z, r, hn = (1 + sz) / 2, (1 + sr) / 2, hg[:, 2 * h_n :]
            n = _squash(xg[:, 2 * h_n :] + r * hn)
            new = z * h + (1 - z) * n
            m = mask[:, t : t + 1]
            saved[d].append((t, h, z, r, n, hn, sz, sr, m))
            h = new * m + h * (1 - m)
            states[d, t] = h
    both = np.concatenate([states[0], states[1]], axis=-1)  # T, B, 2H
    logits = both @ p["v"] + p["c"]
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    prob = e / e.sum(axis=-1, keepdims=True)
    m_t, total = mask.T[:, :, None], float(mask.sum())
    at = prob[:, np.arange(b), label]
    loss = -float((np.log(at + 1e-12) * mask.T).sum()) / total
    dl = prob.copy()
    dl[:, np.arange(b), label] -= 1
    dl *= m_t / total
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["v"] = np.einsum("tbh,tbc->hc", both, dl)
    g["c"] = dl.sum(axis=(0, 1))
    d_both = dl @ p["v"].T
    for d in (0, 1):
        dh = np.zeros((b, h_n), np.float32)
        for t, h, z, r, n, hn, sz, sr, m in reversed(saved[d]):
            dh = dh + d_both[t, :, d * h_n : (d + 1) * h_n]
            dnew = dh * m
            dz, dn = dnew * (h - n), dnew * (1 - z)
            dan = dn * (1 - np.abs(n)) ** 2
            dar = dan * hn * 0.5 * (1 - np.abs(sr)) ** 2
            daz = dz * 0.5 * (1 - np.abs(sz)) ** 2
            dx = np.concatenate([daz, dar, dan], axis=1)
            dhg = np.concatenate([daz, dar, dan * r], axis=1)
            np.add.at(g["x"][d], seq[:, t], dx)
            g["u"][d] += h.T @ dhg
            dh = dh * (1 - m) + dnew * z + dhg @ p["u"][d].T
    return loss, g


def train(excerpts: list[tuple[str, str]], steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 11) -> Model | None:
    """The network learned from (language, excerpt) pairs by Adam; None without pairs. Reruns agree."""
    languages = tuple(sorted({lang for lang, _ in excerpts}))
    if not languages:
        return None
    index = {lang: i for i, lang in enumerate(languages)}
    rows = sorted(excerpts)
    raw = [text.encode("utf-8", "replace")[: 2 * EXCERPT_CHARS] for _, text in rows]
    width = max(map(len, raw))
    seq, mask = np.zeros((len(raw), width), np.int64), np.zeros((len(raw), width), np.float32)
    for i, data in enumerate(raw):
        seq[i, : len(data)], mask[i, : len(data)] = np.frombuffer(data, np.uint8), 1
    label = np.array([index[lang] for lang, _ in rows])
    rng = np.random.default_rng(seed)
    k = len(languages)
    p = {
        "x": rng.normal(0, 0.5, (2, 256, 3 * UNITS)), "u": rng.normal(0, 0.3, (2, UNITS, 3 * UNITS)),
        "v": rng.normal(0, 0.3, (2 * UNITS, k)), "c": np.zeros(k),
    }
    p = {name: w.astype(np.float32) for name, w in p.items()}
    m1, m2 = {n: np.zeros_like(w) for n, w in p.items()}, {n: np.zeros_like(w) for n, w in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), batch)
        _, g = _loss_and_gradients(p, seq[pick], mask[pick], label[pick])
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for n in p:
            m1[n] = 0.9 * m1[n] + 0.1 * g[n]
            m2[n] = 0.99 * m2[n] + 0.01 * g[n] ** 2
            p[n] = (p[n] - now * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, p["x"], p["u"], p["v"], p["c"])


def position_sums(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(C, B): the position probabilities of each segment data[start : start + length], summed over its bytes.

    Units run along rows and segments along columns, so that every step works on long contiguous rows.
    """
    b, h_n, c_n = len(starts), UNITS, len(model.languages)
    steps = int(lengths.max()) if b else 0
    at = np.minimum(starts[None, :] + np.arange(steps)[:, None], len(data) - 1)
    codes = data[at]
    inside = np.arange(steps)[:, None] < lengths[None, :]
    tables = [np.ascontiguousarray(model.x[d].T) for d in (0, 1)]
    ut = [np.ascontiguousarray(model.u[d].T) for d in (0, 1)]
    vt = [np.ascontiguousarray(model.v[d * h_n : (d + 1) * h_n].T) for d in (0, 1)]
    part = np.empty((steps, c_n, b), np.float32)
    sums = np.zeros((c_n, b), np.float32)
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        h = np.zeros((h_n, b), np.float32)
        for t in order:
            xg = tables[d].take(codes[t], axis=1)
            hg = ut[d] @ h
            s = xg[: 2 * h_n]
            s += hg[: 2 * h_n]
            w = np.abs(s)
            w += 1
            s /= w
            s += 1
            s *= 0.5
            n = hg[2 * h_n :]
            n *= s[h_n:]
            n += xg[2 * h_n :]
            w = np.abs(n)
            w += 1
            n /= w
            h = np.subtract(h, n) * s[:h_n] + n
            if d and not inside[t].all():  # from the far end, a segment begins at its own last byte
                h *= inside[t]
            if d == 0:
                np.matmul(vt[0], h, out=part[t])
            else:
                e = vt[1] @ h
                e += part[t]
                e += model.c[:, None]
                e -= e.max(axis=0)
                np.exp(e, out=e)
                e *= inside[t] / e.sum(axis=0)
                sums += e
    return sums


def document_probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """(documents, C): mean over all byte positions; zeros for a text without bytes."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[:-1][owner] + number * SEGMENT
    lengths = np.minimum(SEGMENT, offsets[1:][owner] - starts)
    out = np.zeros((len(sizes), len(model.languages)))
    order = np.argsort(-lengths, kind="stable")
    most = max(32, min(4096, LOT // max(1, len(model.languages))))
    for lot in (order[i : i + most] for i in range(0, len(order), most)):
        sums = position_sums(model, data, starts[lot], lengths[lot])
        for k in range(len(model.languages)):
            out[:, k] += np.bincount(owner[lot], weights=sums[k], minlength=len(sizes))
    return out / np.maximum(sizes, 1)[:, None]


def held_out(id_col: Column) -> Column:
    """crc32(id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """The network learned from documents with a language that aren't held out (those with a null id teach nothing).

    Of each language about per_language documents with the least hashes are taken,
    and EXCERPTS excerpts at hashed places of each: the bound of what reaches the
    driver. Raises ValueError if there are more than most_languages languages: none
    is left out in silence.
    """
    pupils = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    pupils = pupils.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = pupils.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if not counts:
        return None
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: set most_languages")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * per_language / r["count"]))])
    drawn = pupils.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000).where(has_letter(F.col("text")))
    places = [F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(1))) + 1).cast("int"), F.lit(EXCERPT_CHARS)) for k in range(EXCERPTS)]
    drawn = drawn.select("lang", F.array_distinct(F.array(*places)).alias("excerpts"), F.xxhash64("id").alias("o")).orderBy("o", "lang", "excerpts")
    rows = drawn.limit(2 * per_language * len(counts)).collect()
    return train([(r["lang"], x) for r in rows for x in r["excerpts"] if x])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score) for each row of docs; row is a struct of the columns in keep (all by default).

    lang_pred is a learned language, or `und` with score 0 if the text is null or
    has no letter, or if nothing was learned; score is the pooled probability of
    lang_pred. Of languages that tie the first by name is taken. A very long text is
    read whole, segment by segment; equal texts get equal results, and rows that
    repeat an id stay rows of their own. An empty table gives no rows. Columns of
    docs may have any name.
    """
    keep = docs.columns if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"), has_letter(F.col(text_col)).alias("letters"))
    if model is None:
        return source.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                prob = document_probabilities(model, part.column("text"))
                letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(letters, prob.argmax(axis=1), len(names) - 1)
                score = np.where(letters, np.clip(prob.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row of docs, learned from those of its documents that aren't held out."""
    found = identify(docs, learn(docs, id_col, text_col, lang_col), text_col, keep=[id_col])
    return found.select(F.col(f"row.{id_col}").alias(id_col), held_out(F.col(f"row.{id_col}")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, unchanged, whose language is recognised with at least least_score."""
    found = identify(docs, learn(docs, id_col, text_col, lang_col), text_col)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
