"""Quality by ordinal regression: cumulative links over hashed words with ordered thresholds.

P(grade <= k) is sigmoid(threshold k - score). All grades share the weights of one
score; the thresholds are a first one plus positive steps, so they stay in order.
Features of a text are which of the hashed words, word endings and repetitions occur
in it. Weights are learned in numpy on a bounded sample of graded texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtag.llm.shared import split_words, text_slices

#: Hashed features, bound of the graded sample for a grade.
FEATURES, PER_GRADE = 1 << 18, 2_500
#: Pull of weights towards zero, so that features without evidence have none; a grade's texts weigh together as their number to this power.
SHRINK, BALANCE = 2e-3, 0.6
#: A feature with a weight occurs in at least so many texts of the sample, and in one of so many; rarer ones would only be learned by heart.
LEAST_TEXTS, LEAST_SHARE = 4, 500

#: A text repeats itself if more than one word in so many is the word before it.
REPEATED = (4, 8, 16)
_MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, owner), distinct within a text, sorted by owner: words, their last two characters, and whether many words follow themselves."""
    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    word = np.array([xxhash.xxh32_intdigest(w.lower().strip(_MARKS) or w) % FEATURES for w in names], np.int64)
    ending = np.array([xxhash.xxh32_intdigest("$" + w[-2:]) % FEATURES for w in names], np.int64)
    codes, owner = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = np.bincount(owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])], minlength=len(counts))
    repeats = [np.flatnonzero(again * part > counts) * FEATURES + xxhash.xxh32_intdigest(f"same again {part}") % FEATURES for part in REPEATED]
    keys = np.unique(np.concatenate([owner * FEATURES + word[codes], owner * FEATURES + ending[codes], *repeats]))
    return keys % FEATURES, keys // FEATURES


def _scores(weights: np.ndarray, f: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=weights[f], minlength=n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cumulative(model: Model, scores: np.ndarray) -> np.ndarray:
    """(n, grades - 1): P(grade > k) for each threshold k."""
    return _sigmoid(scores[:, None] - model.thresholds[None, :])


def loss_and_gradients(scores: np.ndarray, thresholds: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of cost x negative log-likelihood of grades y, and its gradients by the scores and by the thresholds."""
    k = len(thresholds)
    low = np.where(y > 0, thresholds[np.maximum(y - 1, 0)], -50.0)
    high = np.where(y < k, thresholds[np.minimum(y, k - 1)], 50.0)
    up, down = _sigmoid(high - scores), _sigmoid(low - scores)
    p = np.maximum(up - down, 1e-9)
    d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
    g = np.zeros(k)
    np.add.at(g, np.minimum(y, k - 1)[y < k], (-cost * d_up)[y < k])
    np.add.at(g, np.maximum(y - 1, 0)[y > 0], (cost * d_down)[y > 0])
    return -float((cost * np.log(p)).sum()), cost * (d_up - d_down), g


def train(lists: list[np.ndarray], grades: np.ndarray, levels: int, known: np.ndarray | None = None, steps_least: int = 4_000, batch: int = 64, rate: float = 0.1, shrink: float = SHRINK, seed: int = 3) -> Model:
    """Stochastic gradient descent with per-weight step sizes on the likelihood of the grades, with an L1 penalty on the weights. Reruns agree.

    There are at least 30 passes and steps_least steps. known is the number of graded
    texts of each grade that the sample stands for; it weighs the sample's.
    """
    rng = np.random.default_rng(seed)
    drawn = np.maximum(1, np.bincount(grades, minlength=levels))
    balance = (drawn if known is None else known) ** BALANCE / drawn
    balance = balance * len(grades) / max(1e-9, float((balance * drawn).sum()))
    often = np.bincount(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), minlength=FEATURES) >= max(LEAST_TEXTS, len(grades) // LEAST_SHARE)
    lists = [x[often[x]] for x in lists]
    # without evidence a text has the highest grade
    w, first, steps = np.zeros(FEATURES), np.array(-2.0 * (levels - 1)), np.zeros(levels - 2)
    seen, seen_t = np.full(FEATURES, 1e-6), np.full(levels - 1, 1e-6)

    def thresholds() -> np.ndarray:
        return first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])

    for _ in range(max(30, -(-steps_least * batch // max(1, len(grades))) if len(grades) else 0)):
        order = rng.permutation(len(grades))
        for start in range(0, len(order), batch):
            at = order[start : start + batch]
            f, owner = np.concatenate([lists[i] for i in at]).astype(np.int64), np.repeat(np.arange(len(at)), [len(lists[i]) for i in at])
            y, th = grades[at], thresholds()
            _, g_s, g_th = loss_and_gradients(_scores(w, f, owner, len(at)), th, y, balance[y] / len(at))
            g_w = np.bincount(f, weights=g_s[owner], minlength=FEATURES)
            hit = np.unique(f)
            seen[hit] += g_w[hit] ** 2
            step = rate / np.sqrt(seen[hit])
            moved = w[hit] - step * g_w[hit]
            w[hit] = np.sign(moved) * np.maximum(np.abs(moved) - shrink * step, 0)
            tail = np.cumsum(g_th[::-1])[::-1]  # a later threshold moves with every step before it
            g_t = np.concatenate([[tail[0]], tail[1:] * np.exp(steps)])
            seen_t += g_t**2
            move = rate * g_t / np.sqrt(seen_t)
            first, steps = first - move[0], steps - move[1:]
    return Model(w, thresholds())


def learn(docs: DataFrame, graded: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> Model:
    """Learned from at most per_grade documents of each grade (least hashes of the id); graded holds id_col and an integer `grade`.

    Null ids, grades and texts teach nothing; a document that is graded twice teaches
    both, and of ids that tie in their hash the smaller comes first. Without any
    graded text the weights are zero, and all texts get the same grade.
    """
    known = graded.where(F.col(id_col).isNotNull() & F.col("grade").between(0, levels - 1)).select(F.col(id_col).alias("id"), F.col("grade").alias("grade"))
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    drawn = None
    for k in range(levels):
        part = known.where(F.col("grade") == k).orderBy(F.xxhash64("id"), "id").limit(per_grade)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    met = texts.join(F.broadcast(drawn), "id")  # at most levels x per_grade rows of two numbers

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                f, owner = features(part.column("text"))
                cuts = np.searchsorted(owner, np.arange(1, part.num_rows))
                lists = [x.astype(np.int32).tobytes() for x in np.split(f, cuts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade").cast(pa.int32()), pa.array(lists, pa.binary())], names=["id", "grade", "features"])

    rows = met.mapInArrow(run, f"id {met.schema['id'].dataType.simpleString()}, grade int, features binary").orderBy(F.xxhash64("id"), "id", "grade", "features").limit(2 * levels * per_grade).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["grade"], bytes(r["features"])))
    return train([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64), levels, np.array([counts.get(k, 0) for k in range(levels)]))


def grades(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, tail_prob) for each row of docs: the mean grade, and the probability of the highest grade.

    A null text has no features, like an empty one, and gets the grade of the
    thresholds alone; a very long text is read whole. Equal texts get equal grades.
    Rows with null or repeated ids stay rows of their own. An empty table gives no
    rows; columns besides the two named are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                f, owner = features(part.column("text"))
                above = cumulative(model, _scores(model.weights, f, owner, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(above.sum(axis=1)), pa.array(above[:, -1])], names=["id", "expected_grade", "tail_prob"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, expected_grade double, tail_prob double")
    return found.withColumnRenamed("id", id_col)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic texts, 1 for others of quality 0, 2 for the rest; null without labels."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
