"""Quality rules as a learned decision list, applied with column functions only.

Statistics of each text are column expressions. On a bounded sample of labelled
texts, sequential covering grows conjunctions of thresholds that single out bad
texts (by information gain on one part of the sample), prunes them (by precision on
the other part), and removes what they cover. The list becomes one conditional
expression, in its order, that Spark evaluates for every text.
"""

from __future__ import annotations

import hashlib
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtag.llm.shared import let, words

#: Bound of the labelled sample, thresholds tried for a statistic, conditions of a rule, rules of a list.
SAMPLE, THRESHOLDS, MOST_CONDITIONS, MOST_RULES = 6_000, 24, 4, 12
#: A rule must reach this precision on the part of the sample that prunes, with at least so many texts.
PRECISION, LEAST_COVER = 0.95, 4
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OPS = {"<=": operator.le, ">": operator.gt}


@dataclass(frozen=True)
class Condition:
    stat: str
    op: str
    threshold: float

    def __str__(self) -> str:
        return f"{self.stat} {self.op} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _repeat_words(w: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the text, the first time included.

    Only a text with a repeated window pays for sorting its windows with their places.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])

    def covered(p: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))

        again = F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        last = F.struct(F.lit(-WINDOW).alias("i"), F.lit(0).alias("n"))
        return F.aggregate(at, last, lambda acc, i: F.struct(i.alias("i"), (acc["n"] + F.least(i - acc["i"], F.lit(WINDOW))).alias("n")), lambda acc: acc["n"])

    repeated = F.size(F.array_distinct(F.transform(starts, window))) < n - WINDOW + 1
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))
    return F.when(n <= WINDOW, 0).when(repeated, let(pairs, covered)).otherwise(0).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, BASE statistics, ratios) for each row of docs; a null text has none of anything.

    A very long text is counted whole; equal texts have equal statistics. Rows with null or repeated ids stay rows of their own. An empty table gives no
    rows; columns besides the two named are ignored.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.translate("_text", " \t\n\v\f\r", "")
    rows = rows.select(
        id_col, "_words", "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        let(F.col("_words"), _repeat_words).alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]", ""))).alias("_upper"),
        (F.length("_text") - F.length(F.translate("_text", "!?", ""))).alias("_marks"),
    )
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return rows.select(
        id_col, *BASE,
        (F.col("word_chars") / n).alias("mean_word"), (F.col("n_symbols") / n).alias("symbols_per_word"), (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("_distinct") / n).alias("distinct_share"), (F.col("_upper") / chars).alias("upper_share"), (F.col("_marks") / n).alias("marks_per_word"),
    )


#: What rules may test.
STATS = ("n_words", "n_dup_lines", "mean_word", "symbols_per_word", "repeat_share", "distinct_share", "upper_share", "marks_per_word")


def _covers(rule: Rule, row: dict) -> bool:
    return all(_OPS[c.op](row[c.stat], c.threshold) for c in rule)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def _grow(rows: list[tuple[dict, bool]], candidates: list[Condition]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        p0 = sum(bad for _, bad in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, best_gain = None, 0.0
        for c in candidates:
            test = _OPS[c.op]
            p1 = n1 = 0
            for row, bad in rows:
                if test(row[c.stat], c.threshold):
                    p1 += bad
                    n1 += not bad
            if (g := _gain(p0, n0, p1, n1)) > best_gain + 1e-9:
                best, best_gain = c, g
        if best is None:
            break
        rule += (best,)
        rows = [(r, bad) for r, bad in rows if _OPS[best.op](r[best.stat], best.threshold)]
    return rule


def _precision(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int]:
    hit = [bad for row, bad in rows if _covers(rule, row)]
    return (sum(hit) / len(hit) if hit else 0.0), len(hit)


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    """The rule without its last conditions as far as that does not lower (good - bad) / all on rows."""

    def worth(r: Rule) -> float:
        hit = [bad for row, bad in rows if _covers(r, row)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def hash_order(value) -> str:
    return hashlib.md5(str(value).encode()).hexdigest()


def cover(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """An ordered list of rules for bad rows: (statistics, is bad). Reruns agree; no rules without both kinds of rows."""
    candidates = []
    for s in STATS:
        values = sorted({row[s] for row, _ in rows})
        cuts = sorted({(values[k] + values[k - 1]) / 2 for k in {max(1, len(values) * q // THRESHOLDS) for q in range(1, THRESHOLDS)} if k < len(values)})
        candidates += [Condition(s, op, t) for t in cuts for op in _OPS]
    grow, prune = rows[::3] + rows[1::3], rows[2::3]
    found: list[Rule] = []
    while len(found) < MOST_RULES and any(bad for _, bad in grow):
        rule = _grow(grow, candidates)
        if rule:
            rule = _prune(rule, prune)
        precision, hits = _precision(rule, prune) if rule else (0.0, 0)
        if hits < LEAST_COVER or precision < PRECISION:
            full = _grow(grow, candidates)
            precision, hits = _precision(full, prune) if full else (0.0, 0)
            if hits < LEAST_COVER or precision < PRECISION:
                break
            rule = full
        found.append(rule)
        grow = [(r, bad) for r, bad in grow if not _covers(rule, r)]
        prune = [(r, bad) for r, bad in prune if not _covers(rule, r)]
    return found


def as_column(found: list[Rule]) -> Column:
    """Whether a row is kept: an ordered conditional expression over the statistics."""
    out = None
    for rule in found:
        test = F.lit(True)
        for c in rule:
            test = test & _OPS[c.op](F.col(c.stat), F.lit(c.threshold))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules learned from at most `sample` labelled documents (least hashes of the id), half of them of quality 0 where there are enough.

    Labels or ids that are null teach nothing; texts that the base rules reject
    anyway are left out. A document that is labelled twice teaches both; of ids that
    tie in their hash the smaller comes first, of conditions that tie in their gain
    the one that is tried first, in the order of STATS and of thresholds.
    """
    known = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias(id_col), (F.col(quality_col) == 0).alias("_bad"))
    parts = [known.where("_bad" if bad else "NOT _bad").orderBy(F.xxhash64(id_col), id_col).limit(sample // 2) for bad in (True, False)]
    drawn = parts[0].unionByName(parts[1])  # at most `sample` rows of two short columns
    met = statistics(docs.join(F.broadcast(drawn.select(id_col)), id_col, "left_semi"), id_col, text_col).withColumn("_failed", base_failed())
    rows = met.join(F.broadcast(drawn), id_col).orderBy(F.xxhash64(id_col), id_col, *STATS).limit(2 * sample).collect()
    rows = sorted((r.asDict() for r in rows if not r["_failed"]), key=lambda r: [hash_order(r[id_col]), *(r[s] for s in STATS)])
    return cover([(r, bool(r["_bad"])) for r in rows])


def judged(docs: DataFrame, found: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """statistics() with base_failed and kept (false if base_failed, else the verdict of the rules)."""
    stats = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & as_column(found))
