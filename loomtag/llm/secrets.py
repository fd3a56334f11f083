"""Secret scans with column functions only: known patterns, and a randomness test battery for the rest.

Every long token that no pattern covers is tested. Its encoding is inferred from its
characters; in that alphabet a chi-squared test of uniformity, a runs test and a
serial-correlation test say whether it looks drawn at random, and the place of the
same chi-squared statistic in its distribution for letters of ordinary words gives
the p-value of "this is a word". The p-values of all tokens of a corpus then go
through a false-discovery control of their own in each band of lengths, so that
short tokens, where words and random strings are hard to tell apart, do not lend
discoveries to each other or to long ones.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.llm.shared import let, saved

#: kind, pattern, group whose length counts, least length; in the order of the kinds.
PATTERNS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a shorter match leaves nothing behind it that could match
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: encoding: characters that it admits, alphabet in order of value, excess of squared letter frequencies of ordinary text over uniform ones.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", 0.5),
    ("hex", r"^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.6),
    ("letters", r"^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.4),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
)
#: Lower ends of the bands of lengths, level of the false-discovery control, level of the randomness tests.
BANDS, FDR, ALPHA = (20, 32, 48, 80), 0.01, 0.01
#: p-values are counted in steps of 2^(-1/STEPS), MOST_STEP the last.
STEPS, MOST_STEP = 4, 400


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0, by the polynomial of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * (1 / math.sqrt(2 * math.pi)) * poly


def _lower(z: Column) -> Column:
    return F.when(z < 0, _upper_tail(-z)).otherwise(1 - _upper_tail(z))


def _two_sided(z: Column) -> Column:
    return 2 * _upper_tail(F.abs(z))


def _running(values: Column) -> Column:
    """Sums of the values up to and with each, by steps that double: n log n for an array of n."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= F.call_function("shiftleft", F.lit(1), k), F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))), F.lit(0)))

    return F.aggregate(steps, values, double)


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, value) of the matches whose group has the least length, in code points.

    The pieces between the matches give their places as running sums.
    """
    text = F.coalesce(text, F.lit(""))
    whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def places(x: Column) -> Column:
        widths = F.transform(x["whole"], lambda w, i: F.length(F.get(x["gaps"], i)) + F.length(w))
        return let(_running(widths), lambda ends: F.filter(
            F.transform(x["whole"], lambda w, i: F.struct((F.get(ends, i) - F.length(w)).alias("start"), F.get(ends, i).alias("end"), w.alias("value"))),
            lambda w, i: F.length(F.get(x["inner"], i)) >= least,
        ))

    parts = F.struct(whole.alias("whole"), inner.alias("inner"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(parts, places)).otherwise(none)


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) overlaps one of the spans, which are in order and apart: the first that ends after start, by bisection."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2((F.size(spans) + 1).cast("double"))).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        late = F.coalesce(F.get(spans, middle)["end"] > start, F.lit(True))
        return F.struct(F.when(late, acc["lo"]).otherwise(F.least(middle + 1, acc["hi"])).alias("lo"), F.when(late, middle).otherwise(acc["hi"]).alias("hi"))

    return F.coalesce(F.get(spans, F.aggregate(steps, zero, halve, lambda acc: acc["lo"]))["start"] < end, F.lit(False))


def _battery(tokens: Column) -> Column:
    """Adds to each (start, end, value): the length band and the step of its p-value (0: it fails a randomness test)."""

    def encode(x: Column) -> Column:
        value = x["value"]
        kind = F.coalesce(*[F.when(value.rlike(p), F.lit(i)) if p else F.lit(i) for i, (_, p, _, _) in enumerate(ENCODINGS)])
        core = F.coalesce(*[
            F.when(kind == i, F.lower(value) if name in ("hex", "letters") else F.regexp_replace(F.translate(value, "-_", "+/"), "=", ""))
            for i, (name, _, _, _) in enumerate(ENCODINGS)
        ])
        table = F.array(*[F.struct(F.lit(a).alias("letters"), F.lit(float(len(a))).alias("k"), F.lit(d).alias("excess")) for _, _, a, d in ENCODINGS])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), core.alias("core"), F.get(table, kind).alias("e"))

    def values(x: Column) -> Column:
        chars = F.filter(F.split(x["core"], ""), lambda c: c != "")
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["e"]["k"].alias("k"), x["e"]["excess"].alias("excess"), F.length(x["core"]).cast("double").alias("n"),
            F.transform(chars, lambda c: (F.position(c, x["e"]["letters"]) - 1).cast("double")).alias("v"),
            F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.length(x["core"]) - F.length(F.replace(x["core"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
        )

    def sums(x: Column) -> Column:
        # every array and the mean are bound once: inside a lambda they would be computed again for each character
        v, k, n = x["v"], x["k"], x["n"]
        mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / F.greatest(n, F.lit(1.0))
        return let(F.struct(v.alias("v"), mean.alias("mean"), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))).alias("next")), lambda y: _moments(x, y, k, n))

    def _moments(x: Column, y: Column, k: Column, n: Column) -> Column:
        high = lambda c: c >= k / 2
        # of each character and the next one: whether a run ends between them, and the product of their distances from the mean
        follow = F.zip_with(F.slice(y["v"], 1, F.greatest(F.size(y["v"]) - 1, F.lit(0))), y["next"], lambda a, b: F.struct((high(a) != high(b)).alias("turn"), ((a - y["mean"]) * (b - y["mean"])).alias("product")))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), k.alias("k"), n.alias("n"), x["excess"].alias("excess"),
            F.coalesce(F.try_divide(k * x["squares"], n) - n, F.lit(1e9)).alias("chi"),
            F.size(F.filter(y["v"], high)).cast("double").alias("above"),
            F.aggregate(y["v"], F.lit(0.0), lambda a, c: a + F.pow(c - y["mean"], F.lit(2.0))).alias("spread"),
            let(follow, lambda f: F.struct((F.size(F.filter(f, lambda c: c["turn"])) + 1).cast("double").alias("runs"), F.aggregate(f, F.lit(0.0), lambda a, c: a + c["product"]).alias("serial"))).alias("follow"),
        )

    def judge(x: Column) -> Column:
        k, n, up = x["k"], x["n"], x["above"]
        df = k - 1
        cube = 2 / (9 * df)
        z_chi = (F.cbrt(x["chi"] / df) - (1 - cube)) / F.sqrt(cube)
        p_chi = F.when(z_chi > 0, _upper_tail(F.abs(z_chi))).otherwise(1.0)
        both = 2 * up * (n - up)
        expected, variance = F.try_divide(both, n) + 1, F.try_divide(both * (both - n), n * n * (n - 1))
        p_runs = F.coalesce(_two_sided(F.try_divide(x["follow"]["runs"] - expected, F.sqrt(F.when(variance > 0, variance)))), F.lit(0.0))
        p_serial = F.coalesce(_two_sided((F.try_divide(x["follow"]["serial"], x["spread"]) + F.try_divide(F.lit(1.0), n)) * F.sqrt(n)), F.lit(0.0))
        looks_random = 3 * F.least(p_chi, p_runs, p_serial) >= ALPHA
        word_mean, word_sd = df + n * x["excess"], F.sqrt(2 * df + 4 * n * x["excess"])
        p_word = _lower((x["chi"] - word_mean) / word_sd)
        step = F.when(looks_random, F.least(F.floor(-F.log2(F.greatest(p_word, F.lit(1e-200))) * STEPS), F.lit(MOST_STEP)).cast("int")).otherwise(0)
        band = sum((F.when(x["end"] - x["start"] >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), band.alias("band"), step.alias("step"))

    for f in (encode, values, sums, judge):
        tokens = F.transform(tokens, f)
    return tokens


def critical_steps(tokens: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """{band: least step that is a discovery} by Benjamini and Hochberg's rule over counts of (band, step).

    The counts are at most bands x steps rows, whatever the corpus.
    """
    counts = tokens.groupBy("band", "step").count()
    smaller = Window.partitionBy("band").orderBy(F.desc("step"))
    rule = F.pow(F.lit(2.0), -F.col("step") / STEPS) * F.sum("count").over(Window.partitionBy("band")) / F.sum("count").over(smaller) <= fdr
    return {r["band"]: r["least"] for r in counts.withColumn("ok", rule).where("ok AND step > 0").groupBy("band").agg(F.min("step").alias("least")).collect()}


def _named(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("number"), x["end"].alias("end"), F.lit(KINDS[number]).alias("kind")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id_col, base, added) for each row of docs: arrays of (start, number, end, kind), sorted; number is that of the kind.

    base holds the matches of PATTERNS, leftmost and non-overlapping within a kind;
    added the tokens found by the battery that overlap none of them. Offsets count
    code points, the end is exclusive. A null or empty text has no spans. A very long
    text is scanned whole, in time n log n of its matches and tokens. Tokens that tie
    in their p-value are found or left together. Rows with null or repeated ids stay
    rows of their own. An empty table gives no rows; columns besides the two named
    are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(
        "id", *[_found(F.col("text"), p, g, least).alias(kind) for kind, p, g, least in PATTERNS], _found(F.col("text"), TOKEN, 0, 1).alias("tokens")
    )
    spans = [_named(F.col(kind), i) for i, (kind, *_) in enumerate(PATTERNS)]
    covered = lambda t: reduce(operator.or_, [_meets(F.col(kind), t["start"], t["end"]) for kind, *_ in PATTERNS])
    rows = rows.select("id", F.sort_array(F.concat(*spans)).alias("base"), F.filter("tokens", lambda t: ~covered(t)).alias("tokens"))
    rows = saved(rows.select("id", "base", _battery(F.col("tokens")).alias("tokens")), "tokens")
    steps = critical_steps(rows.select(F.explode("tokens").alias("t")).select("t.*"), fdr)
    chosen = F.filter("tokens", lambda t: F.coalesce(*[F.when((t["band"] == b) & (t["step"] >= s), True) for b, s in steps.items()], F.lit(False)))
    return rows.select(F.col("id").alias(id_col), "base", _named(chosen, len(PATTERNS)).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the SHA-256 of the base spans, and all spans as text."""
    counts = [_count(kind).alias(f"n_{kind}") for kind, *_ in PATTERNS]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
