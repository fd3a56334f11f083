"""Texts around labelling and ranking models: parsing completions, normalising labels, writing prompts.

All are column expressions but the longest common subsequence, which is one Arrow function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILED = "Failed_Prediction"


def _none() -> Column:
    return F.array().cast("array<string>")


def normalised_name(name: Column) -> Column:
    """Without ideographic spaces, trimmed."""
    return F.trim(F.regexp_replace(name, "　", ""))


def cell_strings(cell: Column) -> Column:
    """The quoted strings of an event cell, in order."""
    return F.transform(F.regexp_extract_all(cell, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def event_cell(cell: Column) -> Column:
    """(session, action, item) of a cell `[session, datetime…, 'action', 'item']`; text is matched, never evaluated."""
    strings = cell_strings(cell)
    return F.struct(
        F.regexp_extract(cell, r"(-?\d+)", 1).try_cast("long").alias("session"),
        F.try_element_at(strings, F.lit(-2)).alias("action"),
        F.try_element_at(strings, F.lit(-1)).alias("item"),
    )


def movie_cell(cell: Column) -> Column:
    """(rating, title) of a cell `(datetime…, rating, 'title')`."""
    return F.struct(F.regexp_extract(cell, r"\),\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("rating"), F.try_element_at(cell_strings(cell), F.lit(-1)).alias("title"))


# The characters of a tag in completions of one text and of several, and marked spans.
WORD_TAG = r"(?U)\b[a-zA-Z\- \u4E00-\u9FFF]+\b"
BEAM_TAG = r"(?U)\b[a-zA-Z\- \u4E00-\u9FFF.']+\b"
MARKED_TAG = r"\*+([a-zA-Z\- \u4E00-\u9FFF'.]+)\*+"


def _tags(line: Column, pattern: str, group: int = 0) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(line), F.lit(pattern), F.lit(group)), lambda t: F.btrim(t))
    return F.filter(found, lambda t: t != "")


def numbered_tags(completion: Column, first: int = 0, last: int | None = None) -> Column:
    """Tags of a numbered list: runs of letters, blanks and hyphens in lines [first, last), lowered; digits and other characters end a tag.

    What precedes the first `1.` is dropped; without one there are no tags. A negative last counts from the end.
    """
    body = F.nullif(F.regexp_extract(completion, r"(?s)1\..*", 0), F.lit(""))
    lines = F.split(F.substring(body, F.lit(3), F.length(body)), r"\n\d+\.")
    end = F.size(lines) if last is None else F.lit(last) if last >= 0 else F.size(lines) + last
    part = F.slice(lines, first + 1, F.greatest(end - first, F.lit(0)))
    return F.coalesce(F.flatten(F.transform(part, lambda x: _tags(x, WORD_TAG))), _none())


def beam_tags(beams: Column, first: int, last: int, n_beams: int | None = None, include_input: bool = False) -> Column:
    """Tags of the lines numbered first + 1 to last of the first n_beams of several completions, in their order, repeats kept.

    include_input puts what follows `1.` in the first completion before them. In a line spans
    between stars win where there are any; else runs of letters, blanks, hyphens, dots and apostrophes are tags.
    """
    used = beams if n_beams is None else F.slice(beams, 1, n_beams)
    numbered = lambda text: F.array(*[F.regexp_extract(text, rf"\n{i}\. ([^\n]+)", 1) for i in range(first + 1, last + 1)])
    lines = F.flatten(F.transform(used, numbered))
    if include_input:
        lines = F.concat(F.array(F.regexp_extract(F.get(beams, F.lit(0)), r"1\. ([^\n]+)", 1)), lines)
    tags = lambda line: F.when(F.lower(line).rlike(MARKED_TAG), _tags(line, MARKED_TAG, 1)).otherwise(_tags(line, BEAM_TAG))
    return F.coalesce(F.flatten(F.transform(lines, tags)), _none())


def json_array(text: Column) -> Column:
    """From the first [ to the last ]; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def _texts(values: Column) -> Column:
    """The strings among variants."""
    return F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))


def normalised_labels(prediction: Column, most: int = 5, separator: str = ";") -> Column:
    """Labels of a prediction in any of its shapes: {"predicted_classes": […]}, {"predicted_class": "…"} (one label, whole), a list, or text split at the separator.

    Text that is no JSON is split, also where it begins with a bracket; in a list only
    strings count. Trimmed, distinct, at most `most`; `Unknown` if there are none.
    """
    start, is_json = F.substring(F.ltrim(prediction), 1, 1), F.try_parse_json(prediction).isNotNull()
    obj = F.from_json(prediction, "predicted_classes array<variant>, predicted_class variant")
    one = _texts(F.array(obj["predicted_class"]))
    of_object = F.coalesce(_texts(obj["predicted_classes"]), one, _none())
    got = F.when(is_json & (start == "{"), of_object).when(is_json & (start == "["), F.coalesce(_texts(F.from_json(prediction, "array<variant>")), _none()))
    got = F.coalesce(got, F.split(prediction, re.escape(separator)), _none())
    clean = F.slice(F.array_distinct(F.filter(F.transform(got, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))), 1, most)
    return F.when(F.size(clean) == 0, F.array(F.lit("Unknown"))).otherwise(clean)


# Names behind `Category n`, quoted and loose.
QUOTED_CATEGORY = r'\bCategory\s*\d+\b\s*:\s*"([^"]+)"'
LOOSE_CATEGORY = r"\bCategory\s*\d+\b\s*[:\-]\s*([\w\-\s/&]+)"


def category_names(completion: Column) -> Column:
    """Names in {"Categories": {"Category 1": "…"}}, a flat object or a list, as they stand; else what is quoted behind `Category n:`, else what follows it loosely, trimmed."""
    inner = F.regexp_extract(completion, r"(?s)\{.*\}", 0)
    body = F.when(inner != "", inner).otherwise(completion)
    filled = lambda names: F.filter(names, lambda x: F.btrim(x) != "")
    some = lambda names: F.when(F.size(names) > 0, names)
    nested = filled(_texts(F.map_values(F.from_json(body, "Categories map<string,variant>")["Categories"])))
    flat = F.when(F.ltrim(body).startswith("{"), some(filled(_texts(F.map_values(F.from_json(body, "map<string,variant>"))))))
    listed = F.when(F.ltrim(body).startswith("[") & F.try_parse_json(body).isNotNull(), filled(_texts(F.from_json(body, "array<variant>"))))
    loose = lambda pattern: some(filled(F.transform(F.regexp_extract_all(completion, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))))
    return F.coalesce(nested, flat, listed, loose(QUOTED_CATEGORY), loose(LOOSE_CATEGORY), _none())


def checked_batches(batches: DataFrame) -> DataFrame:
    """(batch, pos, label) of (batch, size, labels): a batch with another number of labels than sessions has failed as a whole."""
    good = F.when(F.size("labels") == F.col("size"), F.col("labels")).otherwise(F.array_repeat(F.lit(FAILED), F.col("size").cast("int")))
    return batches.select("batch", F.posexplode(good).alias("pos", "label"))


def top_classes(labels: DataFrame, n: int) -> DataFrame:
    """Rows (session_id, labels) with only the n most frequent labels left (ties by name); failed and emptied rows drop out."""
    ok = labels.where(~F.array_contains("labels", FAILED))
    counts = ok.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("c"))
    best = counts.orderBy(F.desc("c"), "label").limit(n).agg(F.collect_set("label").alias("best"))
    kept = ok.withColumn("_best", best.scalar())
    return kept.withColumn("labels", F.filter("labels", lambda x: F.array_contains("_best", x))).drop("_best").where(F.size("labels") > 0)


def session_text(events: DataFrame, key: str, order: tuple[str, ...], line: Column, tags: DataFrame | None = None) -> DataFrame:
    """(key, text): a header, a line for each event in order, and optionally a line of tags (key, tags); a session without lines says so."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    body = events.groupBy(key).agg(F.transform(pairs, lambda x: x["line"]).alias("lines"))
    head = F.concat(F.lit("Session "), F.col(key).cast("string"), F.lit(":"))
    last = _none()
    if tags is not None:
        body = body.join(tags.select(key, "tags"), key, "left")
        last = F.when(F.size("tags") > 0, F.array(F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))).otherwise(_none())
    lines = F.filter("lines", lambda x: x.isNotNull() & (x != ""))
    return body.select(key, F.when(F.size(lines) == 0, F.lit("Empty session")).otherwise(F.array_join(F.concat(F.array(head), lines, last), "\n")).alias("text"))


def action_line(action: Column, name: Column) -> Column:
    """`- action 'name'`; an action that is missing is a load, without a name there is no line."""
    clean = F.nullif(normalised_name(name), F.lit(""))
    return F.when(clean.isNotNull(), F.concat(F.lit("- "), F.coalesce(F.nullif(action, F.lit("")), F.lit("load")), F.lit(" '"), clean, F.lit("'")))


def rating_line(ts: Column, rating: Column, title: Column) -> Column:
    """`- 12:30:05: rated 4/5 'title'`."""
    return F.concat(F.lit("- "), F.date_format(ts, "HH:mm:ss"), F.lit(": rated "), rating.cast("string"), F.lit("/5 '"), title, F.lit("'"))


def visit_line(verb: str, item: Column, title: Column, least: int) -> Column:
    """`- verb 'title'`, the item itself where no title is known; ids shorter than `least` have no line."""
    return F.when(F.length(item) >= least, F.concat(F.lit(f"- {verb} '"), F.coalesce(title, item), F.lit("'")))


#: Of sessions whose items are ids alone: the verb of a line and the least length of an id.
VISITS = {"amazon": ("viewed", 8), "yelp": ("visited", 20)}


def item_text(tags: Column) -> Column:
    """Tags as a sentence; `unknown item.` without any."""
    return F.when(F.size(F.coalesce(tags, _none())) == 0, F.lit("unknown item.")).otherwise(F.concat(F.array_join(tags, " "), F.lit(".")))


def article_first(title: Column) -> Column:
    """`Name, The` as `The Name`."""
    return F.regexp_replace(title, r"^(.*), (The|A)$", "$2 $1")


def clean_title(title: Column) -> Column:
    return F.translate(title, "\t", " ")


def numbered(items: Column) -> Column:
    """One numbered line per item, from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def rank_prompt(template: Column, history: Column, candidates: Column, preferences: Column) -> Column:
    """A ranking prompt: {history}, {candidates}, {preferences} and {n} of the template are filled in."""
    out = F.replace(template, F.lit("{history}"), numbered(history))
    out = F.replace(out, F.lit("{candidates}"), numbered(candidates))
    out = F.replace(out, F.lit("{preferences}"), F.array_join(preferences, ", "))
    return F.replace(out, F.lit("{n}"), F.size(candidates).cast("string"))


def token_prompt(user: Column, items: Column) -> Column:
    """A prompt of user and item tokens."""
    return F.concat(F.lit("<user_"), user.cast("string"), F.lit("> has purchased "), F.array_join(F.transform(items, lambda i: F.concat(F.lit("<item_"), i.cast("string"), F.lit(">"))), " "), F.lit("."))


def repaired_tokens(text: Column) -> Column:
    """item_7 outside of brackets becomes <item_7>."""
    return F.regexp_replace(text, r"(?<!<)\bitem_(\d+)\b(?!>)", r"<item_$1>")


def ranked_indexes(answer: Column, budget: int) -> Column:
    """Distinct indexes below the budget, one per line of the answer, in order."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(x))
    numbers = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d+$")), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x < budget))


def ranked_by_index(answers: DataFrame, candidates: DataFrame, budget: int) -> DataFrame:
    """(qid, item, score) of answers (qid, answer) whose lines are indexes of candidates (qid, pos, item, text), pos from 0.

    Lines that are no number below the budget are passed over; of candidates with one
    text the first named counts, and the k-th found scores budget - k + 1.
    """
    lines = answers.select("qid", F.posexplode(ranked_indexes(F.col("answer"), budget)).alias("line_no", "pos"))
    hits = lines.join(candidates, ["qid", "pos"])
    once = F.row_number().over(Window.partitionBy("qid", "text").orderBy("line_no"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("line_no"))
    return hits.withColumn("_o", once).where("_o = 1").withColumn("k", order).select("qid", "item", (F.lit(budget) - F.col("k") + 1).alias("score"))


def preference_histogram(tags: DataFrame, suffix: str) -> DataFrame:
    """(key, preferences): `name (count)` of the preference tags in (key, tags), most common first, ties by name."""
    long = tags.select("key", F.explode("tags").alias("t")).where(F.endswith("t", F.lit(suffix)))
    counts = long.groupBy("key", F.regexp_replace("t", f"{suffix}$", "").alias("p")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "p")))
    return counts.groupBy("key").agg(F.transform(pairs, lambda x: F.concat(x["p"], F.lit(" ("), (-x["o"]).cast("string"), F.lit(")"))).alias("preferences"))


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts, a row of the table at a time as the bits of one number."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        places: dict[str, int] = {}
        for j, ch in enumerate(y):
            places[ch] = places.get(ch, 0) | 1 << j
        full = (1 << len(y)) - 1
        row = full
        for ch in x:
            hit = row & places.get(ch, 0)
            row = (row + hit | row - hit) & full
        return len(y) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def ranked_by_text(answers: DataFrame, candidates: DataFrame, budget: int, share: float = 0.9) -> DataFrame:
    """(qid, item, score) of answers (qid, answer) against candidates (qid, pos, item, text).

    A line, without its number, names the first candidate that contains it, lies in
    it, or shares more than `share` of its letters in order; each candidate counts
    once, and the k-th found scores budget - k + 1. Lines that repeat the request
    (`candidate movies:`) are passed over. The letters are compared only where neither
    text holds the other and the line is long enough.
    """
    line = F.trim(F.regexp_replace("raw", r"^\d+\. ", ""))
    lines = answers.select("qid", F.posexplode(F.split("answer", "\n")).alias("line_no", "raw")).where(~F.endswith("raw", F.lit("candidate movies:"))).select("qid", "line_no", line.alias("line")).where("line <> ''")
    pairs = lines.join(candidates, "qid").withColumn("inside", F.contains("line", F.col("text")) | F.contains("text", F.col("line")))
    near = pairs.where(~F.col("inside") & (F.length("line") > F.length("text") * share)).withColumn("lcs", common_subsequence("text", "line")).where(F.col("lcs") > F.length("text") * share).drop("lcs")
    found = pairs.where("inside").unionByName(near)
    first = F.row_number().over(Window.partitionBy("qid", "line_no").orderBy("pos"))
    once = F.row_number().over(Window.partitionBy("qid", "item").orderBy("line_no"))
    hits = found.withColumn("_r", first).where("_r = 1").withColumn("_o", once).where("_o = 1")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("line_no"))
    return hits.withColumn("k", order).select("qid", "item", (F.lit(budget) - F.col("k") + 1).alias("score")).where("score > 0")


def config_value(text: Column, name: str) -> Column:
    """The value of name=… (or name:…) in a configuration text."""
    return F.nullif(F.regexp_extract(text, rf"{name}['\"]?\s*[=:]\s*['\"]?([A-Za-z0-9_.\-]+)", 1), F.lit(""))


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def prompt_batches(texts: DataFrame, size: int = 4) -> DataFrame:
    """(batch, n, prompt): consecutive groups of `size` of (idx, text), idx dense from 0."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return texts.groupBy(F.floor(F.col("idx") / size).alias("batch")).agg(F.count("*").alias("n"), F.array_join(F.transform(pairs, lambda x: x["text"]), "\n\n").alias("prompt"))
