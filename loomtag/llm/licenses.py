"""License scans with column functions only: phrases by their places, and an exact set-similarity join with templates.

A template is the set of its words. A block is a window of a text's words, twice as
long as a template at most and stepping by its length, so that any stretch of that
length lies in one. Every block that contains a share THRESHOLD of a template's
words is found: words are put in the order of their frequency in the whole corpus,
the rarest first; a block and a template that share enough words share one in their
prefixes of that order. Blocks meet templates on words of the prefixes, pass filters on
lengths and positions, and are compared in full.
"""

from __future__ import annotations

import math
import operator
import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.llm.shared import let, saved

#: What lies between words, and phrases with their labels.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Share of a template's distinct words that a block must have.
THRESHOLD = 0.9
#: Label and wording of well-known notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("no-warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """The text with A to Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


@lru_cache
def _template_sets(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, least number of them, step of the windows) of each template."""
    out = []
    for number, (label, text) in enumerate(templates):
        found = [w for w in re.split(GAPS, text.translate(str.maketrans(_UPPER, _LOWER))) if w]
        need = math.ceil(round(threshold * len(set(found)), 9))
        out.append((number, label, sorted(set(found)), need, 1 << max(3, (len(found) - 1).bit_length())))
    return out


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(found: Column, phrase: str) -> Column:
    """Where the words of the phrase stand one after the other."""
    parts = phrase.split()

    def place(w: Column, i: Column) -> Column:
        met = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            met = met & F.coalesce(F.get(found, i + k) == p, F.lit(False))
        return F.when(met, i)

    return F.when(F.array_contains(found, parts[-1]), F.array_compact(F.transform(found, place))).otherwise(F.array().cast("array<int>"))


def _blocks(found: Column, known: Column, sets: list) -> Column:
    """Windows of the words that could hold enough of a template, as (step, at, words that any template has)."""

    def of_step(step: int) -> Column:
        own = [(tokens, need) for _, _, tokens, need, s in sets if s == step]
        enough = reduce(operator.or_, [F.size(F.array_intersect(_strings(tokens), known)) >= need for tokens, need in own])
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found) - 1) / step).cast("int")))
        windows = F.transform(starts, lambda k: F.struct(F.lit(step).alias("step"), k.alias("at"), F.array_intersect(known, F.slice(found, k * step + 1, 2 * step)).alias("tokens")))
        return F.when(enough, F.filter(windows, lambda b: F.size(b["tokens"]) >= min(need for _, need in own))).otherwise(F.array().cast("array<struct<step:int,at:int,tokens:array<string>>>"))

    return F.concat(*[of_step(s) for s in sorted({s for *_, s in sets})])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, id_col, n_words, places, known, blocks) for each row of docs, written once.

    places has an array for each of PHRASES, known the words that any template has, and
    blocks the windows that have enough of them for some template of their length.
    """
    sets = _template_sets(templates, threshold)
    vocabulary = _strings(sorted({w for _, _, tokens, *_ in sets for w in tokens}))

    def facts(found: Column) -> Column:
        return let(F.array_intersect(vocabulary, found), lambda known: F.struct(
            F.size(found).cast("long").alias("n_words"), F.array(*[_places(found, p) for p, _ in PHRASES]).alias("places"),
            known.alias("known"), _blocks(found, known, sets).alias("blocks"),
        ))

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), let(words(F.col(text_col)), facts).alias("f"))
    return saved(rows.select("key", "id", "f.*"), "scanned")


def ordered_words(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One row with the words of all templates, those in the fewest documents first; ties by the word.

    Documents are counted before the shuffle; there are as many words as the templates have.
    """
    spark = rows.sparkSession
    counts = rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(_strings(vocabulary)).alias("word")).join(counts, "word", "left")
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
    return every.agg(F.transform(pairs, lambda p: p["word"]).alias("words"))


def _template_rows(spark: SparkSession, sets: list) -> DataFrame:
    values = F.array(*[F.struct(F.lit(label).alias("label"), _strings(tokens).alias("own"), F.lit(need).alias("need"), F.lit(step).alias("step")) for _, label, tokens, need, step in sets])
    return spark.range(1).select(F.inline(values))


def similar_blocks(rows: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, step, at, label, containment): every block of rows (see scanned) with a template that it contains to the threshold."""
    spark, sets = rows.sparkSession, _template_sets(templates, threshold)
    order = saved(ordered_words(rows, sorted({w for _, _, tokens, *_ in sets for w in tokens})), "order")
    ordered = order.select("words").scalar()
    left = rows.where(F.size("blocks") > 0).select("key", F.inline("blocks")).withColumn("tokens", F.array_intersect(ordered, F.col("tokens")))
    right = _template_rows(spark, sets).withColumn("own", F.array_intersect(ordered, F.col("own")))
    # of n ordered words, two sets with at least `need` in common share one among the first n - need + 1 of each
    least = F.create_map(*[F.lit(x) for s in sorted({t[4] for t in sets}) for x in (s, min(t[3] for t in sets if t[4] == s))])
    left = left.select("*", F.posexplode(F.slice("tokens", 1, F.size("tokens") - F.element_at(least, F.col("step")) + 1)).alias("j", "word"))
    right = right.select("*", F.posexplode(F.slice("own", 1, F.size("own") - F.col("need") + 1)).alias("i", "word"))
    met = left.join(F.broadcast(right), ["word", "step"])  # a row for each word of a prefix of a fixed template
    met = met.where((F.size("tokens") >= F.col("need")) & (1 + F.least(F.size("own") - 1 - F.col("i"), F.size("tokens") - 1 - F.col("j")) >= F.col("need")))
    common = F.size(F.array_intersect("own", "tokens"))
    return met.where(common >= F.col("need")).select("key", "step", "at", "label", (common / F.size("own")).alias("containment"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    n_base counts the places of PHRASES, first_word and last_word are the least and the
    largest of their starts (null without one). labels are those of the phrases and of
    the templates that a block contains; score is 1 where a phrase stands, else the
    largest share of a template in a block that reaches the threshold, else 0.

    A null or empty text has no words and no labels. A very long text is scanned whole,
    in windows; one block may have several labels. Rows with null or repeated ids stay
    rows of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = scanned(docs, id_col, text_col, templates, threshold)
    found = similar_blocks(rows, templates, threshold).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    every, none = F.flatten("places"), F.array().cast("array<string>")
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", i)) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.join(found, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.coalesce("more", none))).alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """DuckDB SQL for licenses over documents: every template against every window."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(tokens)}, {need}, {step})" for _, label, tokens, need, step in _template_sets())
    places = lambda p: f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k}] = {w!r}' for k, w in enumerate(p.split(), 1))})"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
t(label, own, need, step) AS (VALUES {templates}),
p AS (SELECT *, [{', '.join(places(p) for p, _ in PHRASES)}] AS places FROM d),
b AS (SELECT rid, s.step, unnest(range(0, len(w), s.step)) AS at FROM d, (SELECT DISTINCT step FROM t) s),
x AS (SELECT b.rid, t.label, len(list_intersect(t.own, d.w[b.at + 1 : b.at + 2 * b.step])) / len(t.own) AS share, need / len(t.own) AS least FROM b JOIN d USING (rid) JOIN t ON b.step = t.step),
m AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS best FROM x WHERE share >= least GROUP BY rid),
r AS (
  SELECT doc_id, len(w) AS n_words, flatten(places) AS every, coalesce(more, []) AS more, best,
         list_filter([{', '.join(f"CASE WHEN len(places[{i}]) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES, 1))}], lambda x: x IS NOT NULL) AS base
  FROM p LEFT JOIN m USING (rid)
)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels, CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM r
"""


#: DuckDB SQL for licenses over documents.
SQL = _sql()
