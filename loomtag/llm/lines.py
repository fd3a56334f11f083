"""Line dedup by site-relative frequency: lines on more than a given share of a site's pages are boilerplate.

A line's pages are divided by the page total of its site. So that a few pages of a
small site prove nothing, it is the lower confidence limit (Wilson's) of that share
among the other pages of the site which must exceed the ratio: one formula for sites
of every size, without a least count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtag.llm.shared import let, saved

#: A line is boilerplate if it is on more than this share of its site's other pages, by the lower limit at so many standard errors.
RATIO, ERRORS = 0.01, 4.0
_BLANK = " \t\r\v\f"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a final dot; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\\\s]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def _line_key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def lower_share(n: Column, pages: Column, errors: float = ERRORS) -> Column:
    """The least share of other pages that n of pages, the one at hand among them, make credible; null for a site of one page."""
    z2, others = errors * errors, F.nullif((pages - 1).cast("double"), F.lit(0.0))
    p = (n - 1) / others
    return (p + z2 / (2 * others) - errors * F.sqrt(p * (1 - p) / others + z2 / (4 * others * others))) / (1 + z2 / others)


def boilerplate(docs: DataFrame, host: Column | str, text_col: str, ratio: float = RATIO, errors: float = ERRORS) -> DataFrame:
    """(host, keys): for each site the keys of its boilerplate lines, as 64-bit hashes of their 128 bits.

    A site has at most (mean lines of a page) / ratio of them, so that the list of
    a site does not grow with its pages. Counts are summed before the shuffle, and
    lines on one page alone are gone before the join with the page totals.
    """
    pages = docs.select((F.col(host) if isinstance(host, str) else host).alias("host"), F.col(text_col).alias("text")).where(F.col("host").isNotNull())
    keys = F.array_compact(F.array_distinct(F.transform(F.split("text", "\n"), _line_key)))
    counts = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = counts.join(totals, "host").where(lower_share(F.col("n"), F.col("pages"), errors) > ratio)
    return frequent.groupBy("host").agg(F.collect_list(F.xxhash64("key")).alias("keys"))


def without_boilerplate(docs: DataFrame, host: Column | str = "source", text_col: str = "text", ratio: float = RATIO, errors: float = ERRORS) -> DataFrame:
    """(row, text, n_lines, n_dropped) for each row of docs; row is a struct of all its columns, text what is left.

    host is a column or an expression for the site, such as host_of(F.col("url")). A
    line goes if the lower limit of its share of the site's other pages is above ratio:
    at 1 % and four standard errors on 5 of 50 pages, 15 of 500, 103 of 5,000; with
    errors=0 the plain share decides. A line on one page stays, as do all lines
    of a site with one page. A line exactly at the ratio stays.

    A page counts once for a line that it repeats; lines are compared without the
    white space around them, and blank lines are neither counted nor dropped. Rows
    that repeat an id are pages of their own. Rows with a null host belong to no site
    and lose nothing. A null text stays null with no lines; a text may become empty;
    a very long text is cleaned whole. An empty table gives no rows. Columns of docs
    may have any name.
    """
    lists = saved(boilerplate(docs, host, text_col, ratio, errors), "boilerplate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.col(host) if isinstance(host, str) else host).alias("host"), F.col(text_col).alias("text"))
    # the written lists have a known size: Spark broadcasts them below its threshold and else shuffles, splitting hot sites
    met = rows.join(lists, "host", "left")
    lines = F.split("text", "\n")
    hashes = F.transform(lines, lambda x: F.xxhash64(_line_key(x)))
    # one pass over the site's list for each page, whatever its number of lines
    left = let(F.struct(F.array_intersect(hashes, F.col("keys")).alias("gone"), hashes.alias("hashes")), lambda h: F.filter(lines, lambda x, i: ~F.array_contains(h["gone"], F.get(h["hashes"], i))))
    met = met.withColumn("lines", F.when(F.col("keys").isNull(), lines).otherwise(left))
    return met.select(
        "row",
        F.array_join("lines", "\n").alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size("lines")).cast("long").alias("n_dropped"),
    )


def cleaned(docs: DataFrame, host: Column | str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with the boilerplate lines taken out of text_col; its other columns and all rows stay."""
    found = without_boilerplate(docs, host, text_col, **options)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_P, _N, _Z2 = "((count(DISTINCT rid) - 1) / (pages - 1)::DOUBLE)", "(pages - 1)::DOUBLE", f"{ERRORS * ERRORS}::DOUBLE"
_LIMIT = f"({_P} + {_Z2} / (2 * {_N}) - {ERRORS}::DOUBLE * sqrt({_P} * (1 - {_P}) / {_N} + {_Z2} / (4 * {_N} * {_N}))) / (1 + {_Z2} / {_N})"
#: DuckDB SQL for without_boilerplate over documents with source as the site.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (
  SELECT rid, source, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT rid, source, string_split(text, chr(10)) AS parts FROM d WHERE text IS NOT NULL)
),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
t AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
b AS (
  SELECT k.source, bare FROM k JOIN t ON k.source = t.source WHERE bare <> '' GROUP BY k.source, bare, pages
  HAVING count(DISTINCT rid) > 1 AND {_LIMIT} > {RATIO}::DOUBLE
),
m AS (SELECT k.*, b.bare IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source = b.source AND k.bare = b.bare),
o AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY rid
)
SELECT doc_id, o.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN o ON d.rid = o.rid
"""
