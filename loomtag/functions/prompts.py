"""Prompts of the labelling phase: finding categories for sessions, then naming the categories of each session.

What differs between domains is a row of DOMAINS; a prompt is the template of its
domain, joined on the domain, with its placeholders filled in by column functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """What sessions are, what to judge them by, how an event reads, the language of labels, two labels as examples, what a label must not name."""

    sessions: str
    evidence: tuple[str, ...]
    event: str
    language: str
    examples: tuple[str, str]
    banned: str


DOMAINS: dict[str, Domain] = {
    "movie": Domain("film rating sessions", ("genres and themes", "high and low ratings", "variety of what is watched", "when and how often ratings are given"), "<time>: rated <score>/5 '<title>'", "English", ("Thriller Regular", "Harsh Critic"), "titles, actors or directors"),
    "amazon": Domain("online shopping sessions", ("kinds of products", "order of views", "what seems to be intended"), "<time>: viewed '<product>'", "English", ("Home Office Builder", "Gift Hunter"), "products or brands"),
    "yelp": Domain("restaurant browsing sessions", ("cuisines", "price and style of places", "how choices develop"), "<time>: visited '<place>'", "English", ("Late Night Diner", "Brunch Explorer"), "restaurants or streets"),
    "food": Domain("grocery shopping sessions", ("products bought and left", "amounts", "actions and their times"), "<time>: <action> '<product>'", "Chinese", ("夜間採購者", "健康飲食者"), "products, brands or departments"),
}


def _numbered(sections: list[tuple[str, list[str]]]) -> str:
    return "\n\n".join(f"{i}. {title}\n" + "\n".join(f"- {x}" for x in points) for i, (title, points) in enumerate(sections, 1))


def cluster_template(domain: Domain, clusters: int = 20, variance: int = 0) -> str:
    """A request for category names; {references} and {body} are left open. With a variance, a range of numbers is asked for."""
    count = f"exactly {clusters}" if variance == 0 else f"{clusters - variance} to {clusters + variance}"
    sections = [
        ("Task", [f"Below are {domain.sessions}. Sort them into {count} personas and name each.", f"Judge by {', '.join(domain.evidence)}."]),
        ("Input", ['A session begins with the word "Session".', f"Each line below it is an event: {domain.event}"]),
        ("Names", [f"Write names in {domain.language}, two to four words that describe behaviour.", f"Never name {domain.banned}; names must not overlap.", f"Examples: {', '.join(domain.examples)}"]),
    ]
    answer = 'Answer with this object and nothing else:\n{"Categories": {"Category 1": "<name>", "Category 2": "<name>"}}'
    return f"{_numbered(sections)}{{references}}\n\n{answer}\n\n{{body}}"


def label_template(domain: Domain, several: bool = True, least: int = 1, most: int = 5, example: bool = True) -> str:
    """A request for the labels of each session; {categories}, {n} (sessions) and {body} are left open."""
    if several:
        task, shape = f"Give each session {least} to {most} of the categories.", 'an array of {n} objects {"predicted_classes": ["<category>"]}'
        shown = '[{"predicted_classes": ["%s", "%s"]}, {"predicted_classes": ["%s"]}]' % (*domain.examples, domain.examples[0])
    else:
        task, shape = "Give each session the one category that fits best.", 'an array of {n} objects {"predicted_class": "<category>"}'
        shown = '[{"predicted_class": "%s"}, {"predicted_class": "%s"}]' % domain.examples
    sections = [
        ("Categories", ["{categories}"]),
        ("Task", [task, f"Judge by {', '.join(domain.evidence)}.", f"Events of a session read {domain.event}"]),
        ("Answer", [f"Answer with {shape} in the order of the sessions and nothing else.", f"Use categories exactly as they are given, in {domain.language}.", *([f"Example: {shown}"] if example else [])]),
    ]
    return f"{_numbered(sections)}\n\n{{body}}"


#: A request to improve another prompt, {body}.
AUGMENT_TEMPLATE = (
    "1. Task\n- Rewrite the instruction below so that a language model follows it better; keep what it asks for.\n"
    "- You may add steps, roles, examples, context or clearer limits, and shorten or reorder it.\n\n2. Instruction\n{body}\n\n3. Answer\n- Give the new instruction alone."
)


def templates(spark: SparkSession, make: Callable[[Domain], str]) -> DataFrame:
    """(domain, template): one row for each domain."""
    rows = F.array(*[F.struct(F.lit(name).alias("domain"), F.lit(make(d)).alias("template")) for name, d in DOMAINS.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def reference_labels(high: Column, low: Column, previous: Column) -> Column:
    """Sections 4 and on of a cluster prompt, from arrays of labels of an earlier round: those to keep, and those to avoid or else a plain list.

    A null array has no section; neither has an empty list of labels to avoid, or an
    empty plain list.
    """

    def section(number: Column, title: str, labels: Column) -> Column:
        return F.concat(F.lit("\n\n"), number.cast("string"), F.lit(f". {title}\n"), F.to_json(labels))

    keep = F.when(high.isNotNull(), section(F.lit(4), "Labels to keep where the sessions allow it", high)).otherwise("")
    number = F.when(high.isNotNull(), 5).otherwise(4)
    avoid = F.when(F.size(low) > 0, section(number, "Labels that must not be used again", low))
    plain = F.when(F.size(previous) > 0, section(number, "Labels of the last round, as a hint", previous))
    return F.concat(keep, F.coalesce(avoid, plain, F.lit("")))


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def cluster_prompts(bodies: DataFrame, table: DataFrame) -> DataFrame:
    """(key, prompt) of (key, domain, body, high, low, previous), the last three arrays of labels or null; unknown domains drop out."""
    met = bodies.join(table, "domain")
    return met.select("key", _filled(F.col("template"), {"references": reference_labels(F.col("high"), F.col("low"), F.col("previous")), "body": F.col("body")}).alias("prompt"))


def label_prompts(bodies: DataFrame, table: DataFrame) -> DataFrame:
    """(key, prompt) of (key, domain, body, n, categories), categories an array; unknown domains drop out."""
    met = bodies.join(table, "domain")
    values = {"categories": F.array_join("categories", ", "), "n": F.col("n").cast("string"), "body": F.col("body")}
    return met.select("key", _filled(F.col("template"), values).alias("prompt"))


def augment_prompts(prompts: DataFrame) -> DataFrame:
    """(key, prompt) that ask for a better form of each of (key, prompt)."""
    return prompts.select("key", _filled(F.lit(AUGMENT_TEMPLATE), {"body": F.col("prompt")}).alias("prompt"))


@dataclass(frozen=True)
class Ranking:
    """How a domain speaks of its history and of what comes next, and how many of something the preferences count."""

    past: str
    candidates: str
    aim: str
    unit: str


RANKINGS: dict[str, Ranking] = {
    "movie": Ranking("I have watched these films, in this order", "films that I could watch next", "how likely I am to watch them next", "films"),
    "amazon": Ranking("I have bought these products, in this order", "products that I could buy next", "how likely I am to buy them next", "items"),
    "yelp": Ranking("I have visited these places, in this order", "places that I could visit next", "how likely I am to visit them next", "places"),
    "food": Ranking("我依序買過這些食品", "接下來可能購買的食品", "我接下來購買的可能性", "項"),
}


def ranking_template(r: Ranking) -> str:
    return f"{{summary}}{r.past}:\n{{history}}\n\nThere are {{n}} {r.candidates}:\n{{candidates}}\n\nRank them by {r.aim}. Think step by step, give one numbered line for each, and name no others."


def from_zero(items: Column) -> Column:
    """One line per item, numbered from 0."""
    return F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x))


def ranking_prompts(queries: DataFrame, spark: SparkSession) -> DataFrame:
    """(key, prompt) of (key, domain, history, candidates): arrays of (text, preferences array).

    The preferences of the history are counted, most frequent first (ties by name),
    and head the prompt; under a candidate stand those of its own that the history
    has too. Without any preference in the history both are left out.
    """
    table = templates_of(spark, {k: (ranking_template(r), r.unit) for k, r in RANKINGS.items()})
    met = queries.join(table, "domain")
    every = F.flatten(F.transform("history", lambda h: F.coalesce(h["preferences"], F.array().cast("array<string>"))))
    met = met.withColumn("_all", every).withColumn("_names", F.array_distinct("_all"))
    counted = F.transform("_names", lambda p: F.struct((-F.size(F.filter("_all", lambda x: x == p))).alias("o"), p.alias("p")))
    lines = F.transform(F.array_sort(counted), lambda x: F.concat(F.lit("  - "), x["p"], F.lit(": "), (-x["o"]).cast("string"), F.lit(" "), F.col("unit")))
    summary = F.when(F.size("_names") > 0, F.concat(F.lit("My history shows these patterns:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")

    def shown(c: Column, i: Column) -> Column:
        both = F.array_intersect(F.coalesce(c["preferences"], F.array().cast("array<string>")), F.col("_names"))
        note = F.when(F.size(both) > 0, F.concat(F.lit("\n   [Matches: "), F.array_join(both, ", "), F.lit("]"))).otherwise("")
        return F.concat(i.cast("string"), F.lit(". "), c["text"], note)

    values = {
        "summary": summary, "history": F.array_join(from_zero(F.transform("history", lambda h: h["text"])), "\n"),
        "candidates": F.array_join(F.transform("candidates", shown), "\n"), "n": F.size("candidates").cast("string"),
    }
    return met.select("key", _filled(F.col("template"), values).alias("prompt"))


def templates_of(spark: SparkSession, rows: dict[str, tuple[str, str]]) -> DataFrame:
    """(domain, template, unit)."""
    every = F.array(*[F.struct(F.lit(k).alias("domain"), F.lit(t).alias("template"), F.lit(u).alias("unit")) for k, (t, u) in rows.items()])
    return spark.range(1).select(F.explode(every).alias("r")).select("r.*")
