"""A corpus for training, from documents to packed sequences: one operator of loomtag.llm in each stage.

Every stage takes an empty table, keeps columns besides those it reads, whatever
their names, and reads whole texts, very long ones too. What else it does with nulls,
ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtag.llm import langid, lines, mixing, packing, superminhash
from loomtag.llm.shared import new_path, removed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the recurrent network recognises, unchanged.

    A null or empty text, or one without a letter, has no language and goes; a null
    lang, source or doc_id does not matter. Repeated rows are judged alike. Where no
    document has a language nothing can be recognised, and all go.
    """
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents of their source have; no document goes.

    A null text stays null, an emptied one stays as an empty text; documents without
    a source lose nothing. Repeated rows count as pages of their own. A line exactly
    at the ratio stays.
    """
    return lines.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles, similarity 0.8.

    The least doc_id of a group stays, one row of those that repeat it. Documents
    with a null doc_id, and those without words, are copies of nothing and stay.
    """
    return superminhash.one_of_each(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes of each document, in the order of training.

    A null source is a source. A document without words is taken like others where
    its place lies before the target, at no cost. Rows that repeat a doc_id, or have
    none, are documents of their own; copies at one position come in either order.
    """
    return mixing.training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of the permitted lengths, numbered along the order of training.

    Documents without words (or null) have a place in no sequence; rows that repeat a
    doc_id, or have none, are packed on their own. Pieces of one length go in the
    order of training.
    """
    return packing.packed(docs, order=packing.stored_order())


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: The language model and the signatures have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written to the shared folder and read again; what a stage has read is deleted when it is done."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read:
            removed(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
