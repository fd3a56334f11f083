"""The queries opN_* of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.llm import alignment, archive, langid, licenses, lines, manifest, mixing, ordinal, packing, rpforest, rules, secrets, superminhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(_table(spark, sf_dir, "documents")))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.converted(_table(spark, sf_dir, "pages"))


def op3_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(_table(spark, sf_dir, "documents"))


def op4_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_boilerplate(_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_dropped")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = ordinal.learn(docs, labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade")), levels=3)
    return ordinal.grades(docs, model).withColumn("kept", F.col("tail_prob") >= 0.5)


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rpforest.search(rows, rows.where("vec_id % 100 = 0"), k=10)


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = rules.learn(docs, _table(spark, sf_dir, "labels"))
    return rules.judged(docs, found).select("doc_id", *rules.BASE, "base_failed", "kept")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"), manifest.tampered())


#: Where the vocabularies lie on every machine; LOOMTAG_TOKENIZERS names another folder.
TOKENIZERS = os.environ.get("LOOMTAG_TOKENIZERS", "/opt/tokenizers")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_curriculum": op3_curriculum,
    "op4_bigru_language": op4_bigru_language,
    "op5_site_lines": op5_site_lines,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_projection_forest": op7_projection_forest,
    "op8_superminhash": op8_superminhash,
    "op9_decision_list": op9_decision_list,
    "op10_best_fit": op10_best_fit,
    "op11_license_join": op11_license_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_arc_to_warc": archive.SQL,
    "op3_curriculum": mixing.SQL,
    "op5_site_lines": lines.SQL,
    "op11_license_join": licenses.SQL,
    "op12_merkle_manifest": manifest.SQL,
}
