"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage works on all rows that the one before it kept. Rows without doc_id stay up to packing; rows that
repeat an id are judged by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diegrid.llm import decontaminate, language, ngram_join, packing, secrets
from diegrid.llm.queries import vocabulary
from diegrid.llm.store import text_batches, written
from diegrid.sources.tables import table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains; `lang` is the language found."""
    return language.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.8 or more over five-word shingles join: that with the
    smallest id, and of rows that repeat this id and text one. Documents without words, or without id, all stay."""
    found = ngram_join.components(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), width=5, num=4, den=5)
    first = written(found.where("n > 0 and id = root").select("id").distinct(), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.select("doc", "id", F.xxhash64("text").alias("h"), F.coalesce(F.col("id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("judged"))
    kept = rows.where("judged").join(first, "id", "left_semi").dropDuplicates(["id", "h"]).select("doc").union(rows.where("not judged").select("doc"))
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cleaned


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark_free),
    ("secret_scan", secret_free), ("best_fit_packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        staged = stage(spark, docs, sf_dir)
        with text_batches(spark):
            docs = written(staged, name)
    return docs
