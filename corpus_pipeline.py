"""From documents to packed sequences: reject toxic texts, drop copies, then near copies, cut out repeated passages, pack.

Every stage takes all documents that the one before it kept. Null and empty texts, repeated rows and further
columns go through as the operators' docstrings say; rows with a null doc_id are never near copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import exact_dedup, jaccard, packing, suffix_dedup, toxicity
from arborlake.storage import fresh_path, materialize, remove, scratch

#: Near copies: words of a shingle, percent of Jaccard similarity. Repeated passages: bytes. Window of a sequence.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
REPEATED_BYTES = 100
WINDOW = 1024


def _columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that with the smallest doc_id."""
    found = jaccard.join(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    dropped = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-near-copies")
    return docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*_columns(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that also begin earlier; n_chars follows the text."""
    cleaned = suffix_dedup.clean(docs, REPEATED_BYTES)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of WINDOW ids."""
    return packing.summary(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, WINDOW)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL states neither the scores nor the ids; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Of a stage only its result lasts, until the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(folder)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(folder), folder
    return docs
