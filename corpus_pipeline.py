"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. A document that loses every word to ``passages`` leaves no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafdr.llm import common, language_id, mixing, near_copies, packing, simhash, suffix_dedup
from spectrafdr.operators import scale


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, letterless and undecided ones go."""
    model = language_id.fit(docs.filter(common.may_learn("doc_id")))
    return language_id.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return simhash.keep_one(docs, near=near_copies.near_copies)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.remove_repeats(docs, carry=carry, with_text=True)
    cut = found.filter((F.col("n_removed") == 0) | (common.word_count("kept_text") > 0))
    columns = {
        "text": F.col("kept_text"),
        "n_chars": F.length("kept_text").cast("long"),
        **{c: F.col(f"carry_{c}") for c in carry},
    }
    return cut.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated, sampled and cut to their target weights."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: each row is a piece of a document with its bin and its place there."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", passages),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

# Trained models, fingerprints and bins have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scale.store(stage(spark, docs, sf_dir))
    return docs
