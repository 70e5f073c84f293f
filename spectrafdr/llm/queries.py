"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafdr.llm import (
    alignment,
    common,
    hard_negatives,
    language_id,
    mixing,
    packing,
    personal_data,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
    topk,
    url_filter,
)

QUERIES: dict = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    model = language_id.fit(docs.filter(common.may_learn("doc_id")))
    found = language_id.predict(docs, model)
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@_register
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(common.table(spark, folder, "documents"))


@_register
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.table(spark, folder, "pages")
    model = url_filter.fit(url_filter.labelled_by_rules(pages))
    return url_filter.judge(pages, model)


@_register
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_register
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.ledger(common.table(spark, folder, "documents"))
    judged = quality_rules.judge(found, "v2").withColumn("base_failed", quality_rules.fails("base"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed",
    )


@_register
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.table(spark, folder, "documents"))


@_register
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mix(common.table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@_register
def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = common.table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@_register
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, folder, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_register
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    labels = common.table(spark, folder, "labels").filter(common.may_learn("doc_id"))
    model = quality_classifier.fit(docs, labels, label="quality")
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted")


@_register
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = common.table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


@_register
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, folder, "documents")
    return alignment.align(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@_register
def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find(common.table(spark, folder, "documents"))
    counts = [personal_data.count_of("spans", kind).alias(f"n_{kind}") for kind in personal_data.BASE_KINDS]
    base = personal_data.listed(personal_data.base_only("spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), personal_data.listed("spans").alias("spans"))
