"""The registered queries on the smallest tables: SQL, brute force or held-out accuracy."""

import fixtures as fx
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrafdr.llm.oracles import ORACLES
from spectrafdr.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), ORACLES[name]) is None


def test_op1_recognises_held_out_languages(spark):
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))
    assert found.filter("held_out").join(docs, "doc_id").agg(right).first()[0] > 0.98
    assert found.filter("score < 0 OR score > 1").isEmpty()


def test_op10_separates_held_out_quality(spark):
    found = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    right = F.avg((F.col("quality") == F.col("predicted")).cast("double"))
    assert found.filter("held_out").join(labels, "doc_id").agg(right).first()[0] > 0.95
    assert found.count() == 1000


def test_op2_keeps_words_capacity_and_conflicts(spark, docs):
    pieces = QUERIES["op2_packing"](spark, FOLDER).collect()
    words = {d.doc_id: len(fx.WORD.findall(d.text or "")) for d in docs}
    total, bins = dict.fromkeys(words, 0), {}
    for p in pieces:
        total[p.doc_id] += p.n_words
        bins.setdefault(p.bin_id, []).append(p)
    assert total == words
    text = {d.doc_id: d.text.lower().split() for d in docs}
    for members in bins.values():
        assert sum(p.n_words for p in members) <= 2048
        assert len({p.source for p in members}) == len(members)
        assert len({tuple(text[p.doc_id]) for p in members}) == len(members)
        at = 0
        for p in sorted(members, key=lambda p: (p.offset, p.n_words)):
            assert p.offset == at
            at += p.n_words


def test_op4_matches_all_pairs(spark, docs):
    prints = [fx.simhash(d.text) for d in docs]
    want = fx.components(prints, [d.doc_id for d in docs])
    found = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, FOLDER).collect()}
    for d, bits, (component, _) in zip(docs, prints, want, strict=True):
        assert found[d.doc_id].fingerprint == f"{bits:016x}"
        assert found[d.doc_id].component_id == component


def test_op6_matches_brute_force(spark, docs):
    want = fx.repeats([(d.doc_id, d.text) for d in docs])
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_suffix_dedup"](spark, FOLDER).collect()}
    assert [found[d.doc_id] for d in docs] == want
    assert any(w[1] for w in want)


def test_op9_matches_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op9_token_counts"](spark, FOLDER).collect():
        text = docs[r.doc_id].text
        tokens = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), tokens, tokens > 1024)


def test_registered_with_the_entry_point():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13
    assert set(ORACLES) <= set(entry.oracle_sql())
