"""The pipeline stage by stage, each against a plain version on its own input."""

import corpus_pipeline
import fixtures as fx
import pytest
from pyspark.sql import functions as F
from test_near_copies import groups as near_groups

from spectrafdr.llm import mixing
from spectrafdr.operators import scale

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, over the smallest documents and the awkward ones."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(fx.documents(spark).columns)
    extra = [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in fx.awkward_rows() if r[1] != "other text with the same id"]
    docs = scale.store(docs.unionByName(fx.documents(spark, extra)))
    out = []
    for _, stage in corpus_pipeline.STAGES:
        made = scale.store(stage(spark, docs, FOLDER))
        out.append((docs, made))
        docs = made
    return out


def test_language_rejects_texts_without_language(stages):
    before, after = stages[0]
    letterless = [r for r in before.collect() if not any(c.isalpha() for c in r.text or "")]
    assert before.count() - after.count() == len(letterless)
    assert after.columns == before.columns


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1][0].collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    groups = near_groups([r.text for r in rows])
    kept = stages[1][1].collect()
    assert len(kept) == len(set(groups))
    assert {r.doc_id for r in kept} == {rows[g].doc_id for g in groups}
    assert set(kept) <= set(rows)


def test_repeated_passages_go(stages):
    rows = stages[2][0].collect()
    want = {r.doc_id: w for r, w in zip(rows, fx.repeats([(r.doc_id, r.text) for r in rows]), strict=True)}
    kept = {r.doc_id: r for r in stages[2][1].collect()}
    for row in rows:
        n_bytes, n_removed, _, _ = want[row.doc_id]
        if not n_removed:
            assert kept[row.doc_id] == row
        elif row.doc_id in kept:
            # Whole characters stay, so a cut text can only be longer than the kept bytes.
            assert n_bytes - n_removed <= len(kept[row.doc_id].text.encode()) < n_bytes
            assert kept[row.doc_id].n_chars == len(kept[row.doc_id].text)
    assert any(w[1] for w in want.values())


def test_mix_takes_each_sources_target_in_whole_documents(spark, stages):
    before, after = (d.collect() for d in stages[3])
    size = lambda r: len(fx.WORD.findall(r.text))
    taken = {r.source: r for r in mixing.mix(stages[3][0]).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    largest, got = {}, {}
    for r in before:
        largest[r.source] = max(largest.get(r.source, 0), size(r))
    for r in after:
        got[r.source] = got.get(r.source, 0) + size(r)
    for source, row in taken.items():
        assert abs(got.get(source, 0) - row.n) <= largest[source] / 2 + 1
    assert set(after) <= set(before)
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3


def test_packed_sequences_hold_the_mix(stages):
    before, pieces = (d.collect() for d in stages[4])
    assert sum(p.n_words for p in pieces) == sum(len(fx.WORD.findall(r.text)) for r in before)
    bins = {}
    for p in pieces:
        assert len(fx.WORD.findall(p.text)) == p.n_words
        bins.setdefault(p.bin_id, []).append(p)
    for members in bins.values():
        assert sum(p.n_words for p in members) <= 2048
        assert len({p.source for p in members}) == len(members)


def test_run_applies_all_stages(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_empty_table_passes_all_stages(spark):
    docs = fx.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = scale.store(stage(spark, docs, FOLDER))
    assert docs.count() == 0


def test_clashing_columns_pass_all_stages(spark):
    names = ["_taken", "_rows", "_id", "_own", "_doc", "_row", "_copy", "_content", "_source", "_from", "label", "lead", "key"]
    plain = fx.documents(spark)
    docs = plain.withColumns({n: F.lit("own") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs = (scale.store(stage(spark, d, FOLDER)) for d in (plain, docs))
        assert docs.columns == [*plain.columns, *names]
        assert docs.select(*[F.col(n) for n in names]).distinct().count() <= 1
        assert fx.rows_of(docs, *plain.columns) == fx.rows_of(plain, *plain.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0
