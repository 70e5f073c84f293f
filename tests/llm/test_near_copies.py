"""Near copies of the pipeline's stage against brute force over all pairs."""

import corpus_pipeline
import fixtures as fx
import pytest

from spectrafdr.llm import near_copies

FOLDER = "/root/testdata/sf0.001"


def groups(texts, width=5, similarity=0.8):
    """The smallest place of each text's component, by flood fill over all pairs."""
    sets = [near_copies.shingles(t, width) for t in texts]
    label = [None] * len(sets)
    for start in range(len(sets)):
        queue = [start] if label[start] is None else []
        while queue:
            one = queue.pop()
            label[one] = start
            for other in range(len(sets)):
                if label[other] is None and near_copies.jaccard(sets[one], sets[other]) >= similarity:
                    label[other] = start
                    queue.append(other)
    return label


def edited(words, every, name):
    return " ".join(f"{name}{i}" if i % every == 7 else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def texts(spark):
    read = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()
    words = [f"w{i * i % 997}" for i in range(400)]
    # Sources with one word of 60 or 100 replaced, a chain of edits, and the awkward rows.
    made = [" ".join(words), *(edited(words, n, "edit") for n in (20, 30, 60, 100, 200))]
    made += [" ".join(words[:400 - 40 * n]) for n in range(1, 5)]
    return [r.text for r in read] + made + [r[1] for r in fx.awkward_rows()]


def test_components_match_all_pairs(spark, texts):
    docs = fx.documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    found = {r.doc_id: r.label for r in near_copies.near_copies(docs).collect()}
    names = {}
    for i, group in enumerate(groups(texts)):
        names.setdefault(found[i], set()).add(group)
    assert all(len(g) == 1 for g in names.values()) and len(names) == len(set(groups(texts)))


def test_stage_drops_copies_with_a_few_edited_words(spark, texts):
    docs = fx.documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    assert kept == set(groups(texts))


def test_empty_table_gives_no_rows(spark):
    assert near_copies.near_copies(fx.documents(spark, [])).collect() == []
