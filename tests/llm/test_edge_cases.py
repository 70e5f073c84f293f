"""Nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

import fixtures as fx
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.llm import (
    common,
    components,
    language_id,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
    topk,
    url_filter,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def identify(docs):
    return language_id.predict(docs, language_id.fit(docs.filter(common.may_learn("doc_id"))))


def classify(docs):
    labels = docs.select("doc_id", F.length("lang").alias("quality")).withColumn(
        "quality", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)
    )
    return quality_classifier.score(docs, quality_classifier.fit(docs, labels, label="quality", epochs=2))


OPERATORS = {
    "language_id": identify,
    "packing": packing.pack,
    "packing_text": lambda d: packing.pack(d, with_text=True, capacity=500),
    "simhash": simhash.near_duplicates,
    "simhash_keep": simhash.keep_one,
    "quality_rules": quality_rules.ledger,
    "suffix_dedup": suffix_dedup.remove_repeats,
    "suffix_dedup_text": lambda d: suffix_dedup.remove_repeats(d, with_text=True, carry=("lang", "source")),
    "mixing": mixing.mix,
    "mixed_documents": lambda d: mixing.mixed_documents(d, mixing.mix(d)),
    "token_counts": lambda d: token_counts.count_tokens(d, VOCABULARY),
    "quality_classifier": classify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](fx.documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    docs = fx.documents(spark)
    plain = OPERATORS[name](docs)
    names = [c for c in plain.columns if c not in fx.CLASHING or c in ("score", "bits", "label", "size", "failed")]
    clashing = OPERATORS[name](fx.with_clashes(docs))
    names = [c for c in names if c in clashing.columns]
    if name in ("simhash_keep", "mixed_documents"):
        names = docs.columns
    assert fx.rows_of(clashing, *names) == fx.rows_of(plain, *names)


def test_language_defined_results(spark):
    found = {(r.doc_id, r.lang_pred): r.score for r in identify(fx.documents(spark)).collect()}
    for undetermined in (6, 7, 8, 9, None):
        assert found[(undetermined, "und")] == 0.0
    assert (4, "de") in found and (1, "en") in found
    nothing = language_id.fit(fx.documents(spark, []))
    assert {r.lang_pred for r in language_id.predict(fx.documents(spark), nothing).collect()} == {"und"}


def test_language_score_matches_plain_counting(spark):
    docs = fx.documents(spark).filter("lang IS NOT NULL AND text IS NOT NULL")
    model = language_id.fit(docs)
    totals = {}
    for text, lang in docs.select("text", "lang").collect():
        counts = totals.setdefault(lang, np.zeros(1 << model.bits))
        for bucket in language_id.gram_buckets(text, model.orders, model.bits):
            counts[bucket] += 1
    assert model.languages == sorted(totals)
    for column, lang in enumerate(model.languages):
        cells = totals[lang] + 0.5
        assert np.allclose(model.log_likelihood[:, column], np.log(cells / cells.sum()))


def test_simhash_matches_all_pairs(spark):
    rows = fx.awkward_rows()
    prints = [fx.simhash(r[1]) for r in rows]
    want = sorted(
        ((r[0], bits - (1 << 64) if bits >> 63 else bits, c[0]) for r, bits, c in
         zip(rows, prints, fx.components(prints, [r[0] for r in rows]), strict=True)), key=repr
    )
    found = simhash.near_duplicates(fx.documents(spark))
    assert fx.rows_of(found, "doc_id", "bits", "component_id") == want


def test_simhash_keeps_one_row_per_group(spark):
    rows = fx.awkward_rows()
    prints = [fx.simhash(r[1]) for r in rows]
    groups = {c[1] for c in fx.components(prints, [r[0] for r in rows])}
    kept = simhash.keep_one(fx.documents(spark)).collect()
    assert len(kept) == len(groups)
    assert {r.doc_id for r in kept} >= {1, 4, 6, 10, 13, 14}
    assert not {r.doc_id for r in kept} & {2, 7, 8}


@pytest.mark.parametrize("bands, hot", [(simhash.THREE_BANDS, 20_000), (simhash.TWO_BANDS, 20_000), (simhash.THREE_BANDS, 1)])
def test_covering_loses_no_link(spark, monkeypatch, bands, hot):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    rng = np.random.default_rng(5)
    points = {int(v) for v in rng.integers(0, 2**63, 60, dtype=np.uint64)}
    for start in list(points)[:25]:
        for _ in range(8):
            for place in rng.choice(64, rng.integers(1, 6), replace=False):
                start ^= 1 << int(place)
            points.add(start)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(s,) for s in signed + signed[:9]], "bits long")
    label = {r.node: r.label for r in components.components(simhash.links(frame, bands)).collect()}
    groups = {}
    for s, (_, first) in zip(signed, fx.components(points, signed), strict=True):
        groups.setdefault(first, set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(8, 40)] + [(8, 7), (7, 7)]
    frame = spark.createDataFrame([*chain, *chain, *star, (None, 3), (500, 500)], "u long, v long")
    found = {r.node: r.label for r in components.components(frame).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in range(7, 40)} == {7}
    assert found[500] == 500 and 3 not in found


def test_repeats_match_brute_force(spark, monkeypatch):
    rows = [r for r in fx.awkward_rows() if r[0] != 10]
    want = sorted(((r[0], *w) for r, w in zip(rows, fx.repeats([(r[0], r[1]) for r in rows]), strict=True)), key=repr)
    found = suffix_dedup.remove_repeats(fx.documents(spark, rows))
    assert fx.rows_of(found, *found.columns) == want
    # Few, small groups and buckets: the same result through other messages.
    monkeypatch.setattr(suffix_dedup, "LEAST_PARTS", 2)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 200)
    assert fx.rows_of(suffix_dedup.remove_repeats(fx.documents(spark, rows)), *found.columns) == want


def test_repeats_of_random_small_alphabets_match_brute_force(spark):
    rng = np.random.default_rng(3)
    pieces = ["".join(rng.choice(list("abé \n"), int(rng.integers(5, 90)))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = "".join(pieces[int(j)] for j in rng.integers(0, 12, int(rng.integers(0, 6))))
        if i % 3 == 0:
            text = "ab" * int(rng.integers(10, 60)) + text
        rows.append((int(rng.integers(0, 50)), text, "en", "a", len(text)))
    want = sorted(((r[0], *w) for r, w in zip(rows, fx.repeats([(r[0], r[1]) for r in rows]), strict=True)), key=repr)
    found = suffix_dedup.remove_repeats(fx.documents(spark, rows))
    assert fx.rows_of(found, *found.columns) == want


def test_strings_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BASE", np.uint64(0))  # every string hashes alike
    rows = np.zeros((3, suffix_dedup.CONTEXT), dtype=np.uint8)
    rows[1, 5], rows[2, 60] = 1, 2
    full = np.full(3, suffix_dedup.SIDE, dtype=np.uint8)
    low, high = suffix_dedup.repeated_strings(rows, full, full, np.ones(3, np.uint64), np.array([1, 2, 3]))
    assert (low[1], high[1]) == (0, 24)  # strings that begin behind byte 5
    assert (low[2], high[2]) == (20, 30)  # strings that end before byte 60
    assert low[0] > high[0]


def test_multikey_quicksort_orders_and_keeps_ties():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    order = suffix_dedup.multikey_quicksort(keys)
    assert order.tolist() == sorted(range(500), key=lambda i: (*(int(k[i]) for k in keys), i))


def test_kept_text_is_valid_and_keeps_whole_characters(spark):
    shared = "ü" * 60
    rows = [(1, shared, "de", "a", 60), (2, "x" + shared + "y", "de", "a", 62), (3, None, "de", "a", None)]
    found = suffix_dedup.remove_repeats(fx.documents(spark, rows), with_text=True, carry=("lang",))
    got = {r.doc_id: (r.kept_text, r.carry_lang) for r in found.collect()}
    assert got == {1: (shared, "de"), 2: ("xy", "de"), 3: ("", "de")}


@pytest.mark.parametrize("most", [100_000, 0])
def test_mixing_meets_targets_and_limits(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    docs = fx.documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets.values()) - total) < 1e-6
    for source, (size, target) in targets.items():
        taken = sum(r.taken for r in rows if r.source == source)
        assert taken == round(target) and target <= 3 * size + 1e-9
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert fx.rows_of(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken") == sorted(
        ((r.doc_id, r["size"], r.taken) for r in rows), key=repr
    )
    mixed = mixing.mixed_documents(docs, mixing.mix(docs)).collect()
    # Texts stay whole, so each source comes within half of its boundary document.
    words = lambda found, source: sum(len(fx.WORD.findall(m.text or "")) for m in found if m.source == source)
    given = docs.collect()
    for source in targets:
        largest = max(len(fx.WORD.findall(d.text or "")) for d in given if d.source == source)
        assert abs(words(mixed, source) - sum(r.taken for r in rows if r.source == source)) <= largest / 2
    assert {(m.doc_id, m.text) for m in mixed} <= {(d.doc_id, d.text) for d in given}


def test_water_filling_clamps_in_rounds(spark):
    sizes = {"a": 1, "b": 2, "c": 100, "d": 3, "e": 400}
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate(sizes.items())]
    found = {r.source: r.target for r in mixing.mix(fx.documents(spark, rows)).collect()}
    weight = dict(zip(sorted(sizes), [1, 2, 3, 1, 2], strict=True))
    fixed = {}
    while True:
        level = (506 - sum(fixed.values())) / sum(w for s, w in weight.items() if s not in fixed)
        above = {s: 3 * sizes[s] for s in weight if s not in fixed and weight[s] * level > 3 * sizes[s]}
        if not above:
            break
        fixed.update(above)
    assert found == {s: pytest.approx(fixed.get(s, weight[s] * level)) for s in weight}


def test_packing_is_complete_and_tight(spark):
    docs = fx.documents(spark)
    pieces = packing.pack(docs, with_text=True, capacity=500).collect()
    sizes = {}
    for p in pieces:
        assert len(fx.WORD.findall(p.text or "")) == p.n_words <= 500
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.n_words
    assert sizes[10] == 12_000 and sizes[6] == 0 and sizes[13] == 126
    joined = " ".join(p.text for p in sorted((p for p in pieces if p.doc_id == 10), key=lambda p: p.piece))
    assert joined == next(r[1] for r in fx.awkward_rows() if r[0] == 10)


def test_bins_pick_the_tightest_compatible_bin():
    rng = np.random.default_rng(2)
    bins, plain = packing.Bins(50), []
    for _ in range(800):
        size, bits = int(rng.integers(0, 30)), 1 << int(rng.integers(0, 6)) | 1 << int(rng.integers(6, 12))
        fits = [b for b in plain if b[0] >= size and not b[1] & bits]
        want = min((b[0] for b in fits), default=50)
        found = bins.place(size, bits)
        if found == len(plain):
            assert not fits
            plain.append([50, 0])
        else:
            assert plain[found][0] == want and not plain[found][1] & bits
        plain[found][0] -= size
        plain[found][1] |= bits


def test_quality_measures_match_plain_python(spark):
    def plain(text):
        text = text or ""
        words = fx.WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if fx.WORD.search(x)]
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                len(lines) - len(set(lines)), len(covered))

    rows = [r for r in fx.awkward_rows() if r[0] != 10]
    rows += [(90, "a b c d e a b c d e f\nx\nx\n \n \nx", "en", "a", 0), (91, "#a $b\r\n|c|", "en", "a", 0)]
    want = sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    found = quality_rules.ledger(fx.documents(spark, rows))
    assert fx.rows_of(found, "doc_id", *quality_rules.MEASURES[:5]) == want


def test_ablation_counts_match_judging_again(spark):
    found = quality_rules.ledger(fx.documents(spark)).cache()
    rows = quality_rules.POLICIES["v2"]
    kept = quality_rules.judge(found, "v2").filter("kept").count()
    for r in quality_rules.ablation(found, "v2").collect():
        without = tuple(x for x in rows if x != r.rule)
        assert quality_rules.judge(found, without).filter("kept").count() == kept + r.only
        assert found.filter(F.col("failed").bitwiseAND(F.lit(quality_rules.bit(r.rule))) != 0).count() == r.fails
    assert quality_rules.ablation(found.limit(0), "v2").filter("fails > 0 OR only > 0").isEmpty()


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    for doc_id, n_bytes, n_tokens, _ in token_counts.count_tokens(
        fx.documents(spark).filter("doc_id <> 13"), VOCABULARY
    ).collect():
        text = next(r[1] for r in fx.awkward_rows() if r[0] == doc_id) or ""
        assert (n_bytes, n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids))


def test_overlapping_chunks_match_whole_encoding():
    definition = open(VOCABULARY, encoding="utf-8").read()
    counter = token_counts.PieceCounter(definition, huge=120, chunk=60, overlap=6)
    whole = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    rng = np.random.default_rng(4)
    letters = [*" \n\t 　ab'sé9!漢😀\x1c\x85", "  ", " a", "'re", "<|endoftext|>", "x" * 90, "!\x1c"]
    for _ in range(400):
        text = "".join(rng.choice(letters, int(rng.integers(0, 300))))
        assert counter.count(text) == whole(text), repr(text)
    assert counter.stats["joined"] and counter.stats["widened"]
    assert not token_counts.splits_at_white_space(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_quality_scores_of_texts_without_words(spark):
    found = {r.doc_id: r for r in classify(fx.documents(spark)).collect()}
    assert found[6].score == found[7].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    constant = quality_classifier.train([], [])
    assert quality_classifier.probability(constant, "any text") == pytest.approx(0.5)
    one_sided = quality_classifier.train(["good"], [1])
    assert quality_classifier.probability(one_sided, "any text") > 0.99


def test_applied_classifier_equals_softmax_of_the_mean():
    texts = ["good text here", "good words again", "bad bad bad", "bad ### ###"] * 3
    model = quality_classifier.train(texts, [1, 1, 0, 0] * 3, epochs=30)
    assert [quality_classifier.probability(model, t) >= 0.5 for t in texts[:4]] == [True, True, False, False]
    found = quality_classifier.buckets("good text", model.bits)
    raw = model.bias + model.weights[found].mean(dtype=np.float64)
    assert quality_classifier.probability(model, "good text") == pytest.approx(1 / (1 + np.exp(-raw)))


URLS = [
    (1, "https://a.example.com/en/5?x=1"), (2, "http://EXAMPLE.com/en/71#t"), (3, "http://example.net/de/8"),
    (4, "http://notexample.net/de/81"), (5, "https://x.org/es/"), (6, "https://org/es/1"), (7, None), (8, "no scheme/en/"),
    (9, "http://"), (10, "ftp://host?q=/en/"), (11, "http://forg/es/"), (1, "https://a.example.com/en/5?x=1"),
    (None, "http://b.net/de/9"), (12, "http://h.org/" + "long/" * 3000), (13, "http://q.com/fr/1"),
]


def _rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in url_filter.RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def test_url_rules_and_model_match_brute_force(spark):

    pages = spark.createDataFrame([(i, u, "<html>") for i, u in URLS], "page_id long, url string, html string")
    labelled = url_filter.labelled_by_rules(pages)
    assert fx.rows_of(labelled, "url", "label") == sorted(
        ((u, int(_rule(u)[2][1] == "block")) for _, u in URLS if _rule(u)[2]), key=repr
    )
    host, path = url_filter.host_and_path("url")
    features = labelled.select("label", host.alias("host"), path.alias("path")).select("label", url_filter.grams()).collect()
    x = np.zeros((len(features), 1 << url_filter.BITS))
    for i, row in enumerate(features):
        x[i, row[1]] = 1 / np.sqrt(len(row[1]))
    y = np.array([r[0] for r in features], dtype=float)
    w, v, b, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for _ in range(30):
        ahead, bias = w + 0.9 * v, b + 0.9 * vb
        error = 1 / (1 + np.exp(-(x @ ahead + bias))) - y
        v = 0.9 * v - 3.0 * (x.T @ error / len(y) + 1e-4 * ahead)
        vb = 0.9 * vb - 3.0 * error.mean()
        w, b = w + v, b + vb
    model = url_filter.fit(labelled)
    assert np.allclose(model.weights, w, atol=1e-6) and model.bias == pytest.approx(b, abs=1e-6)
    for r in url_filter.judge(pages.withColumn("host", F.lit("clash")).withColumn("buckets", F.lit(1)), model).collect():
        url = next(u for i, u in URLS if i == r.page_id)
        want_host, want_path, rule = _rule(url)
        assert (r.host, r.path, r.rule) == (want_host, want_path, rule[0] if rule else None)
        assert r.verdict == (rule[1] if rule else "block" if r.score >= 0.5 else "allow")
    empty = pages.limit(0)
    constant = url_filter.fit(url_filter.labelled_by_rules(empty))
    assert url_filter.judge(empty, constant).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, constant).filter("rule IS NULL").collect()} == {"allow"}


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.02 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(80)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8),
             (404, []), (405, [1.0] * 3), (None, [1.0] * 8), (50, [0.25] * 8), (300, [0.5] * 8)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()),
                                                      T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    usable = []
    for i, v in frame.collect():
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(256 * float(x))) for x in v]
            usable.append((i, q + [0] * (8 - len(q))))
    queries = {}
    for i, q in usable:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, q), q)
    want = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in usable if j != i)
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:5], 1)]
    monkeypatch.setattr(topk, "LEAST_SHARDS", 3)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    found = topk.top_k(frame.withColumn("score", F.lit("clash")).withColumn("shard", F.lit("clash")),
                       frame.filter("vec_id % 50 = 0"))
    assert fx.rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(frame.limit(0), frame.limit(0)).collect() == []


def test_cover_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 6)) * 400
    data = np.rint(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)) * 8).astype(np.int64)
    queries = data[::97]
    search = topk.Search(np.full(len(queries), -1), queries, np.arange(4000), data, 5)
    search.run()
    plain = np.sort(queries @ data.T, axis=1)[:, ::-1][:, :5]
    assert (search.scores == plain).all()
    assert search.visited < 0.6 * len(queries) * len(data)
    tree = topk.CoverTree(data.astype(float))
    for node, rows in enumerate(tree.rows):
        assert tree._distances(rows, tree.centre[node]).max() <= tree.radius[node]
        if tree.children[node]:
            assert sorted(np.concatenate([tree.rows[c] for c in tree.children[node]])) == sorted(rows)


@pytest.mark.parametrize("text", ["Zm9vYmFy+/" * 200_000, "ab " + "x1" * 900_000 + " cd " + "y" * 200_000, "a\u3000" * 50_000])
def test_long_runs_without_white_space_take_time_in_proportion(text):
    import time

    from tokenizers import Tokenizer

    definition = open(VOCABULARY, encoding="utf-8").read()
    plain = Tokenizer.from_str(definition)
    start = time.perf_counter()
    want = len(plain.encode(text, add_special_tokens=False).ids)
    once = time.perf_counter() - start
    start = time.perf_counter()
    assert token_counts.PieceCounter(definition).count(text) == want
    assert time.perf_counter() - start < 3 * once + 3


def test_runs_between_edges_count_like_the_library():
    import random

    from tokenizers import Tokenizer

    definition = open(VOCABULARY, encoding="utf-8").read()
    plain, rng = Tokenizer.from_str(definition), random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice([" ", "  ", "\n", "é", "ab", "x9", "'s", "--"]) if rng.random() < 0.15 else "q" for _ in range(rng.randint(1, 300)))
        counter = token_counts.PieceCounter(definition, huge=20, chunk=16, overlap=4)
        assert counter.count(text) == len(plain.encode(text, add_special_tokens=False).ids)
