"""Token alignment against plain counting, on whole tables, in tiny parts and with rare pairs."""

import collections
import hashlib

import fixtures as fx
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spectrafdr.llm import alignment
from spectrafdr.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(libraries, text):
    a, b = libraries
    char = {v: k for k, v in alignment.byte_level_bytes().items()}
    back = {c: k for k, c in char.items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b
    ]
    wanted = (" " + text).encode()
    if b"".join(bytes_a) != wanted or b"".join(bytes_b) != wanted:
        return None
    return ids_a, ids_b, [len(x) for x in bytes_a], [len(x) for x in bytes_b]


def plain(libraries, texts):
    """``(n_a, n_b, n_groups, n_links, n_best, count_sum, sha)`` per text, by walking token by token."""
    walked = []
    for text in texts:
        found = token_bytes(libraries, text) if text else None
        if found is None:
            walked.append(None)
            continue
        ids_a, ids_b, len_a, len_b = found
        i = j = end_a = end_b = 0
        groups, links, own_a, own_b = [], [], [], []
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b:
                own_a.append(ids_a[i])
                end_a += len_a[i]
                i += 1
            else:
                own_b.append(ids_b[j])
                end_b += len_b[j]
                j += 1
            if own_a and own_b:
                links.append((own_a[-1], own_b[-1]))
            if end_a == end_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        walked.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest()))
    count = collections.Counter(link for w in walked if w for link in w[3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if w is None else
        (*w[:3], len(w[3]), sum(count[x] == best[x[1]] for x in w[3]), sum(count[x] for x in w[3]), w[4])
        for w in walked
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_matches_plain_walk(spark, libraries):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: tuple(r[n] for n in NAMES) for r in QUERIES["op12_token_alignment"](spark, folder).collect()}
    assert [found[d.doc_id] for d in docs] == plain(libraries, [d.text for d in docs])


@pytest.mark.parametrize("options", [{}, {"frequent_pairs": 5}, {"frequent_pairs": 0}, {"part_chars": 40},
                                     {"part_chars": 20, "frequent_pairs": 9, "memo": 10}])
def test_awkward_texts_in_parts_and_with_rare_pairs(spark, libraries, options, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_PIECES", options.pop("memo", alignment.MEMO_PIECES))
    rows = fx.awkward_rows()
    rows += [(50, "▁ literal ▁sign", None, None, 0), (51, " two  blanks and\ttab ", None, None, 0), (52, "<s> </s> <unk>", None, None, 0),
             (53, "a\x00b 　 c\r\n", None, None, 0), (54, "ab " * 400, None, None, 0), (55, "a" * 3000, None, None, 0)]
    want = sorted(((r[0], *w) for r, w in zip(rows, plain(libraries, [r[1] for r in rows]), strict=True)), key=repr)
    found = alignment.align(fx.with_clashes(fx.documents(spark, rows)), A, B, **options)
    assert fx.rows_of(found, "doc_id", *NAMES) == want


def test_empty_table_gives_no_rows(spark):
    assert alignment.align(fx.documents(spark, []), A, B).collect() == []
    nulls = alignment.align(fx.documents(spark, [(1, None, None, None, None)]), A, B).collect()
    assert [tuple(r) for r in nulls] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pointers_end_where_both_sides_end():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 400))
        ends = [np.append(np.flatnonzero(rng.random(size - 1) < p) + 1, size) for p in rng.random(2)]
        last_a, last_b = alignment.group_ends(*ends)
        common = np.intersect1d(*ends)
        for own, last in ((ends[0], last_a), (ends[1], last_b)):
            assert (ends[0][last] == common[np.searchsorted(common, own)]).all()


def test_chunks_change_no_encoding(libraries):
    a, b = libraries
    text = " ".join(f"{w}{i}" for i, w in enumerate(["It's", "über", "x,", "(y)", "漢字", "z  z", "<|endoftext|>", "1,000"] * 300))
    aligner = alignment.Aligner(open(A).read(), open(B, "rb").read())
    cut = aligner.parts(text, 50)
    assert len(cut) > 50 and " ".join(cut) == text
    cut = aligner.pieces(text)
    assert len(cut) > 1000 and " ".join(cut) == text
    assert [i for c in cut for i in a.encode(" " + c, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
    assert [i for c in cut for i in b.encode(c)] == b.encode(text)
