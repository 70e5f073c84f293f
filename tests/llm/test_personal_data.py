"""Personal data: the base kinds by plain patterns, added kinds, scores and awkward texts."""

import hashlib
import re
import time

import fixtures as fx
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafdr.llm import personal_data as pii
from spectrafdr.llm.queries import QUERIES

# The definitions, taken literally.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m.group())
    ]
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@given(st.text(alphabet="a@.-+0123456789 ()_é", max_size=60))
@settings(max_examples=3000, deadline=None)
def test_base_kinds_match_the_plain_patterns(text):
    assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


@given(st.text(alphabet="4539 -148803436467", max_size=40))
@settings(max_examples=1000, deadline=None)
def test_cards_match_the_plain_pattern(text):
    assert [s[:3] for s in pii.spans(text) if s[0] == "card"] == [s for s in base_spans(text) if s[0] == "card"]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_the_definition(spark, folder):
    at = f"/root/testdata/{folder}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_personal_data"](spark, at).collect()
    assert len(rows) == len(texts)
    n_spans = 0
    for r in rows:
        base = base_spans(texts[r.doc_id])
        n_spans += len(base)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(b[0] == k for b in base) for k in PLAIN]
        assert set(listed.split(",")) <= set(r.spans.split(","))
    assert n_spans > 10


def test_checksums_confirm_and_reject():
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE88370400440532013000")
    kinds = lambda text: [s[0] for s in pii.spans(text)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 please") == []
    assert kinds("999.1.1.1 and 1.2.3.4.5.6.7.8") == ["ip", "ip"]


def test_context_decides_unconfirmed_kinds():
    kinds = lambda text: [s[0] for s in pii.spans(text)]
    assert kinds("her SSN is 219-09-9999.") == ["ssn"]
    assert kinds("part 219-09-9999 in stock") == []
    assert kinds("social security 000-09-9999") == []
    assert kinds("call (415) 555-2671 now") == ["tel"]
    assert kinds("about 415 555-2671 of them") == []
    plain, helped, harmed = (pii.spans(t)[0][3] for t in ("x 1.2.3.4", "server 1.2.3.4", "version 1.2.3.4"))
    assert harmed < plain < helped


def test_awkward_texts(spark):
    rows = pii.find(fx.with_clashes(fx.documents(spark))).collect()
    assert len(rows) == len(fx.awkward_rows())
    assert all(r.spans == [] for r in rows)
    assert pii.find(fx.documents(spark, [])).collect() == []
    assert [pii.spans(t) for t in (None, "", " ")] == [[], [], []]


def test_redaction_replaces_spans(spark):
    text = "é mail a@b.co or +1 (555) 123-4567, card 4539148803436467!"
    docs = fx.documents(spark, [(1, text, None, None, None), (2, None, None, None, None), (3, "none", None, None, None)])
    found = pii.find(docs).join(docs, "doc_id").select("doc_id", pii.redacted("text", "spans").alias("clean"))
    assert {r.doc_id: r.clean for r in found.collect()} == {1: "é mail <email> or <phone>, card <card>!", 2: "", 3: "none"}


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" + " " * 2_000_000, "a@" * 700_000,
                                  "1-" * 1_000_000, "AB12" * 500_000, "a@b." * 500_000, "+1 " * 700_000])
def test_time_grows_with_the_text_only(text):
    start = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - start < 10
