"""Personal data: proposed by patterns, confirmed by checksums, weighed by nearby words.

Patterns propose spans of each kind, a validator confirms or rejects them, and words just
before (and, for some kinds, around) a span raise or lower its score:

======= ================================================= ==========================
kind    proposal                                          confirmed by
======= ================================================= ==========================
email   local part, ``@``, dotted domain                  -
ip      four dotted numbers                               every number at most 255
card    digits with single blanks or hyphens between      12 to 19 digits, Luhn
phone   ``+``, digits, blanks, brackets, dots, hyphens    9 to 15 digits
iban    country, two check digits, groups of 4            length, mod-97
ssn     3-2-4 digits                                      issued ranges, context words
tel     national numbers of 10 digits with separators     context words
======= ================================================= ==========================

The first four are the base kinds: leftmost, non-overlapping per kind, rejected matches are
dropped and not tried again. A base span stays whatever its score; spans of the other kinds
need a score of ``threshold``. Offsets count code points of the whole text, end exclusive.

All patterns take time linear in the text: a pattern that cannot match within a run of
characters consumes the run, so no run is read from each of its places.

Cases: null and empty texts have no spans; ids may be null and rows may repeat; an empty
table gives an empty result; of the input only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "tel")
THRESHOLD = 0.5
CONTEXT_CHARS = 48
HELPS, HARMS = 0.3, -0.3

# The second alternative consumes a run in which no match can start.
_EMAIL = re.compile(r"([A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)|[A-Za-z0-9._%+-]++")
_IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORDS = re.compile(r"[^\W\d_]+")

# Words that speak for or against a kind when they stand just before a span.
FOR = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "login", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "call", "mobile", "cell", "fax", "telefon", "whatsapp"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
    "tel": {"phone", "tel", "call", "mobile", "cell", "fax", "telefon", "whatsapp"},
}
AGAINST = {
    "ip": {"version", "release", "section", "chapter", "firmware"},
    "card": {"isbn", "order", "invoice", "serial", "tracking", "sku"},
    "ssn": {"part", "order", "model", "serial"},
    "tel": {"order", "model", "serial", "isbn", "part"},
}
# What pattern and validator alone are worth.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.3}
# Lengths of IBANs are 15 to 34 characters (ISO 13616).
_IBAN_LENGTHS = range(15, 35)


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number in capitals and digits, without blanks, leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _ip_in_range(found: str) -> bool:
    return all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in found.split(".")))


def _card_valid(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "") if len(found) <= 37 else ""
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone_valid(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def _ssn_issued(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest valid account number that starts here and ends with a word, if any."""
    while end > start:
        account = text[start:end].replace(" ", "")
        if len(account) not in _IBAN_LENGTHS:
            return None
        if mod_97(account):
            return end
        end = text.rfind(" ", start, end)
    return None


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, by kind and place."""
    if "@" in text:
        yield from (("email", *m.span()) for m in _EMAIL.finditer(text) if m[1])
    if "." in text:
        yield from (("ip", *m.span()) for m in _IP.finditer(text) if m[1] and _ip_in_range(m[1]))
    yield from (("card", *m.span()) for m in _CARD.finditer(text) if _card_valid(m[0]))
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text) if _phone_valid(m[0]))
    for m in _IBAN.finditer(text):
        end = _iban_end(text, *m.span())
        if end is not None:
            yield "iban", m.start(), end
    if "-" in text:
        yield from (("ssn", *m.span()) for m in _SSN.finditer(text) if _ssn_issued(m[0]))
    if "-" in text or "." in text:
        yield from (("tel", *m.span()) for m in _TEL.finditer(text))


def score(text: str, kind: str, start: int) -> float:
    """What a confirmed span is worth with the words before it, from 0 to 1."""
    words = {w.lower() for w in _WORDS.findall(text, max(0, start - CONTEXT_CHARS), start)}
    helps = HELPS if words & FOR[kind] else 0.0
    harms = HARMS if words & AGAINST.get(kind, set()) else 0.0
    return round(min(1.0, max(0.0, START[kind] + helps + harms)), 2)


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """``kind, start, end, score`` of one text by start, then kind in the order of ``KINDS``.

    Base kinds stay whatever their score; the others need ``threshold`` and no base span over them.
    """
    found = [(k, a, b, score(text, k, a)) for k, a, b in _proposed(text or "")]
    base = sorted((a, b) for k, a, b, _ in found if k in BASE_KINDS)
    kept = [s for s in found if s[0] in BASE_KINDS]
    others = sorted((s for s in found if s[0] not in BASE_KINDS and s[3] >= threshold), key=lambda s: s[1])
    at = 0
    for one in others:
        while at < len(base) and base[at][1] <= one[1]:
            at += 1
        if at == len(base) or base[at][0] >= one[2]:
            kept.append(one)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans`` for every row; a span is ``kind, start, end, score``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            found = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t, threshold)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["doc_id", "spans"])

    return rows.mapInArrow(
        run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    )


def base_only(found: str | Column) -> Column:
    """The spans of the base kinds."""
    return F.filter(found, lambda s: s["kind"].isin(*BASE_KINDS))


def count_of(found: str | Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def listed(found: str | Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    column = F.col(found) if isinstance(found, str) else found
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, found: str) -> Column:
    """A text with every span replaced by its kind in angle brackets; overlapping ones once."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def step(state, s):
        gap = F.substring(whole, state["at"] + 1, s["start"] - state["at"])
        apart = s["start"] >= state["at"]
        out = F.when(apart, F.concat(state["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        found, first, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole).cast("long")))
    )
