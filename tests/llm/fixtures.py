"""Small documents with every awkward case, and plain Python versions of the definitions."""

import hashlib
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns that operators make themselves, as extra columns of the input.
CLASHING = ["size", "score", "bits", "label", "grp", "key", "content", "slot", "failed", "shard", "_copy", "u", "node",
            "_taken", "_rows", "_id", "_own", "_doc", "_row", "_content", "_label"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
_PROSE = (
    "The quick brown fox jumps over the lazy dog while seven wizards quietly box on a hill "
    "near the old mill where nobody ever goes after dark because of the howling wind"
)
_OTHER = (
    "Der schnelle braune Fuchs springt über den faulen Hund und läuft danach weiter durch den "
    "tiefen Wald bis an den großen See wo die müden Wanderer am Abend ein Feuer machen"
)


def awkward_rows():
    long = " ".join(f"word{i % 977}x{i * 31 % 1009}" for i in range(12_000))
    texts = [
        (1, _PROSE, "en", "a"), (2, _PROSE, "en", "b"), (3, _PROSE.replace("lazy", "idle"), "en", "a"),
        (4, _OTHER, "de", "b"), (5, _OTHER + " Ende.", "de", None), (6, None, "en", "a"),
        (7, "", "en", "c"), (8, "  \n\t ", None, "c"), (9, "12345 !!! 678", None, "a"),
        (10, long, None, "a"), (11, "one two three", "en", None), (12, "héllo wörld ünïcode 漢字 😀 " * 9, None, "d"),
        (13, "aaaa " * 60, "en", "d"), (13, "aaaa " * 60, "en", "d"), (13, "other text with the same id", "en", "d"),
        (None, _PROSE, "en", "a"), (None, None, None, None), (14, "x" * 400, None, "e"),
        (15, "x" * 300 + " " + _OTHER[:80], "de", "e"),
        (16, "see <|endoftext|> and   spaces\r\n\r\n  it's", "en", "a"),
    ]
    return [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in texts]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("clash") for name in CLASHING})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    """Smallest reachable id by flood fill over all pairs."""
    out = [None] * len(prints)
    for i in range(len(prints)):
        if out[i] is not None:
            continue
        group, queue = {i}, [i]
        while queue:
            one = queue.pop()
            for other in range(len(prints)):
                if other not in group and (prints[one] ^ prints[other]).bit_count() <= 4:
                    group.add(other)
                    queue.append(other)
        known = [ids[g] for g in group if ids[g] is not None]
        for g in group:
            out[g] = (min(known) if known else None, min(group))
    return out


def repeats(pairs, length=50):
    """``(n_bytes, n_removed, n_spans, sha256)`` per (id, text), in the order given."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in pairs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w not in first or rank(i) < first[w]:
                first[w] = rank(i)
    out = []
    for i, t in pairs:
        b = (t or "").encode()
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < rank(i):
                keep[p : p + length] = bytes(length)
        kept = bytes(x for x, k in zip(b, keep) if k)
        spans = sum(1 for p in range(len(b)) if not keep[p] and (p == 0 or keep[p - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
