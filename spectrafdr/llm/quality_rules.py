"""Quality rules as a bitmask ledger.

``ledger``    measures every whole text once, evaluates every rule once and stores the
              measurements and one failure bit per rule
``judge``     applies a versioned policy - a set of rules - to stored bits
``ablation``  per rule of a policy: rows it fails, and rows only it fails

Judging and ablating read the ledger alone, through bitwise expressions and map-side
combined sums, so a new policy never reads a text again.

Cases: a null text counts as a text without words; a blank one too; both fail ``few_words``;
ids may be null and repeat, rows repeat as they come in; an empty table gives an empty
ledger and zero counts. Only id, text and the columns named in ``carry`` are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import text_slices

# Symbols that count, and the characters that separate words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_lower"]
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))

# Rules in bit order, over measurements; each names its condition of failure.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "5 * n_symbols > 2 * n_words",
    "repeated_lines": "n_dup_lines > 3 AND 10 * n_dup_lines > 6 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 30 * n_words",
    "capitals": "n_upper > n_lower",
}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v2": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str | tuple[str, ...]) -> int:
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(bit(r) for r in rules)


def repeated_words(words: list) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more, first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, itertools.count()), dtype=np.int64, count=len(words))
    if len(first) == len(words):
        return 0
    # Equal windows have equal sums, so without equal sums nothing repeats.
    factor = np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        sums = sums * factor + ids[i : i + n].view(np.uint64)
    _, inverse, counts = np.unique(sums, return_inverse=True, return_counts=True)
    suspects = np.flatnonzero(counts[inverse] > 1)
    if not len(suspects):
        return 0
    windows = np.stack([ids[suspects + i] for i in range(WINDOW)], axis=1)
    _, exact, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = suspects[times[exact.ravel()] > 1]
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


def measure(text: str | None) -> list[int]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    with_words = [line for line in lines if line.strip(BLANKS)]
    return [
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(with_words) - len(set(with_words)),
        repeated_words(words),
        len(with_words),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LOWER)),
    ]


def failures() -> Column:
    """One bit per rule, from measurement columns."""
    bits = [F.when(F.expr(condition), F.lit(bit(rule))).otherwise(0) for rule, condition in RULES.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the measurements, ``failed`` and columns ``carry_<name>`` of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            found = np.array([measure(t) for t in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in found.reshape(-1, len(MEASURES)).T],
                 *batch.columns[2:]],
                ["doc_id", *MEASURES, *batch.schema.names[2:]],
            )

    fields = [("doc_id", rows.schema["doc_id"]), *[(f"carry_{c}", rows.schema[f"carry_{c}"]) for c in carry]]
    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in fields]
    schema = ", ".join([kinds[0], *[f"{m} long" for m in MEASURES], *kinds[1:]])
    return rows.mapInArrow(run, schema).withColumn("failed", failures())


def fails(policy: str | tuple[str, ...]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) != 0


def judge(found: DataFrame, policy: str | tuple[str, ...], name: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy failed."""
    return found.withColumn(name, ~fails(policy))


def ablation(found: DataFrame, policy: str = "v2", by: list[str] | None = None) -> DataFrame:
    """Per rule: rows that fail it, and rows the policy would keep without it.

    One aggregation over the bits, per group of ``by`` columns if given; ``union`` and
    ``common`` are the bits that some and that all rows of the group fail.
    """
    inside = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    counts = [
        F.count_if(inside.bitwiseAND(F.lit(bit(r))) != 0).alias(f"fails_{r}") for r in POLICIES[policy]
    ] + [F.count_if(inside == bit(r)).alias(f"only_{r}") for r in POLICIES[policy]]
    summed = found.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.bit_or(inside).alias("union"), F.bit_and(inside).alias("common"), *counts
    )
    per_rule = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("fails"), F.col(f"only_{r}").alias("only"))
                for r in POLICIES[policy]
            ]
        )
    )
    return summed.select(*(by or []), "rows", "union", "common", per_rule.alias("r")).select(
        *(by or []), "rows", "union", "common", "r.*"
    )
