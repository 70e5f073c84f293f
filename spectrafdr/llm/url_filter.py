"""URL filters: host-and-path rules first, else logistic regression on hashed n-grams.

Everything is DataFrame and SQL functions. A URL becomes an array of hashed character
n-grams of its host and its path; the model is one weight per bucket. Training is full-batch
gradient descent with momentum on a small labelled table: each step is one aggregation to at
most ``2 ** BITS`` gradient sums, and the weights return as a constant array of the next
plan. Scoring is one projection without a shuffle.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
the verdict of the bias; empty tables give empty results; without labels of both kinds the
model is the constant share of blocked rows (0 without rows); repeated rows and null ids
come through as they are; only id and url are read. A labelled row whose URL or label is
null is not learned from.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafdr.operators.scale import materialise

BITS = 12
ORDERS = (3, 4)
LABELLED_ROWS = 2000
ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The rules of the query.
RULES: list[tuple[str, str]] = [
    ("com/en/", BLOCK),
    ("example.com/en/7", ALLOW),
    ("net/de/", ALLOW),
    ("example.net/de/8", BLOCK),
    ("org/es/", BLOCK),
]


@dataclass(frozen=True)
class UrlModel:
    """Weights of the buckets and the bias; positive sums speak for blocking."""

    bias: float = 0.0
    weights: list[float] = field(default_factory=lambda: [0.0] * (1 << BITS))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, empty where there is none."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((F.col(host) == own) | F.endswith(F.col(host), F.lit("." + own))) & F.startswith(
            F.col(path), F.lit(slash + rest)
        )
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _grams_of(part: str, text: Column, order: int, bits: int) -> Column:
    places = F.when(
        F.length(text) >= order, F.sequence(F.lit(1), F.length(text) - (order - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.pmod(
            F.xxhash64(F.lit(part), F.substring(text, i, F.lit(order))), F.lit(1 << bits)
        ).cast("int"),
    )


def grams(host: str = "host", path: str = "path", bits: int = BITS) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked by its part."""
    found = []
    for part, column in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), F.col(column), F.lit("$"))
        found += [_grams_of(part, text, order, bits) for order in ORDERS]
    return F.array_distinct(F.concat(*found))


def _constant(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def raw_score(model: UrlModel, buckets: str = "buckets") -> Column:
    """Log odds of blocking: the weights of a URL's buckets over the root of their number."""
    weights = _constant(model.weights)
    total = F.aggregate(buckets, F.lit(0.0), lambda sum_, i: sum_ + F.get(weights, i))
    return F.lit(model.bias) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", steps: int = 30, rate: float = 3.0,
        momentum: float = 0.9, decay: float = 1e-4, limit: int = LABELLED_ROWS) -> UrlModel:
    """Learn from at most ``limit`` rows of ``labelled``, taken in the order of a hash of the URL.

    ``label`` is 1 for blocked and 0 for allowed. Rows have unit length, so a fixed rate is safe.
    """
    host, path = host_and_path(url)
    rows = materialise(
        labelled.filter(F.col(url).isNotNull() & F.col(label).isin(0, 1))
        .orderBy(F.xxhash64(url), url, label)
        .limit(limit)
        .select(F.col(label).cast("double").alias("y"), host.alias("host"), path.alias("path"))
        .select("y", grams().alias("buckets"))
    )
    n, blocked = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or blocked in (0, n):
        share = min(max((blocked or 0) / n, 1e-6), 1 - 1e-6) if n else 1e-6
        return UrlModel(math.log(share / (1 - share)))
    size = 1 << BITS
    weights, speed = [0.0] * size, [0.0] * size
    bias = bias_speed = 0.0
    for _ in range(steps):
        ahead = UrlModel(bias + momentum * bias_speed, [w + momentum * s for w, s in zip(weights, speed, strict=True)])
        error = F.lit(1.0) / (1.0 + F.exp(-raw_score(ahead))) - F.col("y")
        # Bucket -1 carries the bias.
        parts = rows.select(
            error.alias("e"), F.sqrt(F.greatest(F.size("buckets"), F.lit(1))).alias("norm"), "buckets"
        ).select("e", "norm", F.explode(F.array_append("buckets", F.lit(-1))).alias("bucket"))
        sums = parts.groupBy("bucket").agg(
            F.sum(F.when(F.col("bucket") < 0, F.col("e")).otherwise(F.col("e") / F.col("norm"))).alias("g")
        )
        gradient = {r.bucket: round(r.g / n, 12) for r in sums.collect()}
        for i in range(size):
            speed[i] = momentum * speed[i] - rate * (gradient.get(i, 0.0) + decay * ahead.weights[i])
            weights[i] += speed[i]
        bias_speed = momentum * bias_speed - rate * gradient[-1]
        bias += bias_speed
    return UrlModel(bias, [round(w, 9) for w in weights])


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """``url, label`` of the pages that a rule decides."""
    host, path = host_and_path(url)
    parts = pages.select(F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    _, verdict = matched_rule(rules)
    return parts.withColumn("verdict", verdict).filter("verdict IS NOT NULL").select(
        "url", (F.col("verdict") == BLOCK).cast("int").alias("label")
    )


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = RULES,
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; score is the model's probability."""
    host, path = host_and_path(url)
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(rules)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("decided"), grams().alias("buckets"))
    score = F.lit(1.0) / (1.0 + F.exp(-raw_score(model)))
    return scored.withColumn("score", score).select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        "score",
    )
