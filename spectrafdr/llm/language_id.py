"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit``      counts n-grams per language in every task, sums them by a shuffle and
             returns the (language x bucket) log-probability matrix
``predict``  scores whole texts with the broadcast matrix, one sparse count vector per text

The matrix is the only thing that reaches the driver: at most ``max_languages`` x
``2 ** bits`` numbers, whatever the corpus size.

Cases: a null text and a text without a letter give ``und`` with score 0; null ids are
scored like others but never learned from; rows repeat as often as they come in; an
empty table, or one without labels, gives ``und`` for every row. Only the id, text and
language columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafdr.operators.scale import materialise

UNDETERMINED = "und"
# Odd multipliers of the rolling n-gram hash (golden-ratio family), one per n-gram order.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages in code-point order, log priors, (bucket x language) log likelihoods."""

    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray
    orders: int
    bits: int


def gram_buckets(text: str, orders: int, bits: int) -> np.ndarray:
    """Buckets of all character n-grams of orders 1 to ``orders`` of the lower-cased text."""
    points = np.frombuffer(
        text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32
    )
    shift = np.uint32(32 - bits)
    rolling = np.zeros(len(points), dtype=np.uint32)
    out = []
    for order in range(min(orders, len(points))):
        last = points[order:]
        rolling = rolling[: len(last)] * np.uint32(0x01000193) + last + np.uint32(order + 1)
        mixed = rolling * _MIX[order]
        mixed ^= mixed >> np.uint32(15)
        out.append((mixed * np.uint32(0x2C1B3C6D)) >> shift)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def fit(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    orders: int = 3,
    bits: int = 14,
    smoothing: float = 0.5,
    max_languages: int = 256,
) -> LanguageModel:
    """Learn from all rows of ``docs`` with a text and a language.

    ``max_languages`` bounds the matrix; more languages raise a ``ValueError``, none is left out.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(language).alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    counts = rows.mapInArrow(_counter(orders, bits), "lang string, bucket int, n long")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Bucket -1 carries the number of rows, so priors come from the same pass.
    summed = materialise(summed)
    n_languages = summed.filter("bucket = -1").count()
    if n_languages > max_languages:
        raise ValueError(f"{n_languages} languages, but max_languages is {max_languages}; none may be left out")
    return _model(summed.toArrow(), orders, bits, smoothing)


def _counter(orders: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts, languages = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                name = languages[i].as_py()
                if name not in totals:
                    totals[name] = np.zeros(1 << bits, dtype=np.int64)
                    seen[name] = 0
                ids = gram_buckets(texts[i].as_py(), orders, bits)
                totals[name] += np.bincount(ids, minlength=1 << bits)
                seen[name] += 1
        for name, cells in totals.items():
            used = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(used) + 1), pa.string()),
                    pa.array(np.append(used, -1).astype(np.int32)),
                    pa.array(np.append(cells[used], seen[name])),
                ],
                ["lang", "bucket", "n"],
            )

    return count


def _model(found: pa.Table, orders: int, bits: int, smoothing: float) -> LanguageModel:
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    buckets = np.asarray(found.column("bucket"))
    numbers = np.asarray(found.column("n"))
    rows = {n: int(c) for n, c in zip(names[buckets < 0], numbers[buckets < 0], strict=True)}
    languages = sorted(rows)
    cells = np.zeros((1 << bits, len(languages)))
    for column, name in enumerate(languages):
        own = (names == name) & (buckets >= 0)
        cells[buckets[own], column] = numbers[own]
    likelihood = np.log((cells + smoothing) / (cells.sum(axis=0) + smoothing * (1 << bits)))
    prior = np.log(np.array([rows[n] for n in languages], dtype=float) / max(1, sum(rows.values())))
    return LanguageModel(languages, prior, likelihood, orders, bits)


def score_text(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Most probable language of a whole text and its posterior probability."""
    if text is None or not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    counts = np.bincount(gram_buckets(text, model.orders, model.bits), minlength=1 << model.bits)
    used = np.flatnonzero(counts)
    log_odds = model.log_prior + counts[used] @ model.log_likelihood[used]
    best = int(np.argmax(log_odds))
    return model.languages[best], float(1.0 / np.exp(log_odds - log_odds[best]).sum())


def predict(
    docs: DataFrame, model: LanguageModel, doc_id: str | Column = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; only id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain data: no class to import there
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = docs.select(key.alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(shared), f"doc_id {id_type}, lang_pred string, score double")


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(**shared.value)
        for batch in batches:
            texts = batch.column(1)
            found = [score_text(model, texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    return score


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text",
                    least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language with a posterior of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(**shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = [score_text(own, texts[i].as_py()) for i in range(batch.num_rows)]
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
