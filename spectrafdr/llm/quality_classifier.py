"""Quality classifier: supervised subword embeddings, averaged per document, softmax output.

Every word, every pair of neighbouring words and every run of three and four characters of a
text is hashed to a learned vector; a document is the mean of its vectors; two softmax outputs say how likely each label
is. Vectors and outputs are trained together by stochastic gradient descent in numpy.

``fit``    trains in one task on at most ``per_class`` labelled documents per label, chosen
           by a hash of the id; this bound is a parameter, everything else covers all rows
``score``  scores every whole text

The outputs are linear in the mean, so a trained model is applied as one number per bucket
(``2 ** bits`` of them, broadcast) - the difference of the two outputs of its vector.

Cases: null, empty and blank texts get the score of the bias alone; rows with a null id or a
label other than 0 and 1 are not learned from; without examples of both labels the model is
the constant share of label 1 (0.5 without any); repeated rows are scored each; an empty
table gives an empty result; only id and text are read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import text_slices

BITS = 16
SIZE = 12
ORDERS = (3, 4)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class QualityModel:
    """Per bucket the difference of the two outputs, and the difference of the biases."""

    weights: np.ndarray
    bias: float
    bits: int


def _scramble(values: np.ndarray, bits: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def buckets(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of all words, word pairs and character n-grams of a text, repeats included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    wide = points.astype(np.uint64) + np.uint64(1)
    out = []
    inside = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = inside[::2], inside[1::2]
    if len(starts):
        # A word is the sum of its characters times powers that depend on the place in it.
        spread = np.diff(np.append(starts, len(points)))
        place = np.arange(len(points))
        place[starts[0] :] -= np.repeat(starts, spread)
        powers = _powers(int((ends - starts).max()) + 1)
        values = np.where(blank, np.uint64(0), wide * powers[np.minimum(place, len(powers) - 1)])
        words = np.add.reduceat(values, starts)
        out.append(_scramble(words, bits))
        # A pair is the difference of its words, so every word said twice falls into one bucket.
        out.append(_scramble((words[1:] - words[:-1]) * _ODD + np.uint64(2), bits))
    for order in ORDERS:
        n = len(wide) - order + 1
        if n > 0:
            rolling = np.full(n, np.uint64(order))
            for i in range(order):
                rolling = rolling * _ODD + wide[i : i + n]
            out.append(_scramble(rolling, bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _ODD, dtype=np.uint64))


def train(texts: list[str], labels: list[int], bits: int = BITS, size: int = SIZE, epochs: int = 15,
          rate: float = 3.0, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent over whole documents, one at a time, in seeded order."""
    labels = np.asarray(labels)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        limit = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(1 << bits, np.float32), float(np.log(limit / (1 - limit))), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / size, 1.0 / size, (1 << bits, size)).astype(np.float32)
    outputs, biases = np.zeros((2, size), np.float32), np.zeros(2, np.float32)
    examples = []
    for text in texts:
        used, counts = np.unique(buckets(text, bits), return_counts=True)
        examples.append((used, (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            used, weight = examples[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            rows = vectors[used]
            mean = weight @ rows if len(used) else np.zeros(size, np.float32)
            raw = outputs @ mean + biases
            error = np.exp(raw - raw.max())
            error = error / error.sum()
            error[labels[i]] -= 1
            back = error @ outputs
            outputs -= step * np.outer(error, mean)
            biases -= np.float32(0.02) * step * error
            if len(used):
                vectors[used] = rows - step * np.outer(np.sqrt(weight), back)
    difference = outputs[1] - outputs[0]
    return QualityModel(vectors @ difference, float(biases[1] - biases[0]), bits)


def probability(model: QualityModel, text: str | None) -> float:
    found = buckets(text or "", model.bits)
    raw = model.bias + (float(model.weights[found].mean(dtype=np.float64)) if len(found) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500))))


def fit(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "label", per_class: int = 2000, **training) -> QualityModel:
    """Learn from ``labelled`` (``doc_id``, a 0/1 ``label``) joined to the whole texts of ``docs``.

    At most ``per_class`` rows per label are taken, in the order of a hash of their ids. Only
    they travel: the ids to a join, the texts to one training task, its weights to the driver.
    """
    own = labelled.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(
        "_id IS NOT NULL"
    )
    chosen = [
        own.filter(F.col("_label") == value)
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(per_class)
        for value in (0, 1)
    ]
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    examples = texts.join(F.broadcast(chosen[0].union(chosen[1])), F.col("_doc") == F.col("_id")).select(
        F.lit(0).alias("one"), "_id", "_label", "text"
    )

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by([("_id", "ascending"), ("text", "ascending")])
        model = train(found.column("text").to_pylist(), found.column("_label").to_pylist(), **training)
        return pa.table({"weights": [model.weights.tobytes()], "bias": [model.bias], "bits": [model.bits]},
                        schema=pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("bits", pa.int32())]))

    rows = examples.groupBy("one").applyInArrow(run, "weights binary, bias double, bits int").collect()
    if not rows:
        return train([], [], **training)
    return QualityModel(np.frombuffer(bytes(rows[0].weights), np.float32), rows[0].bias, rows[0].bits)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain data
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(**shared.value)
        for batch in (part for whole in batches for part in text_slices(whole)):
            scores = [probability(own, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
