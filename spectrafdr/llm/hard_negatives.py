"""Hard negatives by angular triangle filtering.

Every vector is stored with its norm and its angles to a few reference directions. For an
anchor and a candidate with angles a and b to one reference, the angle between them lies
between ``|a - b|`` and ``min(a + b, 2 pi - a - b)``. The tightest bounds over all references
give an interval of the cosine, which times both norms, widened by more than rounding can
do, bounds the score. Only candidates whose interval meets a window that is still open get
integer scoring.

``Positives``  the k best rows of the anchor's label: one open window, whose lower end rises
               with the k-th score found.
``Negatives``  per positive the k best rows of other labels within
               ``low * score <= 100 * negative <= high * score``: several windows per anchor,
               whose lower ends rise likewise.

The same bounds hold for cells - up to ``CELL`` neighbouring rows with ranges of angles and
norms - and for regions, the rows nearest to one reference: anchors are sent only to
regions that can meet one of their windows.

Placement. Positives: rows are dealt by label; small labels share a group, a label with more
rows than a group holds is dealt over several by row number. Negatives: regions are dealt
over groups by row number. A group holds at most about ``ROWS_PER_GROUP`` rows and
``ANCHORS_PER_GROUP`` anchors, so equal rows and hot labels never gather. References are
chosen farthest-first from ``SAMPLE`` rows (a bounded sample; it moves bounds, not results).

Cases: rows with a null id or label, a null vector, or a null or non-finite component take
no part; shorter vectors count as padded with zeros; a zero vector scores zero; rows that
share the anchor's id are its own and no candidates, an anchor id that repeats counts once
(smallest vector, then label); repeated candidates are listed as often as they come; a
positive with a score below zero has an empty window; empty tables give no rows. Products
are exact below 2^53 as floats and below 2^63 as integers. Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafdr.llm.topk import quantised
from spectrafdr.operators import scale

REFERENCES = 16
SAMPLE = 4096
ROWS_PER_GROUP = 32_768
LEAST_ROWS_PER_GROUP = 512
LEAST_GROUPS = 64
ANCHORS_PER_GROUP = 16_384
ANCHORS_AT_ONCE = 256
CELL = 256
# Angles carry an error of at most about 5e-8 where the cosine is flat.
_SLACK = 1e-6
_LOW = -(1 << 62)
_HIGH = 1 << 62
_NO_ID = np.iinfo(np.int64).max


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer lists as rows of a matrix, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(lists.flatten(), dtype=np.int64)
    return out


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each as far as possible from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        following = int(np.argmin(nearest))
        if nearest[following] > 1 - 1e-9:
            break
        chosen.append(following)
        nearest = np.maximum(nearest, units @ units[following])
    return units[chosen]


def angles_of(points: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every reference; a zero vector gets angles of zero."""
    norms = np.linalg.norm(points.astype(np.float64), axis=1)
    cosines = (points @ references.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1.0, 1.0)), 0.0)


def score_bounds(angles, norms, least, most, short, long):
    """``(lower, upper)`` of the scores of anchors (rows) with boxes of candidates (columns).

    A box has angles from ``least`` to ``most`` per reference and norms from ``short`` to ``long``.
    """
    shape = (len(angles), len(least))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for r in range(angles.shape[1]):
        own = angles[:, r, None]
        np.maximum(near, np.maximum(least[None, :, r] - own, own - most[None, :, r]), out=near)
        high = np.where(own + most[None, :, r] <= np.pi, own + most[None, :, r], np.pi)
        reflected = 2 * np.pi - own - least[None, :, r]
        np.minimum(far, np.where(high < np.pi, high, np.minimum(np.pi, reflected)), out=far)
    top = np.cos(np.maximum(near - _SLACK, 0.0))
    bottom = np.cos(np.minimum(far + _SLACK, np.pi))
    spread = norms[:, None] * long[None, :]
    slack = 1e-9 * spread + 1e-6
    upper = np.where(top >= 0, top * spread, top * norms[:, None] * short[None, :]) + slack
    lower = np.where(bottom <= 0, bottom * spread, bottom * norms[:, None] * short[None, :]) - slack
    return lower, upper


class Candidates:
    """Rows of a group in cells of neighbours, with the boxes of the cells."""

    def __init__(self, ids, labels, points, norms, angles):
        nearest = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(ids), np.int64)
        depth = angles.min(axis=1) if angles.shape[1] else np.zeros(len(ids))
        order = np.lexsort((ids, depth, nearest))
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        self.norms, self.angles = norms[order], angles[order]
        self.floats = self.points.astype(np.float64)
        self.starts = np.arange(0, len(ids), CELL)
        self.least, self.most = (f.reduceat(self.angles, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.short, self.long = (f.reduceat(self.norms, self.starts) for f in (np.minimum, np.maximum))
        self.largest = max(float(np.abs(self.floats).max(initial=0.0)), 1.0)


class Best:
    """The k best candidates per window: scores, and ids with the smaller first among equals."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), _LOW)
        self.ids = np.full((*low.shape, k), _NO_ID)

    def floor(self) -> np.ndarray:
        """What a candidate has to score at least to matter, per anchor and window."""
        return np.maximum(self.low, self.scores[:, :, -1])

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, usable: np.ndarray) -> None:
        """Candidates ``ids`` (columns) with their scores for the anchors ``rows``."""
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[rows, w], self.scores[rows, w, -1])
            hit = usable & (scores >= floor[:, None]) & (scores <= self.high[rows, w, None])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            touched, place = np.unique(i, return_inverse=True)
            whose = np.concatenate([place, np.repeat(np.arange(len(touched)), self.k)])
            value = np.concatenate([scores[i, j], self.scores[rows[touched], w].ravel()])
            name = np.concatenate([ids[j], self.ids[rows[touched], w].ravel()])
            order = np.lexsort((name, -value, whose))
            first = np.searchsorted(whose[order], np.arange(len(touched)))
            best = order[first[:, None] + np.arange(self.k)]
            self.scores[rows[touched], w], self.ids[rows[touched], w] = value[best], name[best]


def search(anchors: Candidates, data: Candidates, best: Best, same_label: bool) -> int:
    """Fill ``best`` for all anchors; the number of scored pairs is returned."""
    exact = anchors.largest * data.largest * max(1, data.points.shape[1]) < float(1 << 53)
    scored = 0
    for at in range(0, len(anchors.ids), ANCHORS_AT_ONCE):
        rows = np.arange(at, min(at + ANCHORS_AT_ONCE, len(anchors.ids)))
        lower, upper = score_bounds(anchors.angles[rows], anchors.norms[rows], data.least, data.most, data.short, data.long)
        for cell in np.argsort(-upper.max(axis=0), kind="stable"):
            here = slice(data.starts[cell], data.starts[cell] + CELL)
            floor, high = best.floor()[rows], best.high[rows]
            met = (upper[:, cell, None] >= floor) & (lower[:, cell, None] <= high) & (floor <= high)
            own = rows[met.any(axis=1)]
            if not len(own):
                continue
            matching = (anchors.labels[own, None] == data.labels[None, here]) == same_label
            usable = matching & (anchors.ids[own, None] != data.ids[None, here])
            low_row, up_row = score_bounds(
                anchors.angles[own], anchors.norms[own], data.angles[here], data.angles[here], data.norms[here], data.norms[here]
            )
            floor, high = best.floor()[own], best.high[own]
            open_window = np.zeros_like(usable)
            for w in range(floor.shape[1]):
                wide = floor[:, w] <= high[:, w]
                open_window |= (up_row >= floor[:, w, None]) & (low_row <= high[:, w, None]) & wide[:, None]
            usable &= open_window
            rest, columns = np.flatnonzero(usable.any(axis=1)), np.flatnonzero(usable.any(axis=0))
            if not len(rest):
                continue
            scored += len(rest) * len(columns)
            if exact:
                scores = (anchors.floats[own[rest]] @ data.floats[here][columns].T).astype(np.int64)
            else:
                scores = anchors.points[own[rest]] @ data.points[here][columns].T
            best.add(own[rest], data.ids[here][columns], scores, usable[np.ix_(rest, columns)])
    return scored


# --- on Spark ----------------------------------------------------------------------------

_STORED = "row long, vec_id long, label long, vector array<long>, norm double, angles array<double>, region int"


def stored_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows with norm, angles and nearest reference."""
    shared = rows.sparkSession.sparkContext.broadcast(references)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            norms, angles = angles_of(matrix(batch.column(3), own.shape[1]), own)
            edges = np.arange(len(norms) + 1, dtype=np.int32) * own.shape[0]
            nearest = angles.argmin(axis=1) if len(own) else np.zeros(len(norms), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norms), pa.ListArray.from_arrays(edges, pa.array(angles.ravel())),
                 pa.array(nearest.astype(np.int32))],
                ["row", "vec_id", "label", "vector", "norm", "angles", "region"],
            )

    return scale.store(numbered.mapInArrow(run, _STORED))


def _group(found: pa.Table, width: int, n_references: int) -> Candidates:
    angles = np.asarray(found.column("angles").combine_chunks().flatten(), np.float64).reshape(-1, n_references)
    column = lambda name: found.column(name).to_numpy()
    return Candidates(column("vec_id"), column("label"), matrix(found.column("vector"), width), column("norm"), angles)


def _meet_positives(k: int, width: int, n_references: int):
    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and asked.num_rows:
            every, asking = data.column("label").to_numpy(), asked.column("label").to_numpy()
            for label in np.unique(asking):
                own = data.filter(pa.array(every == label))
                if not own.num_rows:
                    continue
                anchors = _group(asked.filter(pa.array(asking == label)), width, n_references)
                shape = (len(anchors.ids), 1)
                best = Best(np.full(shape, _LOW + 1), np.full(shape, _HIGH), k)
                search(anchors, _group(own, width, n_references), best, same_label=True)
                out.append(_found(anchors.ids, best))
        anchor, place, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"anchor_id": anchor, "positive_id": ids, "positive_score": scores})

    return run


def _meet_negatives(k: int, width: int, n_references: int):
    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 4
        if data.num_rows and asked.num_rows:
            lows, highs = (asked.column(c).combine_chunks() for c in ("lows", "highs"))
            sizes = np.asarray(lows.value_lengths())
            shape = (len(sizes), int(sizes.max(initial=1)))
            low, high = np.full(shape, _HIGH), np.full(shape, _LOW)
            filled = np.arange(shape[1])[None, :] < sizes[:, None]
            low[filled], high[filled] = np.asarray(lows.flatten()), np.asarray(highs.flatten())
            anchors = _group(asked, width, n_references)
            # Candidates puts anchors in order; their windows follow by id, which is unique.
            by_id = np.argsort(asked.column("vec_id").to_numpy())
            order = by_id[np.searchsorted(asked.column("vec_id").to_numpy()[by_id], anchors.ids)]
            best = Best(low[order], high[order], k)
            search(anchors, _group(data, width, n_references), best, same_label=False)
            found = _found(anchors.ids, best)
        return pa.table(dict(zip(("anchor_id", "place", "negative_id", "negative_score"), found, strict=True)))

    return run


def _found(anchor_ids: np.ndarray, best: Best) -> list[np.ndarray]:
    """Anchor, window, candidate and score of everything found."""
    anchor, window, rank = np.nonzero(best.scores > _LOW)
    return [anchor_ids[anchor], window, best.ids[anchor, window, rank], best.scores[anchor, window, rank]]


def _numbers(count: Column) -> Column:
    """A row for each number below ``count``."""
    return F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _placed_by_label(rows: DataFrame, counts: DataFrame, n_shared: int) -> DataFrame:
    """``rows`` with their group: a hash of small labels, the label itself for large ones."""
    placed = scale.attach(rows, counts, "label")
    return placed.withColumns(
        {
            "alone": F.col("salts") > 1,
            "slot": F.when(F.col("salts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(n_shared))),
        }
    )


def find_positives(data: DataFrame, anchors: DataFrame, k: int, n_rows: int, width: int, n_references: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score, rank``: the k best rows of each anchor's label."""
    held = _rows_per_group(n_rows)
    asked = anchors.groupBy("label").agg(F.count("*").alias("asked"))
    counts = data.groupBy("label").agg(F.count("*").alias("n")).join(asked, "label").select(
        "label",
        F.ceil(F.col("n") / held).cast("int").alias("salts"),
        F.when(F.col("n") > held, F.ceil(F.col("asked") / ANCHORS_PER_GROUP)).otherwise(1).cast("int").alias("parts"),
    )
    counts = scale.materialise(counts)
    n_shared = max(LEAST_GROUPS, -(-n_rows // held))
    ours = _placed_by_label(data, counts, n_shared).filter("salts IS NOT NULL")
    ours = ours.withColumn("salt", F.pmod("row", "salts").cast("int")).withColumn("part", _numbers(F.col("parts")))
    theirs = _placed_by_label(anchors, counts, n_shared).filter("salts IS NOT NULL")
    theirs = theirs.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    theirs = theirs.withColumn("salt", _numbers(F.col("salts")))
    keys, sent = ["alone", "slot", "salt", "part"], ["vec_id", "label", "vector", "norm", "angles"]
    found = ours.select(*keys, *sent).groupBy(*keys).cogroup(theirs.select(*keys, *sent).groupBy(*keys)).applyInArrow(
        _meet_positives(k, width, n_references), "anchor_id long, positive_id long, positive_score long"
    )
    return _ranked(found, ["anchor_id"], "positive_score", "positive_id", k)


def _rows_per_group(n_rows: int) -> int:
    return min(ROWS_PER_GROUP, max(LEAST_ROWS_PER_GROUP, -(-n_rows // LEAST_GROUPS)))


def _regions(data: DataFrame, n_references: int) -> dict:
    """Boxes of the regions, one row per reference at most."""
    boxes = data.groupBy("region").agg(
        F.count("*").alias("n"), F.min("norm").alias("short"), F.max("norm").alias("long"),
        *[f(F.col("angles")[r]).alias(f"{name}{r}") for r in range(n_references) for name, f in (("least", F.min), ("most", F.max))],
    ).orderBy("region").collect()
    return {
        "region": np.array([b["region"] for b in boxes], np.int32),
        "n": [b["n"] for b in boxes],
        "short": np.array([b["short"] for b in boxes]), "long": np.array([b["long"] for b in boxes]),
        **{
            name: np.array([[b[f"{name}{r}"] for r in range(n_references)] for b in boxes]).reshape(len(boxes), n_references)
            for name in ("least", "most")
        },
    }


def _met_regions(boxes: dict, n_references: int):
    """Per anchor with its windows the regions that can hold a score within one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.asarray(batch.column("angles").flatten(), np.float64).reshape(-1, n_references)
            norms = batch.column("norm").to_numpy()
            lower, upper = score_bounds(angles, norms, boxes["least"], boxes["most"], boxes["short"], boxes["long"])
            lows, highs = batch.column("lows"), batch.column("highs")
            whose = np.repeat(np.arange(len(norms)), np.asarray(lows.value_lengths()))
            low, high = np.asarray(lows.flatten()), np.asarray(highs.flatten())
            open_window = (upper[whose] >= low[:, None]) & (lower[whose] <= high[:, None]) & (low <= high)[:, None]
            met = np.zeros(upper.shape, bool)
            np.logical_or.at(met, whose, open_window)
            edges = np.append(0, np.cumsum(met.sum(axis=1))).astype(np.int32)
            regions = pa.ListArray.from_arrays(edges, pa.array(boxes["region"][np.nonzero(met)[1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, regions], [*batch.schema.names, "regions"])

    return run


def _hundredths(factor: int, score: Column) -> Column:
    """``factor * score / 100`` rounded down; no step of it is larger than score or factor."""
    hundred = F.lit(100).cast("long")
    rest = F.pmod(score, hundred)
    whole = F.call_function("div", score - rest, hundred)
    return factor * whole + F.call_function("div", factor * rest - F.pmod(factor * rest, hundred), hundred)


def find_negatives(data: DataFrame, anchors: DataFrame, positives: DataFrame, k: int, low: int, high: int,
                   n_rows: int, width: int, n_references: int) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    windows = positives.select(
        F.col("anchor_id").alias("vec_id"), (F.col("rank") - 1).alias("place"),
        (-_hundredths(low, -F.col("positive_score"))).alias("lowest"),
        _hundredths(high, F.col("positive_score")).alias("highest"),
    )
    # At most k positives per anchor.
    lists = windows.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("place", "lowest", "highest"))).alias("w"))
    asked = anchors.join(lists, "vec_id").select(
        "vec_id", "label", "vector", "norm", "angles", F.col("w.lowest").alias("lows"), F.col("w.highest").alias("highs")
    )
    boxes = _regions(data, n_references)
    schema = "vec_id long, label long, vector array<long>, norm double, angles array<double>, lows array<long>, highs array<long>"
    sent = scale.store(asked.mapInArrow(_met_regions(boxes, n_references), f"{schema}, regions array<int>"))
    # One number per region, of which there are as many as references.
    asking = {r["region"]: r["count"] for r in sent.select(F.explode("regions").alias("region")).groupBy("region").count().collect()}
    held = _rows_per_group(n_rows)
    sizes = [(int(r), -(-n // held), -(-asking.get(int(r), 0) // ANCHORS_PER_GROUP)) for r, n in zip(boxes["region"], boxes["n"], strict=True)]
    sizes = data.sparkSession.createDataFrame([s for s in sizes if s[2]], "region int, salts int, parts int")
    keys, columns = ["region", "salt", "part"], ["vec_id", "label", "vector", "norm", "angles"]
    ours = data.join(F.broadcast(sizes), "region").withColumn("salt", F.pmod("row", "salts").cast("int"))
    ours = ours.withColumn("part", _numbers(F.col("parts"))).select(*keys, *columns)
    theirs = sent.withColumn("region", F.explode("regions")).join(F.broadcast(sizes), "region")
    theirs = theirs.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    theirs = theirs.withColumn("salt", _numbers(F.col("salts"))).select(*keys, *columns, "lows", "highs")
    found = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(
        _meet_negatives(k, width, n_references), "anchor_id long, place long, negative_id long, negative_score long"
    )
    best = _ranked(found, ["anchor_id", "place"], "negative_score", "negative_id", k)
    named = positives.select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), "positive_id", "positive_score")
    return best.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = 256,
         n_references: int = REFERENCES) -> DataFrame:
    """For every row where ``is_anchor`` holds, its best positives and their hard negatives.

    ``label`` is an integer column. Components times ``factor`` are rounded down; ``low`` and
    ``high`` are per cent of the positive's score.
    """
    prepared = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        quantised(vector, factor).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    size = prepared.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n_rows, width = size["n"], size["width"] or 0
    sample = prepared.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).toArrow()
    references = farthest_first(matrix(sample.column("vector"), width).astype(np.float64), n_references)
    data = stored_angles(prepared, references)
    asked = prepared.filter("is_anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("best"))
    anchors = stored_angles(asked.select("vec_id", F.col("best.label").alias("label"), F.col("best.vector").alias("vector")), references)
    found = scale.materialise(find_positives(data, anchors, positives, n_rows, width, len(references)))
    return find_negatives(data, anchors, found, negatives, low, high, n_rows, width, len(references))
