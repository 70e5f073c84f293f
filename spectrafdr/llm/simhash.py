"""SimHash near-duplicates by anchor-point covering.

``fingerprints``   a 64-bit SimHash per whole text
``links``          a spanning forest of all pairs of distinct fingerprints that differ in
                   at most ``MAX_BITS`` bits; with a larger ``max_bits`` also of those pairs
                   up to it that share an anchor
``near_duplicates`` one row per document with its component
``keep_one``       the documents with one row left per component

Covering. The 64 bits are cut into bands. Two fingerprints within four bits are, by
counting, within one bit in at least one of three bands (or within two in one of two).
Over each band lies a covering code: Hamming (15, 11) blocks of covering radius 1, and
plain bits of radius 0; its codewords are the anchors. A fingerprint lives at its nearest
anchor (home) and is replicated to every anchor within covering radius plus the band's
threshold, so the home of its partner is among them. Per anchor homes are compared with
everything that came, exactly, on all 64 bits.

Three bands give 2^17 anchors each and about 42 replicas a fingerprint; two bands give
2^24 anchors each and about 300 replicas. The latter is for corpora whose anchors would
hold too much (``MANY``); results are equal.

Size. Equal texts collapse to one fingerprint first. Rows of an anchor stream through the
task, homes first: only the homes of one anchor are in memory. An anchor with more than
``HOT_HOMES`` homes is salted: its homes go to every salt, its visitors to one. A batch
emits a forest of the links it found, never all pairs of a group.

Cases: null, empty and blank texts have fingerprint zero and link like any other; fewer
than four words are one shingle; null ids take part and get the component's smallest
non-null id (null if there is none); repeated rows stay; an empty table gives an empty
result; of the input only id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import packed, text_slices
from spectrafdr.llm.components import components
from spectrafdr.operators import scale

WIDTH = 4
MAX_BITS = 4
SEED = 42
MANY = 100_000_000
HOT_HOMES = 20_000
PAIRS_AT_ONCE = 2_000_000
# Bands as lists of block lengths: 15 is a Hamming block, anything else plain bits.
THREE_BANDS = ([15, 6], [15, 6], [15, 7])
TWO_BANDS = ([15, 15, 2], [15, 15, 2])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of a whole text as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-width]]
    hashes = np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)),
        dtype="<u8",
        count=len(starts),
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 width: int = WIDTH) -> DataFrame:
    """``doc_id, content, bits`` of every row: a hash of its text and, as a signed long, its SimHash."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("content")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = batch.column(1).to_pylist()
            found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found.view(np.int64))],
                ["doc_id", "content", "bits"],
            )

    return rows.mapInArrow(sketch, f"doc_id {id_type}, content long, bits long")


# --- the covering code -----------------------------------------------------------------


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Hamming (15, 11) syndrome: the exclusive or of the places (from 1) of the set bits."""
    out = np.zeros(len(values), dtype=np.int64)
    for place in range(15):
        out ^= np.where((values >> place) & 1, place + 1, 0)
    return out


def _block_steps(length: int, threshold: int) -> list[list[tuple[int, int]]]:
    """Per syndrome the patterns that lead to a block's anchors, each with the bits it uses up.

    Within a Hamming block the first bit of distance is covered (radius 1); plain bits have
    radius 0 and a single syndrome.
    """
    radius = 1 if length == 15 else 0
    steps: list[list[tuple[int, int]]] = [[] for _ in range(16 if radius else 1)]
    for weight in range(radius + threshold + 1):
        for places in itertools.combinations(range(length), weight):
            pattern = sum(1 << p for p in places)
            syndrome = int(_syndromes(np.array([pattern]))[0]) if radius else 0
            steps[syndrome].append((pattern, max(0, weight - radius)))
    return steps


def _band_steps(blocks: list[int], threshold: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per combined syndrome: patterns over the whole band, and which one leads home."""
    combined: dict[int, list[tuple[int, int]]] = {0: [(0, 0)]}
    offset = 0
    for length in blocks:
        own = _block_steps(length, threshold)
        combined = {
            key * len(own) + syndrome: [
                (a | (b << offset), used + more)
                for a, used in found
                for b, more in steps
                if used + more <= threshold
            ]
            for key, found in combined.items()
            for syndrome, steps in enumerate(own)
        }
        offset += length
    return {
        key: (np.array([p for p, _ in found], dtype=np.int64), np.array([u == 0 for _, u in found]))
        for key, found in combined.items()
    }


def _combined_syndrome(band: np.ndarray, blocks: list[int]) -> np.ndarray:
    key, offset = np.zeros(len(band), dtype=np.int64), 0
    for length in blocks:
        if length == 15:
            key = key * 16 + _syndromes((band >> offset) & 0x7FFF)
        offset += length
    return key


def anchors(bits: np.ndarray, bands, homes_only: bool = False):
    """``(anchor, row, home)`` arrays: every anchor each fingerprint goes to."""
    threshold = MAX_BITS // len(bands)
    found, shift = [], 0
    for number, blocks in enumerate(bands):
        length = sum(blocks)
        band = (bits.view(np.uint64) >> np.uint64(shift)).view(np.int64) & ((1 << length) - 1)
        key = _combined_syndrome(band, blocks)
        for syndrome, (patterns, home) in _band_steps(blocks, threshold).items():
            rows = np.flatnonzero(key == syndrome)
            if homes_only:
                patterns, home = patterns[home], home[home]
            found.append(
                (
                    ((band[rows, None] ^ patterns) | (number << 56)).ravel(),
                    np.repeat(rows, len(patterns)),
                    np.tile(home, len(rows)),
                )
            )
        shift += length
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _replicate(bands, homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                bits = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                anchor, row, home = anchors(bits, bands, homes_only)
                columns = [pa.array(anchor)] if homes_only else [
                    pa.array(anchor), pa.array(bits[row]), pa.array(home)
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "bits", "home"][: len(columns)])

    return run


# --- comparison per anchor -------------------------------------------------------------


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smallest node) of the given links."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor, homes first. Each home meets all rows of its anchor in the batch;
    homes of the last anchor are kept for its rows in the next batch."""
    kept_anchor, kept = None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy(zero_copy_only=False)
        bits = batch.column(1).to_numpy(zero_copy_only=False)
        home = batch.column(2).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor))
        group = np.cumsum(np.append(False, anchor[1:] != anchor[:-1]))
        ours, of = bits[home], group[home]
        if kept_anchor == anchor[0]:
            ours, of = np.append(kept, ours), np.append(np.zeros(len(kept), dtype=of.dtype), of)
        wide = (last - first)[of]
        edges = np.cumsum(wide) // PAIRS_AT_ONCE
        for at in np.split(np.arange(len(ours)), np.flatnonzero(np.diff(edges)) + 1):
            if not len(at):
                continue
            size = wide[at]
            begin = np.repeat(first[of[at]] - np.append(0, np.cumsum(size)[:-1]), size)
            other = bits[begin + np.arange(size.sum())]
            one = np.repeat(ours[at], size)
            apart = np.bitwise_count((one ^ other).view(np.uint64))
            near = (apart <= max_bits) & (apart > 0)
            if near.any():
                u, v = forest(one[near], other[near])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        here = home & (anchor == anchor[-1])
        kept = np.append(kept, bits[here]) if kept_anchor == anchor[-1] else bits[here]
        kept_anchor = anchor[-1]


def links(prints: DataFrame, bands=None, max_bits: int = MAX_BITS) -> DataFrame:
    """``u, v``: a spanning forest of all links between the distinct values of ``bits``.

    Whole up to ``MAX_BITS``; what a larger ``max_bits`` adds are candidates.
    """
    distinct = scale.store(prints.select("bits").distinct())
    if bands is None:
        bands = TWO_BANDS if distinct.count() > MANY else THREE_BANDS
    rows = distinct.mapInArrow(_replicate(bands, False), "anchor long, bits long, home boolean")
    homes = distinct.mapInArrow(_replicate(bands, True), "anchor long").groupBy("anchor").count()
    hot = scale.materialise(
        homes.filter(F.col("count") > HOT_HOMES).select(
            "anchor", F.ceil(F.col("count") / HOT_HOMES).cast("int").alias("salts")
        )
    )
    if hot.isEmpty():
        placed = rows.withColumn("salt", F.lit(0))
    else:
        salts = F.coalesce("salts", F.lit(1))
        one = F.array(F.pmod(F.xxhash64("bits"), salts).cast("int"))
        every = F.sequence(F.lit(0), salts - 1)
        placed = rows.join(hot, "anchor", "left").withColumn(
            "salt", F.explode(F.when(F.col("home"), every).otherwise(one))
        )
    keys = ["anchor"] if hot.isEmpty() else ["anchor", "salt"]
    dealt = placed.repartition(*keys).sortWithinPartitions("salt", "anchor", F.desc("home"))
    return dealt.select("anchor", "bits", "home").mapInArrow(
        lambda batches: _compare(batches, max_bits), "u long, v long"
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, content, bits, label, component_id`` for every row of ``docs``.

    ``label`` names the component by its smallest fingerprint, ``component_id`` by its smallest id.
    """
    prints = scale.store(fingerprints(docs, doc_id, text))
    labels = components(links(prints)).withColumnRenamed("node", "bits")
    smallest = prints.groupBy("bits").agg(F.min("doc_id").alias("low"))
    labelled = scale.materialise(
        smallest.join(labels, "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    )
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    of_print = scale.materialise(labelled.join(lowest, "label").select("bits", "label", "component_id"))
    return prints.join(of_print, "bits").select("doc_id", "content", "bits", "label", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near=near_duplicates) -> DataFrame:
    """Rows of ``docs`` with one left per component: the one with the smallest id.

    ``near`` finds the components: ``doc_id, content, label`` per row.
    Rows without an id come after those with one. Rows that repeat the chosen id and text
    leave one row.
    """
    found = scale.materialise(near(docs, doc_id, text).select("doc_id", "content", "label"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    chosen = found.groupBy("label").agg(F.min(order).alias("best")).select(
        F.col("best.doc_id").alias("_id"), F.col("best.content").alias("_content")
    )
    rows = found.groupBy("doc_id", "content").agg(F.count("*").alias("_rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    winners = scale.materialise(chosen.join(rows, same).select("_id", "_content", "_rows"))
    keyed = packed(docs, _doc=F.col(doc_id), _own=F.xxhash64(text))
    kept = keyed.join(winners, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_content")))
    single = kept.filter("_rows = 1").select("_row")
    if winners.filter("_rows > 1").isEmpty():
        return single.select("_row.*")
    several = kept.filter("_rows > 1").dropDuplicates(["_doc", "_own"]).select("_row")
    return single.union(several).select("_row.*")
