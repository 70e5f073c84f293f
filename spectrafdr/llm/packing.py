"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A document longer than the capacity fills whole sequences alone; its remainder, and every
shorter document, is packed best-fit in order of decreasing size. A bin takes no two pieces
of one source and no two of one duplicate cluster: it carries a bitmap of both. Bins are
kept by residual; the successor search starts at the smallest residual that fits and goes on
until it meets a bin without a common bit - the tightest compatible one. A tree over the
residuals holds the intersection of the bitmaps below each node, so ranges in which every
bin has the conflict are passed over at once.

Documents are dealt by a seeded hash of their id into shards of about ``ROWS_PER_SHARD``
rows, each packed by one task; a source or cluster with a third of all rows is spread over
all shards, and nothing is left out. The result depends on the rows only, not on the
partitioning of the input.

Cases: null or blank texts have size 0 and go into a bin like others; a null source is a
source of its own; a null cluster conflicts with nothing; null ids come last in ties; rows
that share id, size, source and cluster are interchangeable; an empty table gives an empty
result. Other columns are read only if named.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import WORD, word_count

CAPACITY = 2048
ROWS_PER_SHARD = 2048
_WORD = re.compile(WORD)


class Bins:
    """Open bins by residual, with the intersection of bitmaps over ranges of residuals."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.width = 1 << capacity.bit_length()
        # Of a node: bits that all bins below have; -1 (every bit) where there is no bin.
        self.common = [-1] * (2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.residual: list[int] = []
        self.bits: list[int] = []

    def place(self, size: int, bits: int) -> int:
        """The tightest compatible bin for a piece, or a new one; the piece is put into it."""
        found = self._successor(size, bits)
        if found is None:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.bits.append(0)
        else:
            old = self.residual[found]
            self.at[old].remove(found)
            self._refresh(old)
        self.residual[found] -= size
        self.bits[found] |= bits
        new = self.residual[found]
        self.at[new].append(found)
        self._refresh(new)
        return found

    def _refresh(self, residual: int) -> None:
        common = -1
        for one in self.at[residual]:
            common &= self.bits[one]
            if not common:
                break
        node = residual + self.width
        self.common[node] = common
        while node > 1:
            node >>= 1
            joint = self.common[2 * node] & self.common[2 * node + 1]
            if joint == self.common[node]:
                break
            self.common[node] = joint

    def _successor(self, size: int, bits: int) -> int | None:
        # Nodes that cover residuals >= size, from the smallest on.
        stack = []
        low, high = size + self.width, 2 * self.width
        right = []
        while low < high:
            if low & 1:
                stack.append(low)
                low += 1
            if high & 1:
                high -= 1
                right.append(high)
            low >>= 1
            high >>= 1
        pending = (stack + right[::-1])[::-1]
        while pending:
            node = pending.pop()
            common = self.common[node]
            if common == -1 or common & bits:
                continue
            if node < self.width:
                pending.append(2 * node + 1)
                pending.append(2 * node)
                continue
            for one in self.at[node - self.width]:
                if not self.bits[one] & bits:
                    return one
        return None


def pack_shard(ids: list, sizes: list[int], sources: list, clusters: list, capacity: int):
    """``(row, piece, start, words, bin, offset)`` of every piece of one shard."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, sizes[i]))
    source_bit = {s: i for i, s in enumerate(dict.fromkeys(sources[i] for i in order))}
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    shared = [c for c in dict.fromkeys(clusters[i] for i in order) if c is not None and seen[c] > 1]
    cluster_bit = {c: i + len(source_bit) for i, c in enumerate(shared)}
    pieces, rest = [], []
    bins = Bins(capacity)
    for i in order:
        bits = 1 << source_bit[sources[i]]
        if clusters[i] in cluster_bit:
            bits |= 1 << cluster_bit[clusters[i]]
        whole = sizes[i] // capacity
        for piece in range(whole):
            pieces.append((i, piece, piece * capacity, capacity, bins.place(capacity, bits), 0))
        left = sizes[i] - whole * capacity
        if left or not whole:
            rest.append((i, whole, whole * capacity, left, bits))
    rest.sort(key=lambda r: -r[3])
    for i, piece, start, words, bits in rest:
        found = bins.place(words, bits)
        pieces.append((i, piece, start, words, found, capacity - bins.residual[found] - words))
    return pieces


def _packer(capacity: int, with_text: bool):
    def run(found: pa.Table) -> pa.Table:
        columns = {n: found.column(n).to_pylist() for n in ("doc_id", "size", "source", "cluster")}
        pieces = pack_shard(*columns.values(), capacity)
        rows = np.array([p[0] for p in pieces], dtype=np.int64)
        shard = found.column("shard")[0].as_py() << 32
        out = {
            "doc_id": found.column("doc_id").take(pa.array(rows)),
            "piece": pa.array([p[1] for p in pieces], pa.int32()),
            "start": pa.array([p[2] for p in pieces], pa.int64()),
            "n_words": pa.array([p[3] for p in pieces], pa.int64()),
            "bin_id": pa.array([shard + p[4] for p in pieces], pa.int64()),
            "offset": pa.array([p[5] for p in pieces], pa.int32()),
            "source": found.column("source").take(pa.array(rows)),
        }
        if with_text:
            texts = found.column("text").to_pylist()
            out["text"] = pa.array([_piece(texts[p[0]], p[2], p[3], columns["size"][p[0]]) for p in pieces], pa.string())
        return pa.table(out)

    return run


def _piece(text: str | None, start: int, words: int, size: int) -> str | None:
    """Words ``start`` to ``start + words`` of a text, as they stand there."""
    if text is None or words == size:
        return text
    begin = end = None
    for number, match in enumerate(_WORD.finditer(text)):
        if number == start:
            begin = match.start()
        if number == start + words - 1:
            end = match.end()
            break
    return text[begin:end] if begin is not None else ""


def text_cluster(text: str = "text") -> Column:
    """Cluster of equal texts: a hash of the lower-cased words; null for a text without words."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0)
    return F.when(F.size(words) > 0, F.xxhash64(words))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         cluster: Column | None = None, capacity: int = CAPACITY, with_text: bool = False) -> DataFrame:
    """``doc_id, piece, start, n_words, bin_id, offset, source`` of every piece.

    ``cluster`` is any column of ``docs`` that names duplicate clusters; equal texts by default.
    """
    n_shards = max(1, -(-docs.count() // ROWS_PER_SHARD))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        word_count(text).alias("size"),
        F.col(source).cast("string").alias("source"),
        (text_cluster(text) if cluster is None else cluster).alias("cluster"),
        *([F.col(text).alias("text")] if with_text else []),
    )
    place = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "size", "cluster"), F.lit(n_shards))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, n_words long, bin_id long, offset int, source string"
    return rows.withColumn("shard", place).groupBy("shard").applyInArrow(
        _packer(capacity, with_text), schema + (", text string" if with_text else "")
    )
