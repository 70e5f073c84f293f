"""Exact top-k by inner product: dual-tree search over cover trees.

Data are dealt by a hash of their id into shards of about ``ROWS_PER_SHARD`` rows, queries
into blocks of ``QUERIES_PER_BLOCK``. Every shard meets every block once, in tasks of one shard
and about ``BLOCKS_PER_MEETING`` blocks, for which its rows are repeated: a cover tree over the shard, one over the block, and a traversal of node pairs from the best bound down. A pair
is dropped when no product of its members can reach the worst k-th score within its group of
queries: with centres q, p and covering radii r, s a product is at most
``q.p + |q| s + |p| r + r s``. What is left is multiplied out. Each shard returns at most k
rows per query, which a window merges.

A node splits by greedy covering with balls of half its radius; centres are further apart
than that, every point belongs to one. A node whose cover would be nearly as many balls as
points (no structure left), one with few points and one of equal points are leaves. The tree
over a block of queries goes on to groups of at most ``QUERY_LEAF``: small groups have small
radii and prune more.

Ties go to the smaller id, so pairs that could only tie are still visited. All numbers are
integers; products are exact as long as they stay below 2^53, and taken as 64-bit integers
otherwise.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id; shorter vectors count as padded with zeros; rows that share the query's
id are its own and no candidates, a query id that repeats counts once (its smallest vector);
repeated candidate rows are listed as often as they come; fewer candidates than k give fewer
rows; empty tables give none. Only id and vector are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SHARD = 32_768
LEAST_SHARDS = 32
QUERIES_PER_BLOCK = 256
BLOCKS_PER_MEETING = 256
LEAF = 64
QUERY_LEAF = 4
COLUMNS_AT_ONCE = 4096
_LOW = -(1 << 62)  # below every score; its negative is a number too


class CoverTree:
    """Nodes as arrays: centre row, radius, children (node numbers) or rows of a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, least_share: int = 4):
        self.points, self.leaf, self.least_share = points, leaf, least_share
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.root = self._build(np.arange(len(points)), 0) if len(points) else -1

    def _distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        apart = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def _build(self, rows: np.ndarray, centre: int) -> int:
        distances = self._distances(rows, centre)
        node, radius = len(self.centre), float(distances.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= self.leaf or radius == 0.0:
            return node
        balls = self._cover(rows, centre, distances, radius / 2)
        if balls is not None:
            self.children[node] = [self._build(own, c) for c, own in balls]
        return node

    def _cover(self, rows, centre, distances, radius):
        """Greedy balls, the node's centre first; None if balls have under ``least_share`` rows on average."""
        balls, near = [], distances <= radius
        balls.append((centre, rows[near]))
        left = rows[~near]
        while len(left):
            if self.least_share * len(balls) > len(rows):
                return None
            chosen = int(left[0])
            near = self._distances(left, chosen) <= radius
            balls.append((chosen, left[near]))
            left = left[~near]
        return balls


class Search:
    """Best k candidates of a block of queries against one shard."""

    def __init__(self, query_ids, queries, ids, data, k: int):
        order = np.argsort(ids, kind="stable")  # leaves list smaller ids first
        self.ids, self.data = ids[order], data[order]
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.scores = np.full((len(queries), k), _LOW, dtype=np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.exact_float = max(np.abs(queries).max(initial=0), 1) * max(np.abs(data).max(initial=0), 1) * max(
            1, data.shape[1]
        ) < float(1 << 53)
        self.float_data = self.data.astype(np.float64)
        self.float_queries = queries.astype(np.float64)
        self.visited = 0

    def run(self, data_tree: CoverTree | None = None) -> None:
        own = CoverTree(self.float_queries, leaf=QUERY_LEAF, least_share=0)
        other = data_tree or CoverTree(self.float_data)
        if own.root < 0 or other.root < 0:
            return
        pending = [(-self._bounds(own, [own.root], other, [other.root])[0], own.root, other.root)]
        while pending:
            bound, q, p = heapq.heappop(pending)
            if -bound < self._worst(own, q):
                continue
            ours, theirs = own.children[q] or [q], other.children[p] or [p]
            if ours == [q] and theirs == [p]:
                self._multiply(own.rows[q], other.rows[p])
                continue
            bounds = self._bounds(own, ours, other, theirs).reshape(len(ours), len(theirs))
            for i, a in enumerate(ours):
                for j in np.flatnonzero(bounds[i] >= self._worst(own, a)):
                    heapq.heappush(pending, (-bounds[i, j], a, theirs[j]))

    def _worst(self, tree: CoverTree, node: int) -> float:
        """The lowest k-th score within a group of queries."""
        return float(self.scores[tree.rows[node], -1].min())

    def _bounds(self, own: CoverTree, ours: list[int], other: CoverTree, theirs: list[int]) -> np.ndarray:
        a = self.float_queries[[own.centre[n] for n in ours]]
        b = self.float_data[[other.centre[n] for n in theirs]]
        r = np.array([own.radius[n] for n in ours])[:, None]
        s = np.array([other.radius[n] for n in theirs])[None, :]
        long_a = np.linalg.norm(a, axis=1)[:, None]
        long_b = np.linalg.norm(b, axis=1)[None, :]
        bound = a @ b.T + long_a * s + long_b * r + r * s
        return (bound + 1e-9 * (long_a + r) * (long_b + s) + 1e-6).ravel()

    def _multiply(self, queries: np.ndarray, rows: np.ndarray) -> None:
        rows = np.sort(rows)
        self.visited += len(queries) * len(rows)
        for at in range(0, len(rows), COLUMNS_AT_ONCE):
            part = rows[at : at + COLUMNS_AT_ONCE]
            if self.exact_float:
                scores = (self.float_queries[queries] @ self.float_data[part].T).astype(np.int64)
            else:
                scores = self.queries[queries] @ self.data[part].T
            ids = self.ids[part]
            scores[self.query_ids[queries][:, None] == ids[None, :]] = _LOW
            best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
            new_scores = np.take_along_axis(scores, best, axis=1)
            new_ids = np.where(new_scores == _LOW, np.iinfo(np.int64).max, ids[best])
            all_scores = np.concatenate([self.scores[queries], new_scores], axis=1)
            all_ids = np.concatenate([self.found[queries], new_ids], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
            self.scores[queries] = np.take_along_axis(all_scores, order, axis=1)
            self.found[queries] = np.take_along_axis(all_ids, order, axis=1)


def quantised(vector: str, factor: int = 256) -> Column:
    """Components times ``factor``, rounded down; null for a vector that takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * factor))
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.when(F.col(vector).isNotNull() & ~bad, whole)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    values = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def _block(found: pa.Table) -> pa.Table:
    queries = _matrix(found.column("vector"), 0)
    ids = np.asarray(found.column("vec_id"))
    return pa.table({"block": [found.column("block")[0].as_py()], "ids": [ids.tobytes()], "queries": [queries.tobytes()],
                     "width": pa.array([queries.shape[1]], pa.int32())},
                    schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("queries", pa.binary()), ("width", pa.int32())]))


def _numbers(count: int) -> Column:
    """The numbers below ``count``."""
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def _meet(k: int):
    def run(data: pa.Table, blocks: pa.Table) -> pa.Table:
        query_ids, ids, scores = [], [], []
        tree = None
        own_ids = np.asarray(data.column("vec_id"), dtype=np.int64)
        for i in range(blocks.num_rows if data.num_rows else 0):
            width = blocks.column("width")[i].as_py()
            asked = np.frombuffer(blocks.column("ids")[i].as_py(), dtype=np.int64)
            queries = np.frombuffer(blocks.column("queries")[i].as_py(), dtype=np.int64).reshape(len(asked), width)
            rows = _matrix(data.column("vector"), width)
            queries = np.pad(queries, ((0, 0), (0, rows.shape[1] - width)))
            search = Search(asked, queries, own_ids, rows, k)
            if tree is None or tree.points.shape[1] != rows.shape[1]:
                tree = CoverTree(search.float_data)
            search.run(tree)
            hit = search.scores > _LOW
            query_ids.append(np.repeat(asked, k).reshape(-1, k)[hit])
            ids.append(search.found[hit])
            scores.append(search.scores[hit])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": join(query_ids), "vec_id": join(ids), "score": join(scores)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id",
          vector: str = "embedding", factor: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the k best rows of ``vectors``."""
    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(vector, factor).alias("vector")).filter(
            "vec_id IS NOT NULL AND vector IS NOT NULL"
        )

    data, asked = prepared(vectors), prepared(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_shards = max(LEAST_SHARDS, -(-data.count() // ROWS_PER_SHARD))
    n_blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    place = F.xxhash64(F.lit("shard"), "vec_id", "vector")
    sharded = data.withColumn("shard", F.pmod(place, F.lit(n_shards)).cast("long"))
    blocks = (
        asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(n_blocks)))
        .groupBy("block")
        .applyInArrow(_block, "block long, ids binary, queries binary, width int")
    )
    # The stated query set meets all shards, a block at a time.
    sent = blocks.withColumn("part", F.floor(F.col("block") / BLOCKS_PER_MEETING)).withColumn(
        "shard", F.explode(_numbers(n_shards))
    ).drop("block")
    repeated = sharded.withColumn("part", F.explode(_numbers(-(-n_blocks // BLOCKS_PER_MEETING))))
    found = repeated.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(
        _meet(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
