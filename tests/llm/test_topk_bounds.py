"""A task of the top-k search holds one shard and a bounded number of query blocks."""

import fixtures as fx
import numpy as np
import pyarrow as pa

from spectrafdr.llm import topk


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(240)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_tasks_hold_a_bounded_number_of_blocks(spark, monkeypatch):
    def counting(k):
        def run(data, blocks):
            n = blocks.num_rows
            return pa.table({name: pa.array([n], pa.int64()) for name in ("query_id", "vec_id", "score")})

        return run

    frame = vectors(spark)
    monkeypatch.setattr(topk, "LEAST_SHARDS", 3)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "BLOCKS_PER_MEETING", 2, raising=False)
    monkeypatch.setattr(topk, "_meet", counting)
    held = {r.query_id for r in topk.top_k(frame, frame.filter("vec_id % 4 = 0")).collect()}
    assert max(held) <= 2


def test_several_meetings_a_shard_give_the_same_rows(spark, monkeypatch):
    frame = vectors(spark)
    monkeypatch.setattr(topk, "LEAST_SHARDS", 3)
    want = fx.rows_of(topk.top_k(frame, frame.filter("vec_id % 4 = 0")), "query_id", "rank", "vec_id", "score")
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "BLOCKS_PER_MEETING", 2, raising=False)
    found = topk.top_k(frame, frame.filter("vec_id % 4 = 0"))
    assert fx.rows_of(found, "query_id", "rank", "vec_id", "score") == want
