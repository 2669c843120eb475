import numpy as np
from pyspark.sql import functions as F

from currikit.llm.topk_search import SortedLists, top_k


def test_oracle(same_as_oracle):
    same_as_oracle("op8_topk_search")


def test_threshold_search_is_exact():
    rng = np.random.default_rng(1)
    for n, d, k, high in ((1, 3, 5, 9), (400, 2, 7, 3), (3000, 3, 5, 1000), (500, 16, 20, 2), (300, 4, 3, 1 << 29), (20, 2, 20, 3)):
        ids, vectors = rng.permutation(n) * 3, rng.integers(-high, high + 1, (n, d))
        block = SortedLists(ids, vectors)
        queries = np.concatenate([vectors[:5], np.zeros((1, d), np.int64), np.eye(d, dtype=np.int64)[:1]])
        owns = np.array([*ids[:5], ids[0], 10**9 + 1][-len(queries) :] if len(ids) >= 5 else [ids[0], ids[0], 1])
        for q, own, (places, scores) in zip(queries, owns, block.top(queries, owns, k), strict=True):
            want = sorted(((-int(v @ q), int(i)) for i, v in zip(ids, vectors) if i != own))[:k]
            assert [(-int(s), int(block.ids[p])) for p, s in zip(places, scores)] == want


def test_threshold_search_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-9, 10, (4000, 4))
    vectors[:30] = 1000
    block = SortedLists(np.arange(4000), vectors)
    assert len(block.levels) > 2
    block.levels[-1] = (4000, np.array([10**9]))  # must not be looked at
    assert [p.tolist() for p, _ in block.top(np.array([[1, 2, 1, 1]]), np.array([7]), 5)] == [[0, 1, 2, 3, 4]]


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (3, [1.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, k=2, candidates=2, queries=1).collect()))
    assert got == [(0, 1, 2, 4096), (0, 2, 3, 4096), (20, 1, 0, 2048), (20, 2, 2, 2048)]
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
