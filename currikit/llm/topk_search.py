"""Exact top-k inner-product search by the threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors to a block of candidates, and queries to a block, about. Each candidate is copied once for every block of queries.
CANDIDATES, QUERIES = 8_192, 32_768
#: Queries that look at the lists together.
TOGETHER = 256
#: Depth of the first look into the sorted lists; each further look is twice as deep.
FIRST_DEPTH = 32


class SortedLists:
    """A block of vectors with, for each dimension, its rows from the smallest component to the largest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # places then order as ids do
        self.ids, vectors = ids[by_id], vectors[by_id]
        self.rising = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.rising, axis=0)
        self.vectors = vectors
        self.largest = int(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64)
        self.levels = self._levels()

    def _levels(self) -> list[tuple[int, np.ndarray]]:
        """For each depth the rows that either end of any list shows there first."""
        n, out, begin, depth = len(self.ids), [], 0, FIRST_DEPTH
        met = np.zeros(n, bool)
        while not met.all():
            depth = min(depth, n)
            shown = np.concatenate([self.rising[begin:depth].ravel(), self.rising[n - depth : n - begin].ravel()])
            fresh = np.unique(shown[~met[shown]])
            met[fresh] = True
            out.append((depth, fresh))
            begin, depth = depth, 2 * depth
        return out

    def top(self, queries: np.ndarray, owns: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of each query's k best rows whose id is not its own, ties to smaller ids.

        All queries look at the lists to one depth after the other. Rows met
        are scored in full, all at once. No row unmet scores above the sum, over
        dimensions, of the query times the list's value at that depth from the
        end that suits its sign, so a query ends when its k-th score is above that
        sum (at equality an unmet row with a smaller id could still come in).
        """
        n, dims = self.vectors.shape
        high = int(np.abs(queries).max(initial=0))
        exact = dims * high * max(self.largest, 1) * max(n, 1) < 1 << 52  # then doubles hold every score and key
        multiply = self.floats if exact else self.vectors
        own_place = np.searchsorted(self.ids, owns)
        own_place = np.where((own_place < n) & (self.ids[np.minimum(own_place, n - 1)] == owns), own_place, -1)
        places = np.zeros((len(queries), 0), np.int64)
        scores = np.zeros((len(queries), 0), multiply.dtype)
        out: list = [None] * len(queries)
        active = np.arange(len(queries))
        for depth, fresh in self.levels:
            if not len(active):
                break
            asked = queries[active].astype(multiply.dtype)
            new = asked @ multiply[fresh].T
            fresh_places = np.broadcast_to(fresh, new.shape)
            scores, places = np.concatenate([scores, new], axis=1), np.concatenate([places, fresh_places], axis=1)
            own = places == own_place[active][:, None]
            order = self._best(np.where(own, -np.inf, scores) if exact else scores, places, own, k, exact)
            scores, places = np.take_along_axis(scores, order, axis=1), np.take_along_axis(places, order, axis=1)
            own = np.take_along_axis(own, order, axis=1)
            bound = np.maximum(asked, 0) @ self.sorted[n - depth].astype(multiply.dtype) + np.minimum(asked, 0) @ self.sorted[depth - 1].astype(multiply.dtype)
            last = depth >= n or fresh is self.levels[-1][1]
            full = scores.shape[1] >= k and not own.any()
            done = np.full(len(active), last)
            if not last and full:
                done |= scores[:, k - 1] > bound
            elif not last and scores.shape[1] >= k:
                done |= (scores[:, k - 1] > bound) & ~own.any(axis=1)
            for i in np.flatnonzero(done).tolist():
                mine = ~own[i]
                out[active[i]] = places[i][mine], scores[i][mine].astype(np.int64)
            active, scores, places = active[~done], scores[~done], places[~done]
        return [(np.empty(0, np.int64), np.empty(0, np.int64)) if x is None else x for x in out]

    def _best(self, scores: np.ndarray, places: np.ndarray, own: np.ndarray, k: int, exact: bool) -> np.ndarray:
        """Columns of each row's k best, best first; the query's own row comes last."""
        if exact:
            key = scores * len(self.ids) - places  # no two alike
            if key.shape[1] > k:
                columns = np.argpartition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k :]
                return np.take_along_axis(columns, np.argsort(-np.take_along_axis(key, columns, axis=1), axis=1), axis=1)
            return np.argsort(-key, axis=1)
        return np.array([np.lexsort((p, -s, o))[:k] for s, p, o in zip(scores, places, own, strict=True)])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k best inner products of each query with all other rows: ``(query_id, rank, vec_id, score)``.

    Components become floor(scale * x). Queries and candidates are dealt into
    blocks; each pair of blocks is one group, in which the threshold algorithm
    answers each query over the block's sorted lists, and a last step keeps the
    k best of a query's block results. Nothing is broadcast, and a group holds one block of each
    side, whatever the corpus. The result is exact.

    Vectors that are null, empty, or hold null or non-finite components take no
    part, and neither do rows without an id. A row never meets its own id;
    repeated rows count once, and of rows that share an id but not the vector
    the one with the smallest vector stays. Ties go to smaller ids. Fewer than k
    candidates give fewer rows; an empty table gives none. Vectors must be of
    one length; other columns are ignored.
    """
    ints = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    n_cb, n_qb = -(-max(1, n_rows) // candidates), -(-max(1, n_queries) // queries)
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = rows.select("id", "v", dealt(n_cb, 1).alias("cb"), every(n_qb).alias("qb"))
    right = rows.where("q").select("id", "v", dealt(n_qb, 2).alias("qb"), every(n_cb).alias("cb"))

    def run(cands: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if cands.num_rows and asked.num_rows:
            block = SortedLists(*_matrix(cands))
            owns, vectors = _matrix(asked)
            for i in range(0, len(owns), TOGETHER):
                mine = owns[i : i + TOGETHER]
                for own, (places, scores) in zip(mine, block.top(vectors[i : i + TOGETHER], mine, k), strict=True):
                    out.append((np.full(len(places), own), block.ids[places], scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    partial = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = t.column("v").combine_chunks()
    flat = values.flatten().to_numpy()
    return t.column("id").to_numpy(), flat.reshape(t.num_rows, -1)



#: The same in DuckDB, with the defaults and ids divisible by 20 as queries.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2])) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20"""
