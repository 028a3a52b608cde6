"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. Each shard builds a KD-tree
(median splits on the widest dimension, tight bounding boxes, equal vectors
kept once). A query visits nodes best first by the bound that its box allows,
and stops when no box can reach its kth score. A first round searches each
query in one shard; the kth score found there is carried into the second round,
where all shards prune by it from the start.

Equal vectors score alike and rank by id, so of the ids of one vector in a
shard only the k + 1 smallest can be in a result; the rest is never needed.

Defined results: vectors that are null, or hold null or non-finite components,
or differ in length from the query, take no part; components so large that an
inner product could pass 64 bits (length * most ** 2 >= 2 ** 63) end the search with an error; a query with no other vector has no rows; an
empty table gives an empty result; rows that repeat an id are separate vectors
of that id, and none of them is a neighbour of a query with the same id; of
queries that repeat an id one is asked; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.runtime import written

K = 10
LEAF = 64
SHARD_ROWS = 2048
SCALE = 1024


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and components floor(1024 * x), without vectors that are not all finite."""
    x = F.col(vector_column).cast("array<double>")
    valid = F.col(vector_column).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(valid, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("vector")).where("vec_id is not null")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)
    most = max(int(out.max(initial=0)), -int(out.min(initial=0)))
    if out.shape[1] * most**2 >= 1 << 63:
        raise ValueError(f"vectors of length {out.shape[1]} with components up to {most} have inner products beyond 64 bits")
    return out


class KDTree:
    """Distinct vectors with the smallest ids of each; boxes of nodes as minima and maxima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        group = np.cumsum(new) - 1
        # by distinct ids, as a query skips all rows of its own
        number = np.cumsum(np.concatenate(([True], new[1:] | (ids[1:] != ids[:-1]))))
        place = number - number[np.flatnonzero(new)[group]]
        kept = place <= k
        self.ids, self.group, self.vectors = ids[kept], group[kept], vectors[new]
        self.first_id = np.searchsorted(self.group, np.arange(len(self.vectors) + 1))
        self.nodes: list[tuple[int, int, int, int]] = []  # left, right, first and end in self.rows
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows = np.arange(len(self.vectors))
        self._split(0, len(self.rows))
        self.lows, self.highs = np.stack(self.low), np.stack(self.high)

    def _split(self, first: int, end: int) -> int:
        node = len(self.nodes)
        self.nodes.append((-1, -1, first, end))
        own = self.vectors[self.rows[first:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        if end - first > LEAF:
            middle = (end - first) // 2
            part = np.argpartition(own[:, np.argmax(high - low)], middle)
            self.rows[first:end] = self.rows[first:end][part]
            left = self._split(first, first + middle)
            right = self._split(first + middle, end)
            self.nodes[node] = (left, right, first, end)
        return node

    def search(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to k best (score, -vec_id) with a score of at least `least`."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.highs @ up + self.lows @ down
        best: list[tuple[int, int]] = []
        floor = least
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if floor is not None and -bound < floor:
                break
            left, right, first, end = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if floor is None or bounds[child] >= floor:
                        heapq.heappush(heap, (-int(bounds[child]), child))
                continue
            rows = self.rows[first:end]
            scores = self.vectors[rows] @ query
            for at in np.flatnonzero(scores >= floor) if floor is not None else range(len(rows)):
                score = int(scores[at])
                if len(best) == k and score < best[0][0]:
                    continue
                for vec_id in self.ids[self.first_id[rows[at]] : self.first_id[rows[at] + 1]].tolist():
                    if vec_id == query_id:
                        continue
                    entry = (score, -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
        return best


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _search_shard(k: int):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            ids, lengths = left["vec_id"].to_numpy(), np.array([len(v) for v in left["vector"]])
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                asked = right.filter(pa.array([len(v) == length for v in right["vector"]]))
                if not length or not asked.num_rows:
                    continue
                tree = KDTree(ids[own], _matrix(left["vector"].take(pa.array(own))), k)
                for query_id, query, least in zip(asked["vec_id"].to_pylist(), _matrix(asked["vector"]), asked["least"].to_pylist(), strict=True):
                    out += [(query_id, -minus, score) for score, minus in tree.search(query_id, query, k, least)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return kernel


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as quantised() gives them."""
    vectors, queries = written(vectors, "search-vectors"), written(queries.dropDuplicates(["vec_id"]), "search-queries")
    shards = max(1, -(-vectors.count() // shard_rows))
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    sharded = vectors.withColumn("shard", shard_of)
    home = queries.withColumns({"shard": shard_of, "least": F.lit(None).cast("long")})
    columns = ["shard", "vec_id", "vector", "least"]
    near = sharded.groupBy("shard").cogroup(home.select(columns).groupBy("shard")).applyInArrow(_search_shard(k), _FOUND)
    reached = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    reached = written(queries.join(reached, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", "least"), "search-bounds")
    asked = reached.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = sharded.groupBy("shard").cogroup(asked.select(columns).groupBy("shard")).applyInArrow(_search_shard(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
