"""Nearest neighbours by vantage-point trees (operator 7).

Vectors are dealt to shards by a hash of their id.  Each shard builds a
vantage-point tree: a vantage point, the distances of all others to it, and a
split at the median, down to leaves of ``LEAF`` vectors.  A block of queries
goes down a tree together; a subtree whose distances to the vantage point lie in
[lo, hi] is left out for the queries with ``relax * max(lo - d, d - hi)`` over
their distance to the k-th best so far.  By the triangle inequality that loses
nothing with ``relax`` 1, which is exact search; larger factors prune more and
may lose neighbours.

The largest inner product is made a nearest neighbour by one more component,
sqrt(M^2 - |x|^2), where M is the shard's largest norm.  Queries are a stated
set; they meet the shards in blocks, so neither a shard nor a block of queries
grows with the table, and per query and shard only k rows leave a task.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id; several rows with one id
count as one (the smallest vector); vectors meet only vectors of their own
length; with fewer candidates than k all are returned; equal scores are ranked
by id; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.common import written

K = 20
RELAX = 1.0
SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF = 96
SLACK = 1e-9             # distances this close count as equal when pruning


class Tree:
    """Vantage-point tree over vectors and a batch search for largest inner products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.top = squares.max(initial=0.0)
        self.extra = np.sqrt(np.maximum(self.top - squares, 0.0))
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v = rows[len(rows) // 2]
        d2 = (2 * self.top - 2 * (self.vectors[rows] @ self.vectors[v] + self.extra[rows] * self.extra[v]))
        d = np.sqrt(np.maximum(d2, 0.0))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        parts = []
        for part in (order[:half], order[half:]):       # by rank, so that equal vectors split too
            parts.append((d[part[0]], d[part[-1]], self._build(rows[part])))
        return v, parts

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, relax: float = RELAX):
        """(scores, ids) of the k largest inner products, best first; -inf where there are fewer."""
        self.query_ids, self.queries, self.k, self.relax = ids, queries, k, relax
        self.squares = np.einsum("ij,ij->i", queries, queries)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self._descend(self.root, np.arange(len(ids)))
        return self.scores, self.found

    def _distance(self, inner: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares[q] + self.top - 2 * inner, 0.0))

    def _descend(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, q)
            return
        v, parts = node
        d = self._distance(np.einsum("qd,d->q", self.queries[q], self.vectors[v]), q)
        gap = [np.maximum(np.maximum(lo - d, d - hi), 0.0) for lo, hi, _ in parts]
        first = gap[1] < gap[0]
        for side in (first, ~first):                    # the nearer half first
            for number, (_, _, child) in enumerate(parts):
                group = np.flatnonzero(side == bool(number))
                kth = self.scores[q[group], -1]
                reach = np.where(np.isneginf(kth), np.inf, self._distance(np.where(np.isneginf(kth), 0, kth), q[group]))
                self._descend(child, q[group[self.relax * gap[number][group] <= reach + SLACK]])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        new = np.einsum("qd,nd->qn", self.queries[q], self.vectors[rows])
        new[self.ids[rows][None, :] == self.query_ids[q][:, None]] = -np.inf
        hit = np.flatnonzero((new >= self.scores[q, -1:]).any(axis=1))
        q, new = q[hit], new[hit]
        scores = np.concatenate([self.scores[q], new], axis=1)
        ids = np.concatenate([self.found[q], np.broadcast_to(self.ids[rows], new.shape)], axis=1)
        ids[np.isneginf(scores)] = np.iinfo(np.int64).max
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[q] = np.take_along_axis(scores, order, axis=1)
        self.found[q] = np.take_along_axis(ids, order, axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("vector").alias("vector"))
            .withColumn("dim", F.size("vector")))


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table whose first two columns hold them."""
    flat = np.concatenate([c.flatten().to_numpy() for c in table.column(1).chunks])
    return table.column(0).to_numpy(), flat.reshape(-1, dim)


def nearest(vectors: DataFrame, is_query, k: int = K, relax: float = RELAX,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which the
    condition ``is_query`` on ``vec_id`` holds, among all rows but itself."""
    usable_rows = written(usable(vectors, id_col, vector_col).withColumn("is_query", is_query), "vectors")
    sizes = usable_rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("is_query").cast("long")) / query_rows)).cast("int").alias("blocks"))
    sized = usable_rows.join(sizes, "dim")
    spread = F.xxhash64("vec_id")
    fields = "vec_id", "vector", "dim", "shard", "block"
    candidates = (sized.withColumn("shard", F.pmod(spread, F.col("shards")).cast("int"))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*fields))
    queries = (sized.where("is_query").withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*fields)
               .toDF(*(f"query_{f}" for f in fields)))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = key[0].as_py()
        query_ids, query_vectors = _matrix(right, dim)
        scores, ids = Tree(*_matrix(left, dim)).search(query_ids, query_vectors, k, relax)
        there = ~np.isneginf(scores)
        return pa.Table.from_arrays([pa.array(np.repeat(query_ids, there.sum(axis=1))), pa.array(ids[there]),
                                     pa.array(scores[there])], schema=schema)

    keys = fields[2:]
    found = (candidates.groupBy(*keys).cogroup(queries.groupBy(*(f"query_{f}" for f in keys)))
             .applyInArrow(run, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
