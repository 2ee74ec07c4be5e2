"""Centroid clustering over a vector-approximation file (operator 12).

Vectors are integer vectors; a centroid is one too, and its update is the exact
componentwise floor of the mean.

1. Each dimension is cut into ``2 ** bits`` cells that hold about equally many
   components.  The approximate quantiles only place the borders: any borders give
   the same result.  Each vector is written once with its cells, one byte a
   dimension, and its exact squared length.
2. In a round every task makes, from the centroids, two lookup tables: the least and
   the largest product of each centroid's component with the components of a cell.
   Summed along a vector's cells they bound its product with each centroid, and with
   its squared length and the centroid's the distance to it.  Centroids whose least
   distance is above another one's largest cannot be nearest.  Where one centroid is
   left the vector is assigned by its cells alone; only for the others, whose
   intervals overlap, the full vector is taken out of its column and the distances to
   the centroids that are left are computed.
3. The sums of the new centroids are partial sums of each task, of k rows, which Spark
   adds up; only k centroids come to the driver.  The vectors never move: no round
   shuffles or rewrites them, and a lost executor costs its running tasks only.

A sum needs every member's components, so the vector column is read in each round
beside the cells; what the cells save is the computing of distances.

Defined results: see ``vectors.integer_rows`` for vectors that take no part; a row with a null id takes part; every row
counts, also those that repeat an id; fewer vectors than k are as many centroids; an
empty centroid stays where it is; equal distances go to the smaller number; an empty
table gives no row; sums beyond 64 bits are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.vectors import matrix
from tavola.llm.workers import lean

BITS = 6
FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Cells:
    """Cells of integer components: in dimension j, cell i holds low[j, i] to high[j, i]."""

    borders: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, borders: list[list[int]], least: list[int], largest: list[int], bits: int) -> Cells:
        kept, low, high = [], np.zeros((len(borders), 1 << bits), np.int64), np.zeros((len(borders), 1 << bits), np.int64)
        for j, (cuts, lo, hi) in enumerate(zip(borders, least, largest)):
            cuts = np.unique(np.array([c for c in cuts if lo < c <= hi], dtype=np.int64))
            kept.append(cuts)
            low[j, :len(cuts) + 1] = [lo, *cuts]
            high[j, :len(cuts) + 1] = [*(cuts - 1), hi]
        return cls(kept, low, high)

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, cuts in enumerate(self.borders):
            out[:, j] = np.searchsorted(cuts, x[:, j], side="right")
        return out


class Lookup:
    """Distance intervals of vectors known by their cells, for a set of centroids.

    All distances are without the vector's squared length, which is the same for
    every centroid."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.centroids = centroids
        self.squares = np.einsum("kd,kd->k", centroids, centroids)
        a = cells.low[:, :, None] * centroids.T[:, None, :]
        b = cells.high[:, :, None] * centroids.T[:, None, :]
        self.least, self.largest = np.minimum(a, b), np.maximum(a, b)       # (dimension, cell, centroid)

    def possible(self, cells: np.ndarray) -> np.ndarray:
        """(vector, centroid): may the centroid be the nearest?"""
        least = np.zeros((len(cells), len(self.centroids)), dtype=np.int64)
        largest = np.zeros_like(least)
        for j in range(cells.shape[1]):
            least += self.least[j].take(cells[:, j], axis=0)
            largest += self.largest[j].take(cells[:, j], axis=0)
        upper = (self.squares - 2 * least).min(axis=1, keepdims=True)
        return self.squares - 2 * largest <= upper

    def nearest(self, cells: np.ndarray, fetch) -> tuple[np.ndarray, int]:
        """Nearest centroid of each vector, and how many distances were computed;
        ``fetch(rows)`` gives the full vectors of rows."""
        possible = self.possible(cells)
        out = possible.argmax(axis=1)
        open_rows = np.flatnonzero(possible.sum(axis=1) > 1)
        if not len(open_rows):
            return out, 0
        row, centroid = np.nonzero(possible[open_rows])
        exact = np.full((len(open_rows), len(self.centroids)), FAR)
        full = fetch(open_rows)
        exact[row, centroid] = self.squares[centroid] - 2 * np.einsum("pd,pd->p", full[row], self.centroids[centroid])
        out[open_rows] = exact.argmin(axis=1)
        return out, len(row)


def approximate(rows: DataFrame, dim: int, bits: int = BITS) -> tuple[DataFrame, Cells]:
    """Written (vec_id, cells, squares, vector) of rows (vec_id, vector), and the cells."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell has 1 to 8 bits")
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = rows.agg(*[F.struct(F.percentile_approx(v, shares, 1000).alias("cuts"), F.min(v).alias("low"),
                                F.max(v).alias("high")).alias(f"d{j}")
                       for j in range(dim) for v in [F.col("vector")[j]]]).first()
    cells = Cells.of([d.cuts or [] for d in found], [d.low or 0 for d in found], [d.high or 0 for d in found], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            coded = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(dim), len(x), [None, pa.py_buffer(cells.encode(x).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), coded, pa.array(np.einsum("nd,nd->n", x, x)), batch.column(1)],
                                             names=["vec_id", "cells", "squares", "vector"])

    coded = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return written(coded.mapInArrow(lean(run), "vec_id long, cells binary, squares long, vector array<long>"),
                   "va-file"), cells


def _cells(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.cast(pa.binary(dim))
    return np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * dim:(raw.offset + len(raw)) * dim].reshape(-1, dim)


def _sums(table: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums, computed): members, their sum, and distances computed, of each cluster."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, n, sums, computed = Lookup(cells, centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for batch in batches:
            x = matrix(batch.column(1), dim)
            cluster, work = lookup.nearest(_cells(batch.column(0), dim), x.__getitem__)
            computed += work
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            there, first = np.unique(cluster[order], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(x[order], first, axis=0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(list(sums[there]), pa.list_(pa.int64())),
             pa.array([computed if i == 0 else 0 for i in range(len(there))], pa.int64())],
            names=["cluster", "n", "sums", "computed"])

    parts = table.select("cells", "vector").mapInArrow(lean(run), "cluster int, n long, sums array<long>, computed long")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("computed").alias("computed"),
                                        F.array(*[F.sum(F.col("sums")[j]) for j in range(dim)]).alias("sums"))


def refine(table: DataFrame, cells: Cells, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """Centroids after the rounds, and the distances that each round computed."""
    computed = []
    for _ in range(rounds):
        found = _sums(table, cells, centroids).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster] = [s // r.n for s in r.sums]
        computed.append(sum(r.computed for r in found))
    return centroids, computed


def assign(table: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of the rows of a table of approximations."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(cells, centroids)
        for batch in batches:
            x = matrix(batch.column(3), dim)
            cluster, _ = lookup.nearest(_cells(batch.column(1), dim), x.__getitem__)
            product = np.einsum("nd,nd->n", x, centroids[cluster])
            distance = batch.column(2).to_numpy() + lookup.squares[cluster] - 2 * product
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    return (table.select("vec_id", "cells", "squares", "vector")
            .mapInArrow(lean(run), "vec_id long, cluster int, distance long"))


@dataclass(frozen=True)
class Clusters:
    members: DataFrame              # vec_id, cluster, distance (squared)
    centroids: list[list[int]]
    computed: list[int]             # distances to full vectors, by round


def cluster(rows: DataFrame, dim: int, starts: list[list[int]], rounds: int, bits: int = BITS) -> Clusters:
    """Lloyd's rounds over rows (vec_id, vector) from the given centroids, and one more assignment."""
    if not starts:
        empty = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).alias("cluster"),
                            F.lit(0).cast("long").alias("distance")).limit(0)
        return Clusters(empty, [], [])
    table, cells = approximate(rows, dim, bits)
    centroids, computed = refine(table, cells, np.array(starts, dtype=np.int64), rounds)
    return Clusters(assign(table, cells, centroids), centroids.tolist(), computed)


def first_by_hash(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """Vectors of the k rows whose id, after the salt, has the least sha256; null ids come last."""
    code = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r.vector) for r in rows.orderBy(code.asc_nulls_last(), "vector").select("vector").limit(k).collect()]
