"""State kept in bucket folders, of which a change rewrites only those it touches.

A state table is a folder of Parquet files partitioned by ``bucket``, a hash of its
key.  Changes name their keys, so they name their buckets: only those are read (the
others are pruned by partition), changed by a lifecycle operator, and overwritten
(dynamic partition overwrite).  A change table that Spark finds small is broadcast to
the buckets' rows, which then do not move at all.

Tables with the same key and number of buckets are changed together, as orders and
their items are.  The new rows are written to the checkpoint folder before any bucket
is replaced, so a lost executor repeats a copy, never a change.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.session import cut_lineage

BUCKETS = 64


@dataclass(frozen=True)
class StateTable:
    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> StateTable:
        self._write(rows, "static")
        return self

    def read(self, touched: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).drop("bucket")

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the keys of changes: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def replace(self, rows: DataFrame) -> None:
        self._write(rows, "dynamic")

    def _write(self, rows: DataFrame, mode: str) -> None:
        (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path))


def apply_changes(states: list[StateTable], changes: DataFrame, operator: Callable) -> list[int]:
    """Replace the buckets that ``changes`` touch by what the operator makes of them.

    ``operator`` takes the touched rows of each state and the changes and returns the new
    rows of each state, a DataFrame or a tuple.  A bucket of which no row is left keeps
    one empty file.  Returns the touched buckets."""
    if len({(s.key, s.buckets) for s in states}) != 1:
        raise ValueError("states that change together have one key and one number of buckets")
    touched = states[0].touched(changes)
    if not touched:
        return touched
    new = operator(*[s.read(touched) for s in states], changes)
    rows = [cut_lineage(n.select(*s.read().columns)) for s, n in zip(states, new if isinstance(new, tuple) else (new,))]
    for state, r in zip(states, rows):
        state.replace(r)
        there = {x[0] for x in r.select(state.bucket().alias("b")).distinct().collect()}
        for b in set(touched) - there:          # nothing was written for it, so the old rows are still there
            empty = state.spark.createDataFrame([], r.schema)
            empty.coalesce(1).write.mode("overwrite").parquet(f"{state.path}/bucket={b}")
    return touched
