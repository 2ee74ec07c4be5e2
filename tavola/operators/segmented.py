"""Ordered folds of long event histories, spread over tasks.

A cart event is a function on the quantity q (0 = not in the cart):
  add q -> q + 1; remove q -> 0; increase q -> q + 1 if q > 0; decrease q -> q - 1 (floor 0).
Each is of the form  q -> c if q <= t else q + d  (always c, where ``all`` is set),
and that form is closed under composition.  So a history can be folded in any
grouping of consecutive events:

1. Events are dealt to ranges of (key, time, id), so a key with a third of all events
   lies in many tasks.  A task composes its events, batch by batch, pair by pair, and
   gives one function for each key it holds.
2. What is left are as many functions as keys, and one more for each border that a key
   crosses.  They are dealt by key and composed in the order of the ranges.

No history is held as a whole: a task holds one batch and one function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = -1
FIELDS = ("all", "t", "c", "d")


def event_function(action: Column) -> list[Column]:
    """The four fields of an event's function."""
    t = (F.when(action == "increase", 0).when(action == "decrease", 1).otherwise(NEVER))
    d = (F.when(action.isin("add", "increase"), 1).when(action == "decrease", -1).otherwise(0))
    return [F.coalesce(action == "remove", F.lit(False)).alias("all"), t.cast("long").alias("t"),
            F.lit(0).cast("long").alias("c"), d.cast("long").alias("d")]


def compose(f: tuple, g: tuple) -> tuple:
    """g after f, for arrays of functions."""
    all1, t1, c1, d1 = f
    all2, t2, c2, d2 = g
    later = np.where(all2 | (c1 <= t2), c2, c1 + d2)
    return (all1 | all2, np.maximum(t1, t2 - d1), np.where(~all1 & (t2 - d1 > t1), c2, later), d1 + d2)


def fold_runs(function: tuple, start: np.ndarray) -> tuple:
    """One function for each run of rows; ``start`` marks the first row of each run.
    Neighbours are composed two by two, so n rows take log2(n) steps."""
    run = np.cumsum(start) - 1
    while len(run) and (np.diff(run) == 0).any():
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - first[run]        # runs are numbered without gaps
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(run[1:] == run[:-1], False)[left]
        a = tuple(x[left] for x in function)
        b = compose(tuple(x[left[paired]] for x in function), tuple(x[left[paired] + 1] for x in function))
        for x, y in zip(a, b):
            x[paired] = y
        function, run = a, run[left]
    return function


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Marks the rows whose key is not the key of the row before; nulls are equal."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[0] = True
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] |= ~(same | both)
    return out


def _folder(n_keys: int, names: list[str]):
    """Function of mapInArrow that folds ordered rows (keys, all, t, c, d) to one a key."""
    def out(keys: list, function: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(x) for x in function)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                             # the last key's function, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(names)
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            keys = batch.columns[:n_keys]
            start = _starts(keys)
            function = fold_runs(tuple(c.to_numpy(zero_copy_only=False).copy() for c in batch.columns[n_keys:]), start)
            pick = pa.array(np.flatnonzero(start))
            whole = out([k.take(pick) for k in keys], function)
            held = whole.slice(whole.num_rows - 1)
            yield whole.slice(0, whole.num_rows - 1)
        if held is not None:
            yield held
    return run


def fold_events(events: DataFrame, keys: list[str], order: list[str], action: str) -> DataFrame:
    """(keys, quantity): the quantity after all events of each key, in the given order."""
    rows = events.select(*keys, *order, *event_function(F.col(action)))
    names = [*keys, *FIELDS]
    schema = rows.select(*names).schema
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_range = (rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).select(*names)
                .mapInArrow(_folder(len(keys), names), schema)
                .withColumn("_range", F.spark_partition_id()))
    whole = (by_range.repartition(parts, *keys).sortWithinPartitions(*keys, "_range").select(*names)
             .mapInArrow(_folder(len(keys), names), schema))
    quantity = F.when(F.col("all") | (F.col("t") >= 0), F.col("c")).otherwise(F.col("d"))
    return whole.select(*keys, quantity.alias("quantity"))
