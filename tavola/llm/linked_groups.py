"""Links inside groups of any size, without all pairs of a group (helper of operator 13).

Rows (key, node, size, payload) stand in groups by ``key``.  A function tells which
rows of a table are linked; what is wanted is a forest of links that connects, in each
group, all that links connect.  A group of at most ``limit`` (the sum of its sizes) is
one task's work.  A larger one is cut into chunks.  First each chunk meets the group's
leader (its smallest node) and is connected inside; in a group of near copies that
connects nearly all.  Only chunks that hold nodes outside the leader's class, in full,
then meet the nodes that are left, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.components import components
from tavola.llm.workers import lean


def forest(count: int, linked: Callable[[int, np.ndarray], np.ndarray], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all connected ones of ``count`` rows, from breadth-first
    search; ``linked(i, others)`` tells which of the others row i is linked with.  A
    row that is reached is asked no more, so a group of near copies takes one step."""
    a, b = [], []
    left = np.delete(np.arange(count), first) if count else np.arange(0)
    queue = [first]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        hit = linked(i, left)
        new = left[hit]
        if len(new):
            a.append(np.full(len(new), i))
            b.append(new)
            queue.extend(new.tolist())
            left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.arange(0), np.arange(0))


def _runs(rows: DataFrame, keys: list[str], solve, parts: int) -> DataFrame:
    """Links (key, a, b) of the groups by ``keys``, which follow each other in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def settle() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(table.column("node").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            node = table.column("node").to_numpy()
            if len(node) > 1 and node[0] != node[-1]:
                once = np.append(True, node[1:] != node[:-1])       # the leader may come twice
                table, node = table.filter(pa.array(once)), node[once]
                a, b = solve(table)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), now[0])), pa.array(node[a]), pa.array(node[b])],
                                                 names=["key", "a", "b"])

        for batch in batches:
            marks = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(len(keys))])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                key = tuple(marks[:, x].tolist())
                if key != now and held:
                    yield from settle()
                    held.clear()
                now = key
                held.append(batch.slice(x, y - x))
        if held:
            yield from settle()

    return (rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "key long, a long, b long"))


def links(rows: DataFrame, solve: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], limit: int) -> DataFrame:
    """Written links (key, a, b) inside the groups of rows (key long, node long, size long, ...).

    ``solve`` takes a table of the columns but key and size, ordered by node, and
    returns row numbers of links that connect all connected rows of it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [c for c in rows.columns if c not in ("key", "size")]
    sizes = written(rows.groupBy("key").agg(F.ceil(F.sum("size") / limit).cast("int").alias("chunks"),
                                            F.min("node").alias("leader")), "group-sizes")
    small = _runs(rows.join(sizes.where("chunks = 1"), "key", "left_semi").select("key", *more), ["key"], solve, parts)
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return written(small, "group-links")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    chunked = written(rows.join(large, "key").withColumn("chunk", chunk).select("key", "chunk", "leader", "chunks", *more), "chunked")
    lead = (chunked.where("node = leader").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("key", "chunk", *more))
    inside = written(_runs(chunked.select("key", "chunk", *more).unionByName(lead), ["key", "chunk"], solve, parts), "inside")
    # nodes that are not yet in their leader's class meet all chunks
    pair = inside.select(*(F.struct("key", F.col(c).alias("node")).alias(c) for c in "ab"))
    classes = components(pair).select("node.key", "node.node", F.col("component.node").alias("class"))
    leads = large.select("key", F.col("leader").alias("node")).join(classes, ["key", "node"]).select("key", F.col("class").alias("main"))
    far = (chunked.select("key", "node").join(classes, ["key", "node"], "left").join(leads, "key", "left")
           .where("class IS NULL OR main IS NULL OR class <> main").select("key", "node"))
    far = written(far, "far")
    if far.isEmpty():
        return written(small.unionByName(inside), "group-links")
    rest = chunked.join(far, ["key", "node"], "left_semi").withColumn("other", F.col("chunk"))
    meet = far.join(large, "key").select("key", chunk.alias("other")).distinct()     # chunks that hold a far node
    left = chunked.join(meet, "key").select("key", "chunk", "other", *more)
    right = (rest.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> other")
             .select("key", "chunk", "other", *more))
    across = _runs(left.unionByName(right), ["key", "chunk", "other"], solve, parts)
    return written(small.unionByName(inside).unionByName(across), "group-links")
