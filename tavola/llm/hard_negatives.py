"""Hard negatives by rotated one-bit codes (operator 11).

Nearness is the inner product of integer vectors.  An anchor's positives are its k
nearest rows of the same label; a positive's hard negatives are the nearest rows of
another label whose score lies between two percentages of the positive's.

1. Each vector x is rotated by a fixed random rotation to y.  Its code is the sign of
   each component, a unit vector u, one bit a dimension.  Beside the code stand the
   alignment a = <y, u>, the length r of the residual y - a u, and the vector's length.
2. A query is rotated too and its components rounded to ``PLANES`` bits.  Its product
   with u is then a weighted sum of bit counts, t, off by at most the length e of what
   rounding took away.  As the residual is orthogonal to u, the Cauchy-Schwarz
   inequality bounds the rest: <x, q> = a t + at most a e + r sqrt(|q|^2 - <q, u>^2).  No probability
   is in this interval; only float rounding is added to it.
3. A row stays a candidate of an anchor while its interval meets one of the anchor's
   windows above the worst score that the window's best k have so far.  Candidates
   are scored in integers, and only such scores decide.

Rows are dealt to shards of bounded size.  A task holds one shard, codes and packed
vectors, and the anchors of a block stream past it, so its memory depends neither on
the table nor on the number of anchors; per anchor, window and shard k rows leave it.
Shards and blocks are as many as move the fewest bytes for the tasks wanted.  First
the positives are searched, then, with the windows known, the negatives.

Defined results: rows with a null id or label and the vectors that
``vectors.integer_rows`` leaves out take no part; several rows with one id count as one
(the smallest label, then vector); vectors meet only vectors of their own length; a
positive with a score below 0 has no negatives; ties go to the smaller id; with fewer
rows than wanted all are returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.vectors import matrix
from tavola.llm.workers import lean

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95           # per cent of the positive's score
PLANES = 4                   # bits of a query's rounded components
SHARD_VALUES = 1 << 24       # components that a task holds, 64 MB
TASK_VALUES = 1 << 18        # components that are worth a task of their own
CHUNK = 8192                 # rows, and
ANCHORS = 64                 # anchors, that are compared at once
FAR = 1 << 62
SLACK = 1e-9                 # of the product of two lengths, for float rounding

CODED = "vec_id long, label long, dim int, vector binary, code binary, along double, rest double, norm double"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    width = max(8, -(-packed.shape[-1] // 8) * 8)
    out = np.zeros((*packed.shape[:-1], width), dtype=np.uint8)
    out[..., :packed.shape[-1]] = packed
    return out.view("<u8")


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment, length of the residual, and length of integer vectors."""
    y = x.astype(np.float64) @ rotation(x.shape[1]).T
    along = np.abs(y).sum(axis=1) / np.sqrt(max(x.shape[1], 1))
    square = np.einsum("nd,nd->n", y, y)
    return _words(y > 0), along, np.sqrt(np.maximum(square - along * along, 0.0)), np.sqrt(square)


class Queries:
    """Rotated queries in bit planes."""

    def __init__(self, x: np.ndarray):
        n, self.dim = x.shape
        y = x.astype(np.float64) @ rotation(self.dim).T
        low = y.min(axis=1, initial=0.0)
        self.step = (y.max(axis=1, initial=0.0) - low) / ((1 << PLANES) - 1)
        self.step[self.step == 0] = 1.0
        level = np.rint((y - low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = level * self.step[:, None] + low[:, None]
        self.error = np.linalg.norm(y - rounded, axis=1)
        self.square = np.einsum("nd,nd->n", y, y)
        self.planes = _words((level[:, None, :] >> np.arange(PLANES)[None, :, None] & 1).astype(bool))
        # sum of code * rounded = 2 * (sum over set bits) - sum of all
        self.low, self.total = low, rounded.sum(axis=1)

    def interval(self, code: np.ndarray, ones: np.ndarray, along: np.ndarray, rest: np.ndarray,
                 norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of each query with each coded row."""
        bits = np.zeros((len(self.low), len(code)))
        for plane in range(PLANES):
            count = np.zeros(bits.shape, dtype=np.uint16)
            for w in range(code.shape[1]):
                count += np.bitwise_count(self.planes[:, plane, w, None] & code[None, :, w])
            bits += float(1 << plane) * count
        t = 2 * (bits * self.step[:, None] + self.low[:, None] * ones) - self.total[:, None]
        t /= np.sqrt(max(self.dim, 1))
        sure = np.maximum(np.abs(t) - self.error[:, None], 0.0)
        half = along * self.error[:, None] + rest * np.sqrt(np.maximum(self.square[:, None] - sure * sure, 0.0))
        half += SLACK * norm * np.sqrt(self.square)[:, None] + 1e-6
        t *= along
        return t - half, t + half


class Shard:
    """Coded rows of one length, and the search of the best of each window."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, code: np.ndarray, along: np.ndarray,
                 rest: np.ndarray, norm: np.ndarray):
        self.ids, self.labels, self.vectors, self.code = ids, labels, vectors, code
        self.along, self.rest, self.norm = along, rest, norm
        self.ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64).astype(float)
        self.pairs = self.scored = 0        # pairs of rows and anchors, and how many of them were scored

    def search(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
               same: bool) -> tuple[np.ndarray, ...]:
        """(anchor, window, row id, score) of the k best rows of each window
        [low, high] of each anchor, among rows of the same label or of other labels."""
        query, best = Queries(x), _Best(low, high, k)
        bound = np.abs(x).max(initial=0) * float(max(x.shape[1], 1)) * np.abs(self.vectors).max(initial=0)
        number = np.float64 if bound < 2.0 ** 53 else np.int64        # both exact
        for at in range(0, len(self.ids), CHUNK):
            part = slice(at, at + CHUNK)
            least, largest = query.interval(self.code[part], self.ones[part], self.along[part], self.rest[part], self.norm[part])
            open_pairs = (self.labels[part][None, :] == labels[:, None]) == same
            open_pairs &= self.ids[part][None, :] != ids[:, None]
            self.pairs += int(open_pairs.sum())
            open_pairs &= (largest >= best.floor.min(axis=1, initial=FAR)[:, None])
            open_pairs &= (least <= high.max(axis=1, initial=-FAR)[:, None])
            rows = np.flatnonzero(open_pairs.any(axis=0))
            if not len(rows):
                continue
            open_pairs = open_pairs[:, rows]
            self.scored += int(open_pairs.sum())
            scores = x.astype(number) @ self.vectors[part][rows].astype(number).T
            best.offer(scores, open_pairs, self.ids[part][rows])
        return best.rows()


class _Best:
    """The k best scores of each anchor's windows so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), -FAR, dtype=np.int64)
        self.ids = np.full((*low.shape, k), FAR, dtype=np.int64)
        self.floor = low.copy()             # a score below changes nothing

    def offer(self, scores: np.ndarray, there: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            fits = there & (scores >= self.floor[:, w, None]) & (scores <= self.high[:, w, None])
            many = np.flatnonzero(fits.sum(axis=1) > 4 * self.k)
            if len(many):       # only scores from the k-th best on
                held = np.where(fits[many], scores[many], -FAR)
                kth = np.partition(held, held.shape[1] - self.k, axis=1)[:, held.shape[1] - self.k]
                fits[many] &= held >= kth[:, None]
            anchor, row = np.nonzero(fits)
            if not len(anchor):
                continue
            touched = np.unique(anchor)
            all_anchor = np.concatenate([anchor, np.repeat(touched, self.k)])
            all_score = np.concatenate([scores[anchor, row].astype(np.int64), self.scores[touched, w].ravel()])
            all_id = np.concatenate([ids[row], self.ids[touched, w].ravel()])
            order = np.lexsort((all_id, -all_score, all_anchor))
            first = np.searchsorted(all_anchor[order], touched)
            pick = order[first[:, None] + np.arange(self.k)]
            self.scores[touched, w], self.ids[touched, w] = all_score[pick], all_id[pick]
            self.floor[:, w] = np.maximum(self.low[:, w], self.scores[:, w, -1])

    def rows(self) -> tuple[np.ndarray, ...]:
        anchor, window, place = np.nonzero(self.ids != FAR)
        return anchor, window, self.ids[anchor, window, place], self.scores[anchor, window, place]


def coded(rows: DataFrame) -> DataFrame:
    """Written rows (vec_id, label, dim, vector, code, along, rest, norm) of rows
    (vec_id, label, vector: array<long>), one an id."""
    names = [f.split()[0] for f in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                pick = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(pick))
                x = matrix(part.column(3), dim)
                code, along, rest, norm = encode(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(along), pa.array(rest), pa.array(norm)],
                    names=names)

    one = (rows.where("vec_id IS NOT NULL AND label IS NOT NULL")
           .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
           .groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")))
    return written(one.select("vec_id", "row.label", F.size("row.vector").alias("dim"), "row.vector")
                   .mapInArrow(lean(run), CODED), "coded")


def _grid(table: DataFrame, is_anchor: Column, tasks: int) -> DataFrame:
    """(dim, shards, blocks, first): how the rows and the anchors of a length are dealt,
    and the number of its first cell."""
    sizes = table.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(is_anchor.cast("long")).alias("anchors")).where("anchors > 0")
    values = F.col("n") * F.greatest("dim", F.lit(1))
    wanted = F.least(F.lit(tasks), F.ceil(values / TASK_VALUES))
    shards = F.greatest(F.ceil(values / SHARD_VALUES), F.floor(F.sqrt(wanted * F.col("n") / F.col("anchors"))))
    shards = F.least(shards, F.greatest(F.ceil(values / SHARD_VALUES), wanted))
    sizes = sizes.withColumn("shards", shards.cast("int"))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.lit(tasks) * F.least(F.lit(1.0), values / TASK_VALUES / tasks)
                                                                   / F.col("shards"))).cast("int"))
    cells = F.col("shards") * F.col("blocks")       # few lengths, hence few rows in this window
    return sizes.select("dim", "shards", "blocks", (F.sum(cells).over(Window.orderBy("dim")) - cells).cast("int").alias("first"), cells.alias("cells"))


def _search(table: DataFrame, anchors: DataFrame, grid: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(anchor_id, w, vec_id, score): best rows, by shard, of anchors (the columns of
    ``table`` and ``windows``, array of (w, score)); a window without a score is open."""
    spread = F.xxhash64("vec_id")
    here = grid.withColumn("cells", F.col("shards") * F.col("blocks"))
    place = F.col("first") + F.col("shard") * F.col("blocks") + F.col("block")
    shard, block = F.pmod(spread, F.col("shards")).cast("int"), F.pmod(F.shiftright(spread, 32), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))      # noqa: E731
    windows = "array<struct<w:int,score:long>>"
    rows = (table.join(here, "dim").withColumn("shard", shard).withColumn("block", every("blocks"))
            .select(place.alias("cell"), F.lit(0).alias("kind"), *table.columns, F.lit(None).cast(windows).alias("windows")))
    asking = (anchors.join(here, "dim").withColumn("block", block).withColumn("shard", every("shards"))
              .select(place.alias("cell"), F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(c) if c == "code" else F.col(c)
                                                                      for c in table.columns), F.col("windows").cast(windows).alias("windows")))
    parts = grid.agg(F.sum("cells")).first()[0] or 1

    def shard_of(pieces: list[pa.RecordBatch]) -> Shard:
        whole = pa.Table.from_batches(pieces)
        n, dim = whole.num_rows, whole.column("dim")[0].as_py()

        def packed(name: str, kind: str, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(whole.column(name).to_pylist()), kind).reshape(n, width)

        plain = [whole.column(c).to_numpy() for c in ("vec_id", "label", "along", "rest", "norm")]
        return Shard(*plain[:2], packed("vector", "<i4", dim), packed("code", "<u8", max(1, -(-dim // 64))), *plain[2:])

    def answer(held: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dim = held.vectors.shape[1]
        for at in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(at, ANCHORS)
            n, asked = part.num_rows, part.column("windows").to_pylist()
            x = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i4").reshape(n, dim).astype(np.int64)
            width = max(map(len, asked))
            lows, highs = np.full((n, width), FAR, np.int64), np.full((n, width), -FAR, np.int64)
            number = np.zeros((n, width), np.int32)
            for i, ws in enumerate(asked):
                for j, w in enumerate(ws):
                    number[i, j] = w["w"]
                    s = w["score"]
                    lows[i, j], highs[i, j] = (-FAR + 1, FAR - 1) if s is None else (-(-low * s // 100), high * s // 100)
            ids = part.column("vec_id").to_numpy()
            anchor, window, found, score = held.search(ids, part.column("label").to_numpy(), x, lows, highs, k, same)
            yield pa.RecordBatch.from_arrays([pa.array(ids[anchor]), pa.array(number[anchor, window]), pa.array(found), pa.array(score)],
                                             names=["anchor_id", "w", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, held = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, cell = batch.slice(a, b - a), int(key[a]) >> 1
                if cell != now:
                    now, gathered, held = cell, [], None
                if not key[a] & 1:
                    gathered.append(part)
                elif gathered or held:
                    if held is None:
                        held, gathered = shard_of(gathered), []
                    yield from answer(held, part)

    return (rows.unionByName(asking).repartitionById(int(parts), F.col("cell")).sortWithinPartitions("cell", "kind")
            .mapInArrow(lean(run), "anchor_id long, w int, vec_id long, score long"))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows
    (vec_id, label, vector: array<long>); ``is_anchor`` is a condition on ``vec_id``."""
    if not 0 <= low <= high:
        raise ValueError("the window must satisfy 0 <= low <= high")
    table = coded(rows)
    grid = written(_grid(table, is_anchor, 2 * rows.sparkSession.sparkContext.defaultParallelism), "grid")
    anchors = table.where(is_anchor)
    open_window = F.array(F.struct(F.lit(0).alias("w"), F.lit(None).cast("long").alias("score")))
    near = _search(table, anchors.withColumn("windows", open_window), grid, positives, True, low, high)
    near = written(_ranked(near, ["anchor_id"], positives)
                   .select("anchor_id", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"),
                           F.col("score").alias("positive_score")), "positives")
    windows = (near.where("positive_score >= 0").groupBy("anchor_id")
               .agg(F.collect_list(F.struct("w", F.col("positive_score").alias("score"))).alias("windows"))
               .withColumnRenamed("anchor_id", "vec_id"))
    found = _search(table, anchors.join(windows, "vec_id").select(*table.columns, "windows"), grid, negatives, False, low, high)
    return (_ranked(found.join(near, ["anchor_id", "w"]), ["anchor_id", "positive_id"], negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
