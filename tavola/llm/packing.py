"""Concatenate and cut: pack the token ids of documents into sequences (operator 8).

Two passes.  The first encodes each document once and writes its ids with the
place where they start among the ids of its partition.  One row per partition
with its total then gives, by a prefix sum, the place where each partition
starts in the whole stream.  The second pass cuts the stream at every multiple
of the window: row by row each document is split where windows meet, and each
piece records its document, its place there and its place in its sequence.
No document is moved and nothing is shuffled but the totals.

Defined results: a null or empty text has only the closing id, a row with a
null doc_id is packed under that null, repeated rows are packed once each, a
document longer than the window spreads over as many sequences as it needs, an
empty table gives no piece, and other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.bpe import load
from tavola.llm.common import written
from tavola.llm.workers import lean

WINDOW = 2048
CLOSING_ID = 1
STREAM_SCHEMA = "part int, at long, doc_id long, n long, ids binary"


def encoded_stream(docs: DataFrame, tokenizer: str, closing_id: int = CLOSING_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: one written row per document with its ids (each of the
    vocabulary's smallest unsigned width) and its place ``at`` in its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = load(tokenizer), TaskContext.get().partitionId(), 0
        close = np.array([closing_id], dtype=bpe.dtype)
        for batch in batches:
            rows = [np.concatenate([ids, close]) for ids in bpe.encode_batch(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(at + np.cumsum(n) - n),
                 batch.column(0), pa.array(n), pa.array([r.tobytes() for r in rows], type=pa.binary())],
                names=["part", "at", "doc_id", "n", "ids"])
            at += int(n.sum())

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(picked.mapInArrow(lean(run), STREAM_SCHEMA), "stream")


def placed(stream: DataFrame) -> DataFrame:
    """Add ``place``, the document's first id in the whole stream: a prefix sum
    over one total per partition.  The sums are
    written, so Spark sees how small they are and the stream stays where it is."""
    totals = stream.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return stream.join(written(starts, "places"), "part").withColumn("place", F.col("base") + F.col("at"))


def stream_length(stream: DataFrame) -> int:
    """Ids of the whole stream: one number."""
    return stream.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def cuts(n: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, sequence, start, stop, offset) of the pieces of documents with n ids
    from ``place`` on: a piece is ids start to stop of its row, at ``offset``."""
    first, last = place // window, (place + n - 1) // window
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(sequence * window, place[row])
    end = np.minimum((sequence + 1) * window, (place + n)[row])
    return row, sequence, begin - place[row], end - place[row], begin - sequence * window


def cut_ids(ids: pa.Array, row, start, stop, width: int) -> list[memoryview]:
    """Stored bytes of each piece."""
    return [memoryview(ids[r].as_buffer())[a * width:b * width]
            for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]


def pieces(stream: DataFrame, width: int, window: int = WINDOW) -> DataFrame:
    """Second pass: boundary records, one row per document and window it touches.
    ``width`` is the bytes of a stored id."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, place = (batch.column(i).to_numpy() for i in (1, 2))
            row, sequence, start, stop, offset = cuts(n, place, window)
            crc = [zlib.crc32(np.frombuffer(c, dtype=f"<u{width}").astype("<u4"))
                   for c in cut_ids(batch.column(3), row, start, stop, width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - start),
                 pa.array(crc, type=pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(offset)],
                names=[f.split()[0] for f in fields.split(", ")])

    return placed(stream).select("doc_id", "n", "place", "ids").mapInArrow(lean(run), fields)


def padded_length(filled: Column, window: int = WINDOW) -> Column:
    """Length that a sequence is stored with: the window, or its own length
    where that is a power of two."""
    power = (filled > 0) & (filled.bitwiseAND(filled - 1) == 0)
    return F.when(power, filled).otherwise(F.lit(window).cast("long"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of all documents, with the length each piece's sequence is padded to."""
    stream = encoded_stream(docs, tokenizer, closing_id)
    total = stream_length(stream)
    rest = F.lit(total) - F.col("sequence_id") * window
    filled = F.least(rest, F.lit(window).cast("long"))
    return pieces(stream, load(tokenizer).dtype.itemsize, window).withColumn("padded_length", padded_length(filled, window))
