"""Training-order materialisation (operator 10).

Each packed sequence gets a slot in the training order by a keyed Feistel
permutation of the smallest power-of-four range that holds them all; a result
outside the range is permuted again until it lies inside (cycle-walking).  So
the slots 0..n-1 are used once each, and any slot can be computed from its
sequence, or the sequence from its slot, without a sort or a lookup.

Pieces go straight to the task of their slot's shard, a range of slots; there
each is put in its place, without a sort, in a table of the shard's fixed size,
and the task writes the shard as records of one fixed stride: slot s lies
in shard s // shard_rows at byte (s % shard_rows) * stride.  A reader that
stops after slot s starts again at s + 1 by one seek.  A record is the
sequence's ids in the vocabulary's unsigned width, filled up with ``PAD_ID``,
and the one line-feed byte that Spark's writer puts after a record, so a shard is an
array of ``Shards.record``, which numpy can map.  Shards are
written by Spark's committer, so a lost executor's task is run again and no
half shard is left.  A reader of a range of slots (``read_shards``), such as the rest of
a run that stopped, or one worker's share of it, opens only the shards of that range.

Defined results: an empty table writes no record; null texts, null ids,
repeated rows and very long documents are packed as ``packing`` says.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.bpe import load
from tavola.llm.packing import CLOSING_ID, WINDOW, cut_ids, cuts, encoded_stream, placed, stream_length
from tavola.llm.textscan import mix
from tavola.session import checkpoint_dir
from tavola.llm.workers import lean

KEY = 0x5EED
ROUNDS = 6
SHARD_ROWS = 4096
PAD_ID = 0


@dataclass(frozen=True)
class Permutation:
    """Keyed permutation of 0..n-1."""

    n: int
    key: int = KEY
    rounds: int = ROUNDS

    @property
    def half_bits(self) -> int:
        return max(1, ((max(self.n, 1) - 1).bit_length() + 1) // 2)

    def _scrambled(self, half: np.ndarray, turn: int) -> np.ndarray:
        salt = (self.key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % 2**64
        return mix(half ^ np.uint64(salt)) & np.uint64((1 << self.half_bits) - 1)

    def _step(self, value: np.ndarray, turns: range, back: bool) -> np.ndarray:
        bits = np.uint64(self.half_bits)
        left, right = value >> bits, value & np.uint64((1 << self.half_bits) - 1)
        for turn in turns:
            if back:
                left, right = right ^ self._scrambled(left, turn), left
            else:
                left, right = right, left ^ self._scrambled(right, turn)
        return left << bits | right

    def _walk(self, value, turns: range, back: bool) -> np.ndarray:
        out = self._step(np.asarray(value, dtype=np.uint64), turns, back)
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = self._step(out[outside], turns, back)
        return out.astype(np.int64)

    def slots(self, sequences) -> np.ndarray:
        """Slot of each sequence."""
        return self._walk(sequences, range(self.rounds), back=False)

    def sequences(self, slots) -> np.ndarray:
        """Sequence of each slot."""
        return self._walk(slots, range(self.rounds)[::-1], back=True)


@dataclass(frozen=True)
class Shards:
    """Where written shards lie and how to find a slot in them."""

    path: str
    order: Permutation
    total: int              # ids without padding
    window: int
    width: int              # bytes of an id
    shard_rows: int

    @property
    def stride(self) -> int:
        return self.window * self.width + 1

    @property
    def record(self) -> np.dtype:
        """A record of a shard: the ids and the byte after them."""
        return np.dtype([("ids", f"<u{self.width}", self.window), ("end", "u1")])

    def place(self, slot: int) -> tuple[int, int]:
        """Shard number and byte offset of a slot."""
        return slot // self.shard_rows, slot % self.shard_rows * self.stride

    def lengths(self, sequences: np.ndarray) -> np.ndarray:
        """Ids of each sequence without padding."""
        return np.minimum(self.total - sequences * self.window, self.window)


def _dealt(batches: Iterator[pa.RecordBatch], shards: Shards) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of documents, compressed together by shard: how many,
    their rows in the shard, offsets and lengths, and the ids of all."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        row, sequence, start, stop, offset = cuts(batch.column(0).to_numpy(), batch.column(1).to_numpy(), shards.window)
        slot = shards.order.slots(sequence)
        cut = cut_ids(batch.column(2), row, start, stop, shards.width)
        order = np.argsort(slot // shards.shard_rows, kind="stable")
        slot, offset, length = slot[order], offset[order], (stop - start)[order]
        shard = slot // shards.shard_rows
        begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        blobs = []
        for a, b in zip(begins, [*begins[1:], len(shard)]):
            head = np.stack([slot[a:b] % shards.shard_rows, offset[a:b], length[a:b]]).astype("<i4")
            blobs.append(squeeze(b"".join([np.int32(b - a).tobytes(), head.tobytes(), *(cut[i] for i in order[a:b])])))
        yield pa.RecordBatch.from_arrays([pa.array(shard[begins].astype(np.int32) if len(shard) else [], pa.int32()),
                                          pa.array(blobs, type=pa.binary())], names=["shard", "pieces"])


def _records(batches: Iterator[pa.RecordBatch], shards: Shards) -> Iterator[pa.RecordBatch]:
    """Records of one shard in slot order: each piece is put in its place."""
    dtype, unpack = np.dtype(f"<u{shards.width}"), zstandard.ZstdDecompressor().decompress
    table = None
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if table is None:
                rows = min(shards.shard_rows, shards.order.n - shard * shards.shard_rows)
                table = np.full((rows, shards.window), PAD_ID, dtype=dtype)
            raw = unpack(blob.as_py())
            n = int(np.frombuffer(raw, "<i4", 1)[0])
            row, offset, length = np.frombuffer(raw, "<i4", 3 * n, 4).reshape(3, n).tolist()
            ids, at = np.frombuffer(raw, dtype, -1, 4 + 12 * n), 0
            for r, o, k in zip(row, offset, length):
                table[r, o:o + k] = ids[at:at + k]
                at += k
    for a in range(0, 0 if table is None else len(table), 256):
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in table[a:a + 256]], type=pa.binary())],
                                         names=["record"])


def write_shards(docs: DataFrame, tokenizer: str, key: int = KEY, shard_rows: int = SHARD_ROWS,
                 window: int = WINDOW, closing_id: int = CLOSING_ID, path: str | None = None) -> Shards:
    """Pack ``docs`` and write all sequences in training order."""
    spark = docs.sparkSession
    stream = encoded_stream(docs, tokenizer, closing_id)
    total = stream_length(stream)
    order = Permutation(-(-total // window), key)
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    shards = Shards(path, order, total, window, load(tokenizer).dtype.itemsize, shard_rows)

    (placed(stream).select("n", "place", "ids")
     .mapInArrow(lean(functools.partial(_dealt, shards=shards)), "shard int, pieces binary")
     .repartitionById(max(1, -(-order.n // shard_rows)), F.col("shard"))
     .mapInArrow(lean(functools.partial(_records, shards=shards)), "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path))      # one file a shard
    return shards


def read_shards(spark: SparkSession, shards: Shards, first_slot: int = 0, stop_slot: int | None = None,
                with_ids: bool = False) -> DataFrame:
    """One row per sequence from ``first_slot`` on, and before ``stop_slot`` if it is
    given, as the shards hold it: sequence_id, slot, shard, byte_offset, length, ids_crc32
    (of the ids without padding as little-endian unsigned 32-bit integers) and, if wanted,
    ids.  The rows of a shard are in the order of their slots.  The shards are chosen by
    file name alone, so Spark drops the other files when it lists them."""
    stop_slot = shards.order.n if stop_slot is None else min(stop_slot, shards.order.n)
    first = first_slot // shards.shard_rows
    last = (stop_slot - 1) // shards.shard_rows if first_slot < stop_slot else first - 1
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    files = (spark.read.format("binaryFile").load(shards.path)
             .where(number.between(first, last))
             .where("length > 0").select(number.alias("shard"), "content"))
    fields = "sequence_id long, slot long, shard int, byte_offset long, length long, ids_crc32 long"
    if with_ids:
        fields += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = np.frombuffer(content.as_buffer(), dtype=shards.record)
                begin = shard * shards.shard_rows
                row = np.arange(max(0, first_slot - begin), min(len(records), stop_slot - begin))
                ids = records["ids"][row]
                slot = begin + row
                sequence = shards.order.sequences(slot)
                length = shards.lengths(sequence)
                crc = [zlib.crc32(r[:n].astype("<u4")) for r, n in zip(ids, length.tolist())]
                columns = [pa.array(sequence), pa.array(slot), pa.array(np.full(len(slot), shard, dtype=np.int32)),
                           pa.array(row * shards.stride), pa.array(length), pa.array(crc, type=pa.int64())]
                if with_ids:
                    columns.append(pa.array([r[:n].astype(np.int32) for r, n in zip(ids, length.tolist())], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    return files.mapInArrow(lean(run), fields)
