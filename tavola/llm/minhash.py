"""Near-duplicates by b-bit MinHash (operator 13).

Two documents are linked when the sets of their distinct word shingles have a
similarity of ``percent`` or more.

1. Equal sets are one set, known by a 128-bit signature.  Each set has ``BANDS * ROWS``
   minima.  A band is the hash of ROWS full minima; of every minimum the lowest ``BITS``
   bits are kept and packed.
2. Candidates are sets that agree in a band.  Sets of similarity s share one with
   probability 1 - (1 - s ** ROWS) ** BANDS: at 0.8 one link in twenty million is missed.
3. In a band's group the packed bits are compared.  Of unlike minima one in 2 ** BITS agrees by chance, so
   with a share m of equal positions the similarity is estimated as (m - c) / (1 - c), c = 2 ** -BITS.
   An estimate within ``SIGMAS`` standard errors of the threshold passes.  A forest of the
   passing pairs is kept, not the pairs (``linked_groups``).
4. The forests' classes are the groups that can hold links.  There the full sets are
   compared: a pair is a link only by its exact intersection and union.

What is sent by band is a hash, a node and the packed bits; full sets are made again
from the texts, once a set, for those that are left.

Defined results: a text of fewer words than ``words`` has its whole sequence as its one
shingle; a null text, or one without words, has an empty set and is linked with
nothing; repeated rows are linked; a row with a null doc_id has a null component if it
stands alone and never names one; the order of rows plays no part; columns other than
doc_id and text are not looked at; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.components import components
from tavola.llm.linked_groups import forest, links
from tavola.llm.ngram_join import shingle_sets
from tavola.llm.textscan import mix
from tavola.llm.workers import lean

WORDS = 4
PERCENT = 80
BANDS, ROWS = 32, 4
BITS = 4
SIGMAS = 5
SIGNATURES = 1 << 17     # signatures that a task compares at once, of BANDS * ROWS * BITS bits
SHINGLES = 1 << 22       # shingles of full sets that a task compares at once
TEXTS = 500              # looked at together
SLICE = 1 << 13          # shingles hashed at once

_SEEDS = np.random.Generator(np.random.PCG64(13)).integers(0, 2**63, size=BANDS * ROWS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hashes over a set of shingle hashes."""
    out = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), SLICE):
        part = shingles[at:at + SLICE]
        np.minimum(out, mix(part[None, :] ^ _SEEDS[:, None]).min(axis=1), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """One hash a band; the band's number is part of it."""
    rows = least.reshape(*least.shape[:-1], BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[..., r])
    return total.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, bit by bit in planes of 64-bit words."""
    planes = (least[..., None, :] >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1)).astype(bool)
    return np.packbits(planes, axis=-1, bitorder="little").reshape(*least.shape[:-1], -1).view("<u8")


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed minima with each of others, corrected for collisions."""
    unlike = (others ^ one).reshape(len(others), BITS, -1)
    different = np.bitwise_count(np.bitwise_or.reduce(unlike, axis=1)).sum(axis=1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return ((len(_SEEDS) - different) / len(_SEEDS) - chance) / (1 - chance)


def passing(percent: int) -> float:
    """Least estimate of a pair that is compared in full."""
    s, chance = percent / 100, 2.0 ** -BITS
    agree = s + (1 - s) * chance
    return s - SIGMAS * np.sqrt(agree * (1 - agree) / len(_SEEDS)) / (1 - chance)


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _text_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Written (doc_id, n, signature, bands, bits, text_hash) of all documents; bands and bits
    once for equal sets that a task has just seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            codes = [_signature(s) for s in sets]
            band, bits = [], []
            for s, code in zip(sets, codes):
                if not len(s) or code in seen:
                    band.append(None)
                    bits.append(None)
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(code)
                least = minima(s)
                band.append(bands(least))
                bits.append(packed(least).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(codes, pa.binary()),
                 pa.array(band, pa.list_(pa.int64())), pa.array(bits, pa.binary()), batch.column(2)],
                names=["doc_id", "n", "signature", "bands", "bits", "text_hash"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         _text_hash(F.col("text").cast("string")).alias("text_hash"))
    return written(picked.mapInArrow(lean(run), "doc_id long, n long, signature binary, bands array<long>, bits binary, text_hash binary"),
                   "signed")


def _similar_bits(percent: int):
    """Links of sets whose estimate passes and whose sizes allow the similarity."""
    bar = passing(percent)

    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(table.num_rows, -1)
        n = table.column("n").to_numpy()

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
            return (100 * small >= percent * large) & (estimate(bits[i], bits[others]) >= bar)
        return forest(table.num_rows, linked)
    return solve


def _similar_sets(percent: int):
    """Links of sets by their exact intersection and union."""
    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = table.column("shingles").combine_chunks()
        n = np.diff(column.offsets.to_numpy())
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        flat = column.flatten().to_numpy()
        known, number = np.unique(flat, return_inverse=True)
        mine = np.zeros(len(known), dtype=np.int64)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
            out = 100 * small >= percent * large
            pick = others[out]
            if len(pick):
                mine[number[starts[i]:starts[i] + n[i]]] = 1
                if len(pick) * 4 > len(n):
                    shared = np.add.reduceat(mine[number], starts)[pick]
                else:
                    shared = np.array([mine[number[starts[j]:starts[j] + n[j]]].sum() for j in pick.tolist()])
                mine[number[starts[i]:starts[i] + n[i]]] = 0
                out[out] = 100 * shared >= percent * (n[i] + n[pick] - shared)
            return out
        return forest(table.num_rows, linked)
    return solve


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Written (node, key, n, shingles) of the sets (node, key, signature, text_hash), from their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingle_sets(batch.column(3).to_pylist(), words)
            good = [i for i, (s, code) in enumerate(zip(sets, batch.column(2).to_pylist())) if _signature(s) == code]
            pick = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array([len(sets[i]) for i in good], pa.int64()),
                 pa.array([sets[i].view(np.int64) for i in good], pa.list_(pa.int64()))], names=["node", "key", "n", "shingles"])

    texts = (docs.select(F.col("text").cast("string").alias("text")).withColumn("text_hash", _text_hash(F.col("text")))
             .join(wanted, "text_hash").groupBy("node").agg(F.first("key").alias("key"), F.first("signature").alias("signature"),
                                                            F.first("text").alias("text")))
    return written(texts.select("node", "key", "signature", "text")
                   .mapInArrow(lean(run), "node long, key long, n long, shingles array<long>"), "full-sets")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, signatures: int = SIGNATURES,
                    shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of documents (doc_id, text)."""
    rows = signed(docs, words)
    sets = written(rows.where("n > 0").groupBy("signature")
                   .agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands", True).alias("bands"),
                        F.first("bits", True).alias("bits"), F.min("text_hash").alias("text_hash"))
                   .withColumn("node", F.monotonically_increasing_id()), "sets")
    banded = sets.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    banded = (banded.join(shared, "key", "left_semi").join(sets.select("node", "n", "bits"), "node")
              .withColumn("size", F.lit(1).cast("long")))
    near = links(banded, _similar_bits(percent), signatures).select("a", "b").distinct()
    groups = components(near).withColumnRenamed("component", "key")
    full = _full_sets(docs, groups.join(sets.select("node", "signature", "text_hash"), "node"), words)
    found = links(full.withColumn("size", F.col("n")), _similar_sets(percent), shingles).select("a", "b")
    # the least id of each class; equal sets are one node
    classes = components(found).join(sets.select("node", "signature", "least"), "node")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(classes.join(least, "component").select("signature", "component_id").unionByName(
        sets.join(classes.select("signature"), "signature", "left_anti").select("signature", F.col("least").alias("component_id"))),
        "classes")
    component = F.coalesce("component_id", "doc_id")
    return (rows.select("doc_id", "n", "signature").join(named, "signature", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
