"""Repeated passages by common-prefix intervals of a suffix array (operator 4).

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else in the table is found, and can be removed.

1. Anchors.  Of every run of ``length`` bytes the leftmost smallest hash of its
   strings of ``length // 4`` bytes is taken (winnowing), so equal runs have equal
   anchors at equal places.  Anchors are one row per about 150 bytes.
2. Only anchors whose fingerprint stands at two places of the table go on; with
   each goes the text around it, at most ``length`` bytes to either side.
3. Per fingerprint the texts to the right are sorted: an enhanced suffix array of
   the anchors with the common prefixes of neighbours.  A stack scan yields the
   tree of its common-prefix intervals.  For each interval the left extensions of
   its members are compared: where they are diverse the interval is a maximal
   repeat, and each member is extended to the left as far as it agrees with
   another member.  All members of an interval are reported, not just neighbours.
   Repeats of ``length`` bytes and more are the spans.

Texts are known by a 128-bit digest, so copies of one text are worked on once a
task, and a text that is there twice is covered as a whole.  Within a task equal
surroundings are settled at once and only one of them is sent on, so a passage
that a third of the documents share does not gather in one task; a fingerprint
in more than ``hot`` different texts is settled by counting hashes of all its
windows instead, which Spark adds up before it shuffles.  Nothing is left out.

Defined results: a null text is empty; texts shorter than ``length`` are
untouched; overlapping repeats count; no document gives no row; columns other
than the answers, which replace columns of the same names, stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.textscan import mix
from tavola.llm.workers import lean

LENGTH = 400
HOT = 20_000             # texts with a fingerprint that one task sorts at most
COMMON, COMMON_ROWS = 10_000, 1000   # at most so many fingerprints, of over so many anchors, join without a shuffle
SLICE = 1 << 18          # bytes hashed at once
KNOWN = 100_000          # surroundings or texts that a task remembers
BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on."""
    size = 1 << max(19, (len(buf) - 1).bit_length())
    power, inverse = _powers(size)
    n = len(buf)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[:n - k + 1])


def _window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w values in a row."""
    n = len(values)
    padded = np.full(-(-n // w) * w, _U64, dtype=np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, w)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n - w + 1], upto[w - 1:n])


def anchors(raws: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of text, place, fingerprint) of all anchors of the texts."""
    k = max(1, length // 4)
    w = length - k + 1
    parts = [(i, at, raw[at:at + SLICE + length - 1]) for i, raw in enumerate(raws)
             for at in range(0, max(len(raw) - length + 1, 0), SLICE)]
    out = []
    begin = 0
    while begin < len(parts):
        end, size = begin, 0
        while end < len(parts) and (size == 0 or size + len(parts[end][2]) <= SLICE):
            size += len(parts[end][2])
            end += 1
        group, begin = parts[begin:end], end
        buf = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        h = gram_hashes(buf, k)
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        least = _window_minima(key, w)
        inside = np.zeros(len(least) + 1, dtype=np.int64)      # windows that lie in one part
        inside[ends - sizes] += 1
        inside[np.minimum(ends - length + 1, len(least))] -= 1
        least = least[np.cumsum(inside[:-1]) > 0]
        place = np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
        part = np.searchsorted(ends, place, side="right")
        number = np.array([i for i, _, _ in group])[part]
        offset = np.array([at for _, at, _ in group]) - (ends - sizes)
        out.append((number, place + offset[part], h[place].view(np.int64)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(fp, digest, pos) of texts (digest, text), once per text and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, raws = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if d not in seen:
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(d)
                    ids.append(d)
                    raws.append((t.as_py() or "").encode())
            number, place, fp = anchors(raws, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp), pa.array(ids, type=pa.binary()).take(pa.array(number)), pa.array(place)],
                names=["fp", "digest", "pos"])

    return texts.mapInArrow(lean(run), "fp long, digest binary, pos long")


def _surroundings(placed: DataFrame, length: int) -> DataFrame:
    """Rows (fp, digest, pos, left, right) of texts with their repeated anchors
    (digest, packed, at: array of (pos, fp)); the bytes to the left are reversed.
    Of equal surroundings a task sends one; the others become spans, rows with
    the span's end in ``stop`` and no bytes."""
    reach = length - max(1, length // 4)
    fields = "fp long, digest binary, pos long, stop long, left binary, right binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            rows = []
            for d, packed, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = _unpack(packed)
                for a in at:
                    pos = a["pos"]
                    left, right = raw[max(pos - reach, 0):pos], raw[pos:pos + length]
                    key = xxhash.xxh3_128_digest(left + right) + len(left).to_bytes(4, "little")
                    span = (d, pos, pos - len(left), pos + len(right))
                    other = known.get(key)
                    if other is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[key] = span
                        rows.append((a["fp"], d, pos, None, left[::-1], right))
                    elif other[:2] != span[:2] and len(left) + len(right) >= length:
                        for e, _, begin, end in (other[:4], span) if len(other) == 4 else (span,):
                            rows.append((xxhash.xxh3_64_intdigest(e) - 2**63, e, begin, end, None, None))
                        known[key] = (*other, True)[:5]
            types = pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)],
                                             names=[f.split()[0] for f in fields.split(", ")])

    return placed.mapInArrow(lean(run), fields)


def _matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    width = int(lengths.max(initial=1))
    return (np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(-1, width),
            lengths)


def _common(m: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows a and rows b."""
    out = np.empty(len(a), dtype=np.int64)
    for s in range(0, len(a), 1 << 14):
        x, y = a[s:s + (1 << 14)], b[s:s + (1 << 14)]
        other = m[x] != m[y]
        first = np.where(other.any(axis=1), other.argmax(axis=1), m.shape[1])
        out[s:s + (1 << 14)] = np.minimum(first, np.minimum(lengths[x], lengths[y]))
    return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, depth) of a suffix array, children
    before parents; lcp[i] belongs to entries i and i + 1, depth >= least."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        begin = i
        while stack and stack[-1][1] > depth:
            begin, deep = stack.pop()
            if deep >= least:
                yield begin, i, deep
        if not stack or stack[-1][1] < depth:
            stack.append((begin, depth))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, length: int):
    """Spans (row, bytes to the left, bytes to the right) of repeats of at least
    ``length`` bytes around anchors; ``groups`` are the anchors' fingerprints."""
    order = np.array(sorted(range(len(rights)), key=lambda i: (groups[i], rights[i])), dtype=np.int64)
    right, right_length = _matrix(rights)
    left, left_length = _matrix(lefts)
    a, b = order[:-1], order[1:]
    lcp = np.where(groups[a] == groups[b], _common(right, right_length, a, b), 0)
    left_rank = np.empty(len(order), dtype=np.int64)
    left_rank[sorted(range(len(lefts)), key=lefts.__getitem__)] = np.arange(len(order))
    reach = np.full(len(order), -1, dtype=np.int64)     # left extension in the intervals within
    for first, last, depth in intervals(lcp, 1):
        members = order[first:last + 1]
        if (reach[members] == left_length[members]).all():
            continue
        by_left = members[np.argsort(left_rank[members])]
        shared = _common(left, left_length, by_left[:-1], by_left[1:])
        extent = np.maximum(np.append(shared, 0), np.append(0, shared))
        more = extent > reach[by_left]          # else an interval within reaches as far, and deeper
        far = more & (extent + depth >= length)
        for row, e in zip(by_left[far].tolist(), extent[far].tolist()):
            yield row, e, depth
        reach[by_left[more]] = extent[more]


def _interval_spans(around: DataFrame, length: int) -> DataFrame:
    """Spans (digest, start, stop) from surroundings that lie together and in
    order by fingerprint; spans in the input pass through."""
    types = pa.binary(), pa.int64(), pa.int64()

    def give(spans: list[tuple]) -> pa.RecordBatch:
        columns = zip(*spans) if spans else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)],
                                          names=["digest", "start", "stop"])

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        if len(rows) > 1:
            groups = np.array([r[0] for r in rows], dtype=np.int64)
            for i, e, depth in maximal_repeats([r[4] for r in rows], [r[5] for r in rows], groups, length):
                out.append((rows[i][1], rows[i][2] - e, rows[i][2] + depth))
                if len(out) >= 1 << 14:
                    yield give(out)
                    out = []
        yield give(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            spans = [(r[1], r[2], r[3]) for r in rows if r[5] is None]
            held += [r for r in rows if r[5] is not None]
            if len(held) >= 4096 and held[0][0] != held[-1][0]:
                cut = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]) + 1
                yield from settle(held[:cut])
                held = held[cut:]
            yield give(spans)
        yield from settle(held)

    return around.mapInArrow(lean(run), "digest binary, start long, stop long")


def _window_spans(placed: DataFrame, length: int) -> DataFrame:
    """Spans of anchors with very many places: every window around them is hashed
    and counted by Spark with partial sums."""
    reach = length - max(1, length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids, starts = [], [], []
            for d, packed, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw, upto = _unpack(packed), -1
                for pos in sorted(a["pos"] for a in at):
                    for s in range(max(pos - reach, upto + 1), min(pos, len(raw) - length) + 1):
                        hashes.append(hashlib.blake2b(raw[s:s + length], digest_size=16).digest())
                        ids.append(d)
                        starts.append(s)
                        upto = s
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(ids, pa.binary()), pa.array(starts, pa.int64())],
                names=["window", "digest", "start"])

    windows = placed.mapInArrow(lean(run), "window binary, digest binary, start long")
    windows = windows.withColumn("place", F.xxhash64("digest", "start"))
    repeated = (windows.groupBy("window").agg(F.min("place").alias("a"), F.max("place").alias("b"))
                .where("a <> b").select("window"))
    return (windows.join(repeated, "window", "left_semi")
            .select("digest", "start", (F.col("start") + length).alias("stop")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, text_col: str = "text") -> DataFrame:
    """One written row per text with repeated bytes: digest, spans (array of
    start and stop, neither merged nor ordered) and whether the text is there
    twice, which covers it as a whole."""
    texts = docs.select(digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"),
                        F.octet_length(text_col).alias("n")).where(F.col("n") >= length)
    copies = (texts.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
              .select("digest", F.expr("array()").cast("array<struct<start:long,stop:long>>").alias("spans"),
                      F.lit(True).alias("copied")))
    found = written(_anchor_rows(texts.select("digest", "text"), length), "anchors")
    place = F.xxhash64("digest", "pos")
    repeated = written(found.groupBy("fp", "digest")
                       .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("rows"))
                       .groupBy("fp").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("c"),
                                          F.sum("rows").alias("rows"))
                       .where("a <> b").select("fp", (F.col("c") > hot).alias("hot"), "rows"), "repeated")
    wanted = written(_with_common(found, repeated).groupBy("digest", "hot")
                     .agg(F.collect_set(F.struct("pos", "fp")).alias("at")), "wanted")
    once = _once(texts.select("digest", "text"))

    def placed(is_hot: bool) -> DataFrame:
        return once.join(wanted.where(F.col("hot") == is_hot), "digest").select("digest", "packed", "at")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = _surroundings(placed(False), length).repartition(parts, "fp").sortWithinPartitions("fp")
    spans = _interval_spans(around, length)
    if not wanted.where("hot").isEmpty():
        spans = spans.unionByName(_window_spans(placed(True), length))
    spans = spans.groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    both = spans.withColumn("copied", F.lit(False)).unionByName(copies)
    return written(both.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                              F.max("copied").alias("copied")), "spans")


def _with_common(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Anchors joined with their fingerprint's row.  The rows of a very common
    fingerprint stay where they are: the most common ones, COMMON at most, are
    broadcast, and only anchors of the others are dealt by fingerprint."""
    common = F.broadcast(repeated.where(F.col("rows") > COMMON_ROWS).orderBy(F.desc("rows"), "fp").limit(COMMON))
    rare = repeated.join(common.select("fp"), "fp", "left_anti")
    return (found.join(common, "fp").unionByName(
        found.join(common.select("fp"), "fp", "left_anti").join(rare, "fp")).drop("rows"))


def _once(texts: DataFrame) -> DataFrame:
    """Compressed texts (digest, packed) without those that the same task has sent before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            new = []
            for i, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(d)
                    new.append(i)
            new = pa.array(new, type=pa.int64())
            packed = [squeeze((t.as_py() or "").encode()) for t in batch.column(1).take(new)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(new), pa.array(packed, type=pa.binary())],
                                             names=["digest", "packed"])

    return texts.mapInArrow(lean(run), "digest binary, packed binary")


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for begin, end in sorted((s["start"], s["stop"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(max(b, 0), min(e, size)) for b, e in out]


def _cut(packed: Column, spans: Column, copied: Column) -> Column:
    def run(texts: pa.Array, all_spans: pa.Array, copies: pa.Array) -> pa.Array:
        sizes, gone, runs, kept = [], [], [], []
        for t, s, c in zip(texts, all_spans, copies.to_pylist()):
            raw = (t.as_py() or "").encode()
            cut = [(0, len(raw))] if c else merged(s.as_py() or (), len(raw))
            pieces, at = [], 0
            for begin, end in cut:
                pieces.append(raw[at:begin])
                at = end
            rest = b"".join([*pieces, raw[at:]])
            sizes.append(len(raw))
            gone.append(len(raw) - len(rest))
            runs.append(len(cut))
            kept.append(rest)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
             pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    return F.arrow_udf(lean(run), "n_bytes long, n_removed long, n_spans long, kept binary").asNondeterministic()(
        packed, spans, copied)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, text_col: str = "text") -> DataFrame:
    """Add n_bytes, n_removed, n_spans and kept (the remaining bytes) to every row."""
    spans = repeated_spans(docs, length, hot, text_col).select(
        F.col("digest").alias("_digest"), F.col("spans").alias("_spans"), F.col("copied").alias("_copied"))
    out = (docs.withColumn("_of", digest(F.col(text_col))).join(spans, F.col("_of") == F.col("_digest"), "left")
           .withColumn("_cut", _cut(F.col(text_col), F.col("_spans"), F.col("_copied"))))
    return out.withColumns({c: F.col(f"_cut.{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept")}).drop(
        "_of", "_digest", "_spans", "_copied", "_cut")


def readable(kept: Column) -> Column:
    """Text of UTF-8 bytes; bytes of a letter that was cut through are left out."""
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else r.decode(errors="ignore") for r in rows.to_pylist()], type=pa.string())

    return F.arrow_udf(lean(run), "string")(kept)
