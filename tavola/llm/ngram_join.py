"""Similarity join of word n-gram sets with prefix trees (operator 2).

A document's set holds the hashes of its distinct n-word shingles.  Two sets
link when 100 * intersection >= percent * union.  All links between different
sets are found up to what connects them: the result tells for each document the
smallest doc_id it is connected with.

1. Equal sets are one set, known by a 128-bit signature.
2. A set of size n may miss ``allowed(n)`` of its shingles in a partner.  Of the
   shingles whose hash lies in a fixed part of the hash range, a set with a
   partner therefore shares all but that many with other sets.  Tasks send each
   such shingle once, packed, and sets that share too few are done.
3. The sets that are left are put in one global order, rarest shingle first.
   Linked sets share one of their first ``allowed(n) + 1`` shingles; sets that do
   are gathered into connected groups, of which no two can link.
4. In each group the sets, now with the most frequent shingle first, go through
   a prefix tree: a probe walks the tree once, the overlap of a shared prefix is
   counted once for all sets below it, and a subtree is left when the shingles
   remaining in it and in the probe cannot make up the overlap needed, or when
   all its sets are connected with the probe already.  Groups of more than
   ``BLOCK`` sets are cut into chunks, which first meet the group's leader; only sets
   that are not in its class then meet the other chunks (``linked_groups``).

Defined results: a text of fewer words than n has its whole sequence as its one
shingle; a null text, or one without words, has an empty set and is connected
with nothing; repeated rows are connected; a row with a null doc_id
gets a null component if it stands alone and never names one; the order of rows
and ties play no part; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written
from tavola.llm.components import components
from tavola.llm.linked_groups import links as group_links
from tavola.llm.textscan import batches as byte_batches
from tavola.llm.textscan import mix, word_hashes
from tavola.llm.workers import lean

WORDS = 4
PERCENT = 85
SAMPLE = 0.35            # part of the hash range that is sent to find sets without a partner
FLUSH = 1 << 20          # shingles a task gathers before it sends them
DOCS_PER_BUCKET = 64
MOST_BUCKETS = 1 << 18   # hash ranges at most, so that a flush still has several shingles for each
ROWS = 1000              # documents looked at together
MANY = 0xFFFF            # stands for several sets; a flush has fewer
BITS = 1 << 24           # of the filter that a second read of the texts goes through
BLOCK = 2048             # sets that one prefix tree holds

_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def allowed(n, percent: int = PERCENT):
    """Shingles of a set of size n that a linked set may lack."""
    return n * (100 - percent) // 100


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    raws = [(t or "").encode() for t in texts]
    factors = _FACTORS[:words]
    for begin, end in byte_batches(raws):
        hashes, first = word_hashes(raws[begin:end])
        width = max(len(hashes) - words + 1, 0)
        sums = np.zeros(width, dtype=np.uint64)
        for j in range(words):
            sums += hashes[j:j + width] * factors[j]
        sums = mix(sums)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(sums[a:b - words + 1]))
            elif b > a:
                few = (hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([few], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _batch(fields: str, columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=types[t]) for (_, t), c in zip(pairs, columns)],
        names=[n for n, _ in pairs])


def _first_pass(docs: DataFrame, words: int, buckets: int, versions: list[str]) -> DataFrame:
    """Written rows of three kinds: 0, a document (doc_id, node, n, sampled,
    signature); 1, sampled shingles of a bucket, each 48 bits of its hash and the
    16-bit number of the one set of the flush that has it (MANY: several have it);
    2, how many sampled shingles the sets of a flush share with each other.  ``node``
    is what to add to a flush's numbers.  Shingles that agree in 48 bits count as
    shared, so the filter may let more sets pass, never fewer."""
    ids = "".join(f"{c} long, " for c in ["doc_id", *versions])
    fields = f"kind int, {ids}node long, n long, sampled long, signature binary, bucket long, packed binary"
    limit = np.uint64(int(SAMPLE * 2**64))

    def flush(base: int, sets: list[np.ndarray]):
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        if not sizes.any():
            return
        key, owner = np.concatenate(sets) >> np.uint64(16), np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        new = np.append(True, key[1:] != key[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(key)))
        shared = np.repeat(count > 1, count)
        who, times = np.unique(owner[shared], return_counts=True)
        owner[shared] = MANY
        key, owner = key[new], owner[new]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        packed = (key << np.uint64(16) | owner).astype("<u8")
        order = np.argsort(bucket, kind="stable")
        packed, bucket = packed[order], bucket[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(starts[1:], len(bucket))
        n = len(starts)
        blank = [None] * n
        yield _batch(fields, [[1] * n, blank, *[blank for _ in versions], [base] * n, [None] * n, [None] * n, [None] * n, bucket[starts],
                              [packed[a:b].tobytes() for a, b in zip(starts, ends)]])
        yield _batch(fields, [[2], [None], *[[None] for _ in versions], [base], [None], [None], [None], [None], [_packed_counts(who, times)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []
        number: dict[bytes, int] = {}
        size = 0
        for batch in (part for whole in batches for part in _slices(whole)):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            nodes, sampled, signatures = [], [], []
            for s in sets:
                part = s[:np.searchsorted(s, limit)]
                signature = _signature(s)
                if signature not in number:
                    number[signature] = len(held)
                    held.append(part)
                    size += len(part)
                nodes.append(base + number[signature])
                sampled.append(len(part))
                signatures.append(signature)
            n = len(sets)
            yield _batch(fields, [[0] * n, batch.column(0), *batch.columns[2:], nodes, list(map(len, sets)), sampled, signatures,
                                  [None] * n, [None] * n])
            if size >= FLUSH or len(held) >= MANY - ROWS:
                yield from flush(base, held)
                base, held, number, size = base + (1 << 20), [], {}, 0
        if size:
            yield from flush(base, held)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         *versions)
    return written(picked.mapInArrow(lean(run), fields), "shingles", partition_by="kind")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _packed_counts(who: np.ndarray, times: np.ndarray) -> bytes:
    return np.stack([who, times]).astype("<u4").tobytes()


def _shared_counts(rows: DataFrame) -> DataFrame:
    """(node, shared): sampled shingles that each set shares with other sets."""
    fields = "node long, packed binary"

    def settle(held: list[tuple[int, bytes]]) -> np.ndarray:
        """Nodes of the shingles of a bucket that other flushes have too."""
        packed = np.concatenate([np.frombuffer(p, "<u8") for _, p in held])
        base = np.repeat([b for b, _ in held], [len(p) >> 3 for _, p in held])
        order = np.argsort(packed, kind="stable")
        packed, base = packed[order], base[order]
        key, owner = packed >> np.uint64(16), (packed & np.uint64(MANY)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(starts, len(key)))
        shared = (count > 1) | np.logical_or.reduceat(owner == MANY, starts)
        return (base + owner)[np.repeat(shared, count) & (owner != MANY)]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per flush with the counts of its sets."""
        held, now, found, size = [], None, [], 0

        def give():
            who, times = np.unique(np.concatenate(found), return_counts=True)
            base = who & ~np.int64((1 << 20) - 1)
            cuts = np.flatnonzero(np.append(True, base[1:] != base[:-1]))[1:] if len(who) else []
            parts = [p for p in zip(np.split(base, cuts), np.split(who, cuts), np.split(times, cuts)) if len(p[0])]
            return _batch(fields, [[int(b[0]) for b, _, _ in parts], [_packed_counts(w - b, t) for b, w, t in parts]])

        for batch in batches:
            for bucket, base, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    found.append(settle(held))
                    size += len(found[-1])
                    held = []
                    if size >= FLUSH:
                        yield give()
                        found, size = [], 0
                now = bucket
                held.append((base, packed))
        if held:
            found.append(settle(held))
        if found:
            yield give()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the counts of each flush, whose rows lie together."""
        now, total = None, np.zeros(MANY, dtype=np.int64)

        def give():
            who = np.flatnonzero(total)
            out = _batch("node long, shared long", [now + who, total[who]])
            total[:] = 0
            return out

        for batch in batches:
            for base, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if base != now and now is not None:
                    yield give()
                now = base
                who, times = np.frombuffer(packed, "<u4").reshape(2, -1)
                total[who] += times
        if now is not None:
            yield give()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = (rows.where("kind = 1").select("bucket", "node", "packed")
               .repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(across), fields))
    counts = buckets.unionByName(rows.where("kind = 2").select("node", "packed"))
    return (counts.repartition(parts, "node").sortWithinPartitions("node")
            .mapInArrow(lean(added), "node long, shared long"))


def _filter_bits(signatures: DataFrame) -> bytes:
    """Bitmap of BITS bits, whatever the number of signatures."""
    words = (signatures.select(F.pmod(F.xxhash64("signature"), F.lit(BITS)).cast("int").alias("h"))
             .selectExpr("h div 32 AS word", "shiftleft(1L, h % 32) AS bit")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(BITS // 32, dtype="<u4")
    for r in words:
        out[r.word] = r.bits
    return out.tobytes()


def _candidate_sets(docs: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """Written (node, signature, n, shingles) of the candidates' sets, once each."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(candidates))
    fields = "signature binary, n long, shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, dtype=np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            signatures, sets = [], []
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                signature = _signature(s)
                h = xxhash.xxh64_intdigest(signature, 42) % BITS
                if len(s) and signature not in seen and bitmap[h >> 3] >> (h & 7) & 1:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(signature)
                    signatures.append(signature)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signatures, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(sets, pa.list_(pa.int64()))], names=["signature", "n", "shingles"])

    sets = docs.select(F.col("text").cast("string")).mapInArrow(lean(run), fields)
    once = sets.groupBy("signature").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    return written(once.withColumn("node", F.monotonically_increasing_id()), "sets")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """Written (node, n, items): a set's shared shingles, rarest first, of the sets
    that share enough of them."""
    items = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    counts = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = (items.join(counts, "shingle").groupBy("node", "n")
               .agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("items"))
               .where(F.size("items") >= F.col("n") - allowed_column("n", percent)))
    return written(ordered.select("node", "n", F.col("items.shingle").alias("items")), "ordered")


def allowed_column(n: str, percent: int):
    return F.floor(F.col(n) * (100 - percent) / 100)


class PrefixTree:
    """Tree of ordered sets that links each new set with what it is similar to."""

    __slots__ = ("percent", "root", "parent", "links")

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.root = _Node([])
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def add(self, items: list[int], n: int) -> None:
        """Link set number len(parent) with the sets in the tree and put it in."""
        me = len(self.parent)
        self.parent.append(me)
        self._probe(me, items, n)
        self._insert(me, items, n)

    def _probe(self, me: int, items: list[int], n: int) -> None:
        percent, rank = self.percent, {t: i for i, t in enumerate(items)}
        stack = [(child, 0, 0, 0) for child in self.root.children.values()]
        while stack:
            node, overlap, depth, used = stack.pop()
            if node.one >= 0 and self.find(node.one) == self.find(me):
                continue
            # the least overlap that the smallest set below would need
            need = -(-percent * (n + node.least) // (100 + percent))
            longest, short = node.longest, False
            for t in node.run:
                depth += 1
                at = rank.get(t)
                if at is not None:
                    overlap += 1
                    used = at + 1
                elif overlap + min(longest - depth, len(items) - used) < need:
                    short = True
                    break
            if short or overlap + min(longest - depth, len(items) - used) < need:
                continue
            for other, size in node.sets:
                if 100 * overlap >= percent * (n + size - overlap):
                    a, b = self.find(other), self.find(me)
                    if a != b:
                        self.parent[b] = a
                        self.links.append((other, me))
            stack.extend((child, overlap, depth, used) for child in node.children.values())

    def _insert(self, me: int, items: list[int], n: int) -> None:
        node, at = self.root, 0
        node.note(self, me, n, len(items))
        while at < len(items):
            child = node.children.get(items[at])
            if child is None:
                child = node.children[items[at]] = _Node(items[at:])
                child.note(self, me, n, len(items))
                child.sets.append((me, n))
                return
            run = child.run
            k = 1
            while k < len(run) and at + k < len(items) and run[k] == items[at + k]:
                k += 1
            if k < len(run):
                lower = _Node(run[k:], child)
                child.run, child.children, child.sets = run[:k], {run[k]: lower}, []
            child.note(self, me, n, len(items))
            node, at = child, at + k
        node.sets.append((me, n))


class _Node:
    """A run of shingles; least: smallest size below, longest: most items of a set
    below, one: a set below if all are connected, -1 if not, -2 if there is none."""

    __slots__ = ("run", "children", "sets", "least", "longest", "one")

    def __init__(self, run: list[int], like: "_Node | None" = None):
        self.run = run
        self.children, self.sets = (like.children, like.sets) if like else ({}, [])
        self.least, self.longest, self.one = (like.least, like.longest, like.one) if like else (1 << 62, 0, -2)

    def note(self, tree: PrefixTree, me: int, n: int, items: int) -> None:
        self.least, self.longest = min(self.least, n), max(self.longest, items)
        if self.one == -2:
            self.one = me
        elif self.one >= 0 and tree.find(self.one) != tree.find(me):
            self.one = -1


def _links(ordered: DataFrame, percent: int, block: int) -> DataFrame:
    """Written links (a, b) that connect all nodes which similar sets connect."""
    prefix = (allowed_column("n", percent) + 1 - (F.col("n") - F.size("items"))).cast("int")
    first = ordered.select("node", F.explode(F.slice("items", F.lit(1), prefix)).alias("shingle"))
    leads = first.groupBy("shingle").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b <> c")
    near = first.join(leads, "shingle").select(F.col("node").alias("a"), "b").distinct()
    groups = components(near).withColumnRenamed("component", "key")

    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        tree, items = PrefixTree(percent), table.column("items").combine_chunks()
        for k, n in enumerate(table.column("n").to_pylist()):
            tree.add(items[k].values.to_numpy()[::-1].tolist(), n)
        return tuple(np.array([x[i] for x in tree.links], dtype=np.int64) for i in (0, 1))

    rows = ordered.join(groups, "node").withColumn("size", F.lit(1).cast("long"))
    return group_links(rows.select("key", "node", "size", "n", "items"), solve, block).select("a", "b")


def connect(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK,
            version: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of documents (doc_id, text).

    ``version`` names a column (long) that tells rows of one doc_id apart; the result
    then has columns version and component_version, and the least (doc_id, version)
    names a component."""
    versions = ["version"] if version else []
    if version:
        docs = docs.select("doc_id", "text", F.col(version).cast("long").alias("version"))
    own_id = (F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "version")) if versions else F.col("doc_id"))
    buckets = min(MOST_BUCKETS, max(64, docs.count() // DOCS_PER_BUCKET))
    rows = _first_pass(docs, words, buckets, versions)
    sets = rows.where("kind = 0").select("doc_id", *versions, "node", "n", "sampled", "signature")
    shared = _shared_counts(rows)
    enough = F.coalesce("shared", F.lit(0)) >= F.col("sampled") - allowed_column("n", percent)
    candidates = sets.where("n > 0").join(shared, "node", "left").where(enough).select("signature")
    found = _candidate_sets(docs, candidates, words)
    links = _links(_ordered(found, percent), percent, block)
    # documents of equal sets, and of one doc_id, belong together; then the links
    names = sets.where("n > 0").groupBy("signature").agg(F.min(own_id).alias("least"))
    classes = (components(links).join(found.select("node", "signature"), "node")
               .join(names, "signature").select("component", "signature", "least"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = classes.join(least, "component").select("signature", "component_id")
    named = (names.join(linked, "signature", "left")
             .select(F.col("signature").alias("_signature"), F.coalesce("component_id", "least").alias("component_id")))
    own = (F.col("n") > 0) & (F.col("signature") == F.col("_signature"))
    named = sets.join(written(named, "classes"), own, "left")
    component = F.coalesce("component_id", own_id)
    if versions:
        return named.select("doc_id", "version", F.col("n").alias("n_shingles"),
                            component["doc_id"].alias("component_id"), component["version"].alias("component_version"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
