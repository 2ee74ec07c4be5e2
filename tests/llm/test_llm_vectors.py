"""Hard negatives, centroid clustering, b-bit MinHash."""
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tavola.llm import hard_negatives, linked_groups, minhash, va_file
from tavola.llm.queries import QUERIES
from tavola.llm.vectors import integer_rows
from test_llm_match import near_copies, slow_components

SMALL = "/root/testdata/sf0.01"
BAD = [None, [None] + [0.5] * 5, [float("nan")] * 6, [float("inf")] * 6, [-float("inf")] + [0.0] * 5, [1e30] * 6]


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "vec_id long, embedding array<double>, label int, vector string, code string").repartition(4)


# ------------------------------------------------------------------ hard negatives
def floors(v):
    return [int(np.floor(256 * x)) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e20 for x in v)


def slow_negatives(rows, is_anchor, positives, negatives, low=50, high=95):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            good[i] = min(good.get(i, (label, floors(v))), (label, floors(v)))
    out = Counter()
    for a in filter(is_anchor, good):
        label, q = good[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, (l, v) in good.items() if i != a and len(v) == len(q))
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, i) for n, i, l in scored if l != label and low * -p <= 100 * -n <= high * -p][:negatives]
            out.update((a, positive, r, i, -p, -n) for r, (n, i) in enumerate(fit, 1))
    return out


def mined(spark, rows, anchors, **more):
    table = integer_rows(vector_table(spark, rows), "embedding", F.col("vec_id"), F.col("label"))
    return Counter(map(tuple, hard_negatives.mine(table, anchors, **more).collect()))


@pytest.mark.parametrize("seed,dim,tight", [(1, 6, True), (2, 70, False), (3, 1, False)])
def test_negatives_equal_all_products(spark, monkeypatch, seed, dim, tight):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dim))
    rows = [(i, ((centres[i % 5] if tight else 0) + rnd.normal(size=dim) * 0.2).tolist(), int(rnd.integers(4))) for i in range(260)]
    rows += [(300 + i, rows[3][1], i % 2) for i in range(40)]                       # one vector many times: ties
    rows += [(400 + i, rnd.normal(size=3).tolist(), 1 + i % 2) for i in range(6)] + [(410, [], 0), (420, [], 0), (430, [], 1)]
    rows += [(500 + i, v, 1) for i, v in enumerate(BAD)] + [(None, [1.0] * dim, 1), (600, [1.0] * dim, None), (610, [0.0] * dim, 2)]
    rows += [rows[0], (10, [9.0] * dim, 3)]
    monkeypatch.setattr(hard_negatives, "TASK_VALUES", 128)                          # several shards and blocks
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    want = slow_negatives(rows, lambda i: i % 10 == 0, 5, 3)
    assert got == want and sum(want.values()) > 20
    assert mined(spark, rows, F.col("vec_id") < 0) == Counter()
    loose = mined(spark, rows, F.col("vec_id") == 20, positives=1000, negatives=1, low=0, high=200)
    assert loose == slow_negatives(rows, lambda i: i == 20, 1000, 1, 0, 200)


def test_negatives_of_nothing(spark):
    empty = vector_table(spark, [(1, [1.0], 1)]).limit(0)
    rows = integer_rows(empty, "embedding", F.col("vec_id"), F.col("label"))
    assert hard_negatives.mine(rows, F.lit(True)).count() == 0


def test_intervals_hold_every_product():
    rnd = np.random.default_rng(5)
    for dim in (1, 7, 64, 130):
        x = rnd.integers(-300, 300, (200, dim))
        x[:50] = x[0] + rnd.integers(-3, 4, (50, dim))
        x[60] = 0
        q = x[:70]
        code, along, rest, norm = hard_negatives.encode(x)
        ones = np.bitwise_count(code).sum(axis=1).astype(float)
        least, largest = hard_negatives.Queries(q).interval(code, ones, along, rest, norm)
        assert (least <= q @ x.T).all() and (q @ x.T <= largest).all()
        if dim == 130:                 # unlike vectors are left out by their intervals alone
            assert (largest[:50, 100:] < (q @ x.T)[:50, :50].min()).mean() > 0.3


def test_large_components_are_scored_in_integers():
    x = np.array([[2**28, 3], [2**28, 2], [2**28 - 1, 5], [-2**28, 1]], dtype=np.int64)
    code, along, rest, norm = hard_negatives.encode(x)
    shard = hard_negatives.Shard(np.arange(4), np.zeros(4, np.int64), x.astype("<i4"), code, along, rest, norm)
    far = np.array([[2**62 - 1]])
    _, _, ids, scores = shard.search(np.array([0]), np.array([0]), x[:1], -far, far, 3, True)
    want = sorted(((-int(x[0, 0]) * int(v[0]) - 3 * int(v[1]), i) for i, v in enumerate(x) if i))
    assert list(zip((-scores).tolist(), ids.tolist())) == want


def test_negatives_of_the_whole_table(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    label = np.where(t.vec_id % 7 == 0, (t.label + 1) % 10, t.label).tolist()
    want = slow_negatives(list(zip(t.vec_id.tolist(), [v.tolist() for v in t.embedding.map(lambda v: v.astype(float))], label)),
                          lambda i: i % 50 == 0, 5, 3)
    assert Counter(map(tuple, QUERIES["op11_hard_negatives"](spark, SMALL).collect())) == want


# ------------------------------------------------------------------ centroid clustering
def slow_clusters(rows, starts, rounds):
    """(id, cluster, distance) and centroids, by all distances in Python integers."""
    centroids = [list(s) for s in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in rows:
            members.setdefault(nearest(v)[1], []).append(v)
        for k, vs in members.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs)]
    return Counter((i, *reversed(nearest(v))) for i, v in rows), centroids


@pytest.mark.parametrize("bits,dim,seed", [(1, 3, 1), (4, 5, 2), (6, 6, 3), (8, 2, 4)])
def test_clusters_equal_all_distances(spark, bits, dim, seed):
    rnd = np.random.default_rng(seed)
    rows = [(i, (rnd.normal(size=dim) * 0.1 + (i % 3)).tolist(), 0) for i in range(150)]
    rows += [(200 + i, [0.5] * dim, 0) for i in range(60)] + [(None, [0.25] * dim, None), rows[0], rows[0]]
    bad = [(900 + i, v, 0) for i, v in enumerate(BAD)] + [(950, [0.5] * (dim + 1), 0), (951, [], 0)]
    table = integer_rows(vector_table(spark, rows + [b for b in bad if b[1] is None or len(b[1]) != dim or not usable(b[1])]),
                         "embedding", F.col("vec_id"), dim=dim)
    plain = [(i, floors(v)) for i, v, _ in rows]
    starts = va_file.first_by_hash(table, 7, "x")
    order = sorted(plain, key=lambda r: (r[0] is None, hashlib.sha256(f"x{r[0]}".encode()).hexdigest(), r[1]))
    assert starts == [v for _, v in order[:7]]
    starts[6] = [10**6] * dim                                       # stays empty
    found = va_file.cluster(table, dim, starts, 3, bits)
    want, centroids = slow_clusters(plain, starts, 3)
    assert found.centroids == centroids and Counter(map(tuple, found.members.collect())) == want
    assert found.centroids[6] == [10**6] * dim and len(found.computed) == 3


def test_cells_save_distances(spark):
    """Tight clusters are told apart by cells alone."""
    rnd = np.random.default_rng(8)
    rows = [(i, (np.eye(8)[i % 8] + rnd.normal(size=8) * 0.01).tolist(), 0) for i in range(800)]
    table = integer_rows(vector_table(spark, rows), "embedding", F.col("vec_id"), dim=8)
    found = va_file.cluster(table, 8, [floors(v) for _, v, _ in rows[:8]], 2)
    assert max(found.computed) < 80                                  # of 800 x 8


def test_clusters_of_few_and_of_none(spark):
    table = vector_table(spark, [(5, [0.5] * 4, 1), (6, [0.25] * 4, 1)])
    rows = integer_rows(table, "embedding", F.col("vec_id"), dim=4)
    few = va_file.cluster(rows, 4, va_file.first_by_hash(rows, 40, "2:"), 2)
    assert {r.distance for r in few.members.collect()} == {0} and len(few.centroids) == 2
    none = integer_rows(table, "embedding", F.col("vec_id"), dim=9)
    assert va_file.cluster(none, 9, va_file.first_by_hash(none, 40, "2:"), 2).members.count() == 0


def test_clusters_of_the_whole_table(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(t.embedding).astype(float) * 256).astype(np.int64)
    ids = t.vec_id.tolist()
    order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest())[:40]
    want, centroids = slow_clusters(list(zip(ids, x.tolist())), x[order].tolist(), 5)
    got = QUERIES["op12_centroids"](spark, SMALL).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
    total, by = sum(d for _, _, d in want), Counter()
    for _, c, d in want:
        by[c] += d
    for r in got:
        code = hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
        assert (r.cluster_inertia, r.inertia, r.centroid_sha256) == (by[r.cluster], total, code)


# ------------------------------------------------------------------ b-bit MinHash
@pytest.mark.parametrize("words,percent,signatures,shingles,seed", [(4, 80, 1 << 17, 1 << 22, 1), (5, 80, 3, 40, 2), (2, 90, 2, 60, 3)])
def test_minhash_equals_all_pairs(docs_of, words, percent, signatures, shingles, seed):
    rnd = random.Random(seed)
    texts = near_copies(rnd, 14, 12, 70) + [None, "", " \n", "one", "one", "One  ", "one two", "a b c d", "a b c d e"]
    ids = rnd.sample(range(10_000), len(texts))
    ids[-3] = None
    docs = docs_of(texts, ids=ids, node=["x"] * len(texts), key=["x"] * len(texts), signature=["x"] * len(texts))
    got = minhash.near_duplicates(docs, words, percent, signatures, shingles).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(slow_components(ids, texts, words, percent))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_minhash_of_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    got = QUERIES["op13_minhash"](spark, folder).collect()
    assert (Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)
            == Counter(slow_components(docs.doc_id.tolist(), docs.text.tolist(), 4, 80)))


def test_minhash_of_nothing_and_of_copies(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    same = minhash.near_duplicates(docs_of(["a b c d e f g h"] * 200)).collect()
    assert {r.component_id for r in same} == {0} and len(same) == 200 and sum(r.kept for r in same) == 1


def test_estimates_are_corrected_for_chance():
    rnd = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.8, 1.0):
        errors = []
        for _ in range(30):
            a = rnd.integers(0, 2**63, 300, dtype=np.uint64)
            common = int(round(600 * share / (1 + share)))
            b = np.concatenate([a[:common], rnd.integers(0, 2**63, 300 - common, dtype=np.uint64)])
            one, two = (minhash.packed(minhash.minima(s)) for s in (a, b))
            errors.append(minhash.estimate(one, two[None, :])[0] - common / (600 - common))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2
    assert 0.55 < minhash.passing(80) < 0.7


def test_bands_find_links_at_the_threshold():
    """Sets of similarity 0.8 share a band, and their estimate passes, practically always."""
    rnd = np.random.default_rng(4)
    for _ in range(300):
        a = rnd.integers(0, 2**63, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], rnd.integers(0, 2**63, 10, dtype=np.uint64)])
        one, two = minhash.minima(a), minhash.minima(b)
        assert (minhash.bands(one) == minhash.bands(two)).any()
        assert minhash.estimate(minhash.packed(one), minhash.packed(two)[None, :])[0] >= minhash.passing(80)


@pytest.mark.parametrize("limit", [1000, 7, 2])
def test_links_of_large_groups(spark, limit):
    """Chunks of a group connect what all pairs connect, also where the leader stands alone."""
    rnd = random.Random(limit)
    rows = [(k, 1000 * k + i, 1, rnd.randrange(60)) for k in range(4) for i in range(40)] + [(9, 9000 + i, 1, 5) for i in range(30)]
    table = spark.createDataFrame(rows, "key long, node long, size long, value long").repartition(3)

    def solve(part: pa.Table):
        value = part.column("value").to_numpy()
        return linked_groups.forest(len(value), lambda i, others: np.abs(value[i] - value[others]) <= 1)

    up = {n: n for _, n, _, _ in rows}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    def classes():
        out = {}
        for n in up:
            out.setdefault(find(n), set()).add(n)
        return sorted(map(sorted, out.values()))

    for k, n, _, v in rows:
        for k2, n2, _, v2 in rows:
            if k == k2 and abs(v - v2) <= 1:
                up[find(n)] = find(n2)
    want = classes()
    up = {n: n for n in up}
    got = linked_groups.links(table, solve, limit).collect()
    for r in got:
        up[find(r.a)] = find(r.b)
    assert classes() == want and all(r.a // 1000 == r.b // 1000 == r.key for r in got)
