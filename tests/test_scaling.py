"""Work that must not grow faster than the input: what is sorted, shuffled and held, and the same results by brute force."""
import random
from collections import Counter
from itertools import combinations
from math import ceil

from pyspark.sql import functions as F

from tavola.operators import mining as M


def test_itemsets_equal_brute_force(spark):
    rnd = random.Random(3)
    sets = [sorted(rnd.sample("abcdefgh", rnd.randint(0, 6))) for _ in range(200)] + [list("abcde")] * 40 + [None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "basket_id long, items array<string>").repartition(3)
    want = Counter(c for s in sets for k in range(1, 9) for c in combinations(s or [], k))
    least = ceil(0.1 * (len(sets) - 1))
    got = {tuple(r["items"]): (r.freq, r.length, r.n_baskets) for r in M.frequent_itemsets(df, 0.1).collect()}
    assert got == {k: (n, len(k), len(sets)) for k, n in want.items() if n >= least} and max(map(len, got)) == 5
    assert M.frequent_itemsets(df.limit(0), 0.1).count() == 0


def test_no_basket_is_sent_once_a_group_of_items():
    assert not hasattr(M, "FPGrowth")


from tavola.operators import recommend as RC


def test_a_basket_line_brings_its_keywords_as_one_row(spark):
    products = spark.createDataFrame([(1, "red box"), (2, "box, blue"), (3, "-"), (2, "old lid")], "product_id long, product_name string")
    baskets = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 2), (9, 5)], "basket_id long, product_id long")
    pairs = spark.createDataFrame([("red", "rouge")], "word string, keyword string")
    df = RC.word_sets(baskets, products, pairs)
    got = {r.basket_id: r.words for r in df.collect()}
    assert got == {7: ["blue", "box", "lid", "old", "red", "rouge"], 9: ["blue", "box", "lid", "old"]}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(collect_list(keys" in plan


def test_dashboard_products_are_dealt_by_product(spark, small_dir):
    from tavola.plans import QUERIES
    plan = QUERIES["dashboard_recommendations"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [product_id" in plan


from tavola.operators import datasets as D


def test_onehot_holds_a_few_bytes_an_order(spark):
    rnd = random.Random(5)
    labels = [f"L{i}" for i in range(130)]
    products = [(i, rnd.choice([*labels, None, "other"])) for i in range(400)]
    items = [(o, rnd.randrange(420)) for o in range(60) for _ in range(rnd.randint(1, 30))]
    df = D.basket_onehot(spark.createDataFrame(items, "order_id long, product_id long"),
                         spark.createDataFrame(products, "product_id long, label string"), "label", labels)
    of, want = dict(products), {}
    for o, p in items:
        if p in of:
            want.setdefault(o, set()).add(of[p])
    got = {r.order_id: {v for v in labels if r[v] == 1} for r in df.collect()}
    assert got == {o: s & set(labels) for o, s in want.items()} and dict(df.dtypes)["L0"] == "int"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" not in plan and plan.count("bit_or(") == 3


def test_campaigns_are_sorted_without_their_texts(spark, small_dir):
    from tavola.plans import QUERIES
    df = QUERIES["campaign_candidates"](spark, small_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Sort "):]
    assert "title" not in "".join(x for x in below.splitlines() if "LocalRelation" not in x and "LogicalRDD" not in x and "JoinHint" not in x)


import pytest

from tavola.operators import segments as SG


@pytest.mark.parametrize("n", [3, 250, 4000])
def test_starts_are_the_least_codes(spark, n):
    import hashlib
    df = spark.range(n).select(F.col("id").alias("siparis_id"), *[(F.col("id") * (i + 1) % 97).cast("double").alias(f) for i, f in enumerate(SG.SEGMENT_FEATURES)])
    got = SG.starts(df, n, 4, 3, 7)
    for s in range(3):
        ids = sorted(range(n), key=lambda i: hashlib.md5(f"{i}-{7 + s}".encode()).hexdigest())[:4]
        assert got[s] == [[float(i * (j + 1) % 97) for j in range(len(SG.SEGMENT_FEATURES))] for i in ids]
    rows = SG.packed(df.repartition(2)).collect()
    assert sum(r.n for r in rows) == n and all(len(r.points) == 64 * r.n and r.n <= SG.BLOCK for r in rows)


def test_desserts_read_their_requests_once(spark, small_dir):
    from tavola.plans import QUERIES
    plan = QUERIES["wizard_desserts"](spark, small_dir)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation [request_id") >= 3


def test_smart_basket_ranks_inside_a_basket(spark, small_dir):
    """No row a (basket, candidate) is sorted or shuffled to rank it."""
    from tavola.plans import QUERIES
    plan = QUERIES["smart_basket"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert not any("windowspecdefinition(basket_id" in line for line in windows)


def test_smart_basket_sorts_a_list_once_a_basket(spark, small_dir):
    """The generator's filter must not repeat the ranking, once for each candidate."""
    from tavola.plans import QUERIES
    plan = QUERIES["smart_basket"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("InMemoryRelation")]
    assert "size(slice(array_sort" not in above and above.count("exists(") == 0
    assert above.count("ArrowEvalPython") == 1


from tavola.operators import basket_top as BT


def test_best_of_basket_equals_brute_force(spark, monkeypatch):
    """Ties, repeated and own products, unknown categories, no list, fill, no item; in several chunks of a batch."""
    monkeypatch.setattr(BT, "CANDIDATES", 40)
    rnd = random.Random(9)
    zone_category, meals, every = [1, 3, 3, 7, None], (3, 4), (1, 2, 3, 7, 8)
    gives = {1: [5, None, None, 7, None], 7: [None, 5, 5, None, None]}
    pairs = [[None, None, 9, None, None], [3, None, None, None, None]]
    rows = []
    for b in range(200):
        items = [(i, rnd.choice([1, 3, 4, 7, 99, None])) for i in sorted(rnd.randrange(40) for _ in range(rnd.randint(0, 6)))]
        lst = sorted((i, rnd.randrange(4), rnd.choice([0, 0, 15, rnd.randrange(90)])) for i in (rnd.randrange(40) for _ in range(rnd.randint(0, 14))))
        fill = sorted((100 + rnd.randrange(9), rnd.choice(every)) for _ in range(rnd.choice([0, 0, 5])))
        words = [rnd.randrange(2) for _ in range(rnd.randint(0, 3))]
        rows.append((b, items, words, lst if b % 7 else None, fill if b % 3 else None))

    def zones_of(items, words):
        return [[x for x in [gives.get(c, [None] * 5)[z] for _, c in items] + [pairs[w][z] for w in words] if x is not None] for z in range(5)]

    def expected(items, words, lst, fill):
        base = [sum(x) if x else None for x in zones_of(items, words)]
        own, cats = {i for i, _ in items}, {c for _, c in items}
        offered = [(-1 - k, -1, c, i, 15, True) for k, (i, c) in enumerate(fill or [])]
        offered += [(k, z, zone_category[z], i, u, u > 0) for k, (i, z, u) in enumerate(lst or [])]
        scored = []
        for at, z, c, i, u, hit in offered:
            if i in own or not (hit or z >= 0 and base[z] is not None):
                continue
            percent = 10 if c in meals and c in cats else 25 if c in meals and cats & set(meals) else 100
            score = ((base[z] or 0) if z >= 0 else 0) + u
            item = next((k for k, (_, x) in enumerate(items) if z >= 0 and gives.get(x, [None] * 5)[z] is not None), -1)
            word = next((x for x in words if z >= 0 and pairs[x][z] is not None), -1)
            scored.append((-((score * 10 ** 8 * percent + 50) // 100), i, at >= 0, at if at >= 0 else -at, c, at, item, word))
        best, n = [], Counter()
        for s in sorted(scored):
            n[s[4]] += 1
            if n[s[4]] <= 2 and len(best) < 6:
                best.append(s)
        conf = [min(0.95, max(0.5, -s[0] / 1e10 / max(-best[0][0] / 1e10, 0.01) * 0.95)) for s in best]
        return [(s[5], s[6], s[7], round(c * 100) / 100) for s, c in zip(best, conf, strict=True)]

    df = spark.createDataFrame([(b, [i for i, _ in items], [c for _, c in items], words, *([[x[k] for x in lst] for k in range(2)] if lst is not None else [None] * 2),
                                 [x[2] * 10 ** 8 for x in lst] if lst is not None else None, [x[2] > 0 for x in lst] if lst is not None else None,
                                 *([[x[k] for x in fill] for k in range(2)] if fill is not None else [None] * 2), [i % 5 for i, _ in items])
                                for b, items, words, lst, fill in rows],
                               "b int, i array<bigint>, c array<int>, w array<int>, ids array<bigint>, z array<int>, u array<bigint>, "
                               "hit array<boolean>, fi array<bigint>, fc array<int>, own array<int>").repartition(3)
    scaled = BT.ZoneTables(zone_category, [9, 8, 7, 6, 5], {k: [x and x * 10 ** 8 for x in v] for k, v in gives.items()}, [[x and x * 10 ** 8 for x in v] for v in pairs])
    top = BT.best_of_basket(scaled, meals, every, 2, 6, 15 * 10 ** 8)
    z = BT.zone_scores(scaled)
    made = {r.b: r for r in df.select("b", top(*df.columns[1:-1]).alias("top"), z(F.col("c"), F.col("w"), F.col("own")).alias("z")).collect()}
    for b, items, words, _, _ in rows:
        per, own = zones_of(items, words), [sum(i % 5 == k for i, _ in items) for k in range(5)]
        assert made[b].z.base == [sum(x) * 10 ** 8 if x else None for x in per] and made[b].z.n_own == own
        assert made[b].z.n_zone == sum(n - o for n, o, x in zip([9, 8, 7, 6, 5], own, per, strict=True) if x)
    got = {b: [tuple(x) for x in r.top] for b, r in made.items()}
    assert got == {b: expected(*x) for b, *x in rows} and sum(map(len, got.values())) > 400
