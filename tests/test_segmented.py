"""The cart fold over ranges equals one event after the other."""
import random

import numpy as np
import pytest

from tavola.operators import lifecycle as L
from tavola.operators import segmented as S

ACTIONS = ["add", "remove", "increase", "decrease"]


def slow(actions):
    q = 0
    for a in actions:
        q = {"add": q + 1, "remove": 0, "increase": q + 1 if q else 0, "decrease": max(q - 1, 0)}.get(a, q)
    return q


@pytest.mark.parametrize("seed,weights", [(1, (3, 1, 3, 3)), (2, (1, 0, 5, 5)), (3, (9, 1, 1, 9))])
def test_cart_fold_with_a_hot_cart(spark, seed, weights):
    """One cart line has most of all events and crosses many ranges and batches."""
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(10**6), 1 if rnd.random() < 0.7 else rnd.choice([None, 2, 3, 4]), rnd.choice([7, 7, 7, 8]),
             rnd.choices(ACTIONS, weights)[0]) for i in range(6000)]
    events = spark.createDataFrame(rows, "event_id long, ts long, cart_id long, product_id long, action string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.cart_id, r.product_id): r.quantity for r in L.cart_fold(events).collect()}
        parts = (S.fold_events(events.where("cart_id = 1 AND product_id = 7"), ["cart_id"], ["ts", "event_id"], "action").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for i, ts, cart, product, action in sorted(rows, key=lambda r: (r[1], r[0])):
        want.setdefault((cart, product), []).append(action)
    want = {k: slow(v) for k, v in want.items()}
    assert got == {k: v for k, v in want.items() if v > 0}
    assert [r.quantity for r in parts] == [want[(1, 7)]]
    assert L.cart_fold(events.limit(0)).count() == 0


def test_hot_key_is_dealt_to_many_ranges(spark):
    events = spark.range(40_000).selectExpr("id AS event_id", "id AS ts", "id DIV 100000 AS cart_id", "id DIV 200000 AS product_id", "'add' AS action")
    plan = S.fold_events(events, ["cart_id", "product_id"], ["ts", "event_id"], "action")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(cart_id" in text and "collect_list" not in text
    assert [r.quantity for r in plan.collect()] == [40_000]


def test_composition_is_associative():
    rnd = np.random.default_rng(3)

    def random_functions(n):
        kind = rnd.integers(0, 4, n)
        return (kind == 1, np.select([kind == 2, kind == 3], [0, 1], -1), np.zeros(n, np.int64), np.select([(kind == 0) | (kind == 2), kind == 3], [1, -1], 0))

    f, g, h = random_functions(500), random_functions(500), random_functions(500)
    for q in range(4):
        def at(fn):
            return np.where(fn[0] | (q <= fn[1]), fn[2], q + fn[3])
        assert (at(S.compose(S.compose(f, g), h)) == at(S.compose(f, S.compose(g, h)))).all()


def test_an_update_to_null_is_kept(spark):
    dim = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id int, name string, price int")
    changes = spark.createDataFrame([(1, 1, 1, None, False), (2, 2, 1, 9, True), (3, 1, 2, 4, False)],
                                    "change_id int, ts int, id int, price int, is_delete boolean")
    changes = changes.unionByName(spark.createDataFrame([(4, 9, 2, None, False), (5, 3, 3, 1, True), (6, 1, 8, 2, False)], changes.schema))
    got = {r.id: r.price for r in L.dimension_upsert(dim, changes.where("change_id <> 2"), "id", ["price"]).collect()}
    assert got == {1: None, 2: None, 8: 2}
