"""Payments of large orders in rounds equal one payment after the other."""
import random
from collections import Counter
from decimal import Decimal

import pytest

from tavola.operators import lifecycle as L


def slow(orders, payments):
    left, out = dict(orders), Counter()
    opening = dict(orders)
    for i, ts, order, amount in sorted(payments, key=lambda p: (p[1], p[0])):
        if order not in opening or amount <= 0 or amount > opening[order]:
            out[(i, None, False)] += 1
            continue
        ok = amount <= left[order]
        out[(i, left[order], ok)] += 1
        left[order] -= amount if ok else 0
    return out


@pytest.mark.parametrize("seed,one_row", [(1, 0), (2, 5), (3, 64)])
def test_rounds_equal_the_sequence(spark, seed, one_row):
    rnd = random.Random(seed)
    orders = [(k, Decimal(rnd.choice([1, 99, 12345, 10**7, 2**22, 3])) / 100) for k in range(8)]
    payments = []
    for i in range(900):
        k = 0 if rnd.random() < 0.4 else rnd.randrange(9)
        cents = max(rnd.choice([0, 1, 1, rnd.randint(1, 9), rnd.randint(1, 2000), int(rnd.expovariate(1) * 10**rnd.randint(0, 7))]), -1)
        payments.append((i, rnd.randrange(300), k, Decimal(cents) / 100))
    payments += [(2000 + i, 999, 1, Decimal("0.01")) for i in range(150)]       # after the last cent
    o = spark.createDataFrame(orders, "order_id long, total_amount decimal(18,2)").selectExpr("*", "1 AS status", "CAST(0 AS DECIMAL(18,2)) AS paid_amount")
    p = spark.createDataFrame(payments, "payment_id long, ts long, order_id long, amount decimal(18,2)").repartition(5)
    got = Counter((r.payment_id, r.remaining, r.accepted) for r in L.payment_guard(o, p, one_row).collect())
    assert got == slow(orders, payments)
    assert L.payment_guard(o, p.limit(0), one_row).count() == 0


def test_no_python_rows(spark):
    o = spark.createDataFrame([(1, Decimal(100))], "order_id long, total_amount decimal(18,2)").selectExpr("*", "1 AS status", "CAST(0 AS DECIMAL(18,2)) AS paid_amount")
    p = spark.range(300).selectExpr("id AS payment_id", "id AS ts", "1L AS order_id", "CAST(1 AS DECIMAL(18,2)) AS amount")
    out = L.payment_guard(o, p)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and out.where("accepted").count() == 100
