"""A small change table rewrites its own buckets and no others."""
import os

import pytest
from pyspark.sql import functions as F

from tavola.operators import lifecycle as L
from tavola.operators.state_table import StateTable, apply_changes
from tavola.sources.fixtures import Fixtures


def times(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def fx(spark, small_dir):
    return Fixtures(spark, small_dir)


def changed_buckets(before, after):
    return {p.split("bucket=")[1].split("/")[0] for p in before.keys() ^ after.keys()}


def test_order_status_touches_its_buckets(spark, fx, tmp_path):
    orders, items = L.initial_paid(fx.order_f), fx.order_item_f
    states = [StateTable(spark, f"{tmp_path}/{n}", "order_id", 16).create(df) for n, df in (("orders", orders), ("items", items))]
    few = [r[0] for r in orders.select("order_id").orderBy("order_id").limit(3).collect()]
    changes = fx.order_status_change_f.select("change_id", "ts", "order_id", "new_status").where(F.col("order_id").isin(few))
    changes = changes.unionByName(spark.createDataFrame([(10**9, few[0], 6)], "change_id long, order_id long, new_status int")
                                  .withColumn("ts", F.lit("2999-01-01").cast(changes.schema["ts"].dataType)).select(*changes.columns))
    before = [times(s.path) for s in states]
    touched = apply_changes(states, changes, L.apply_order_status)
    assert 1 <= len(touched) <= 3
    for state, old in zip(states, before):
        assert changed_buckets(old, times(state.path)) == {str(b) for b in touched}
    o, i = L.apply_order_status(orders, items, changes)
    assert rows(states[0].read()) == rows(o) and rows(states[1].read()) == rows(i)


def test_payments_item_status_and_upserts(spark, fx, tmp_path):
    orders = L.initial_paid(fx.order_f).select("order_id", "table_number", "total_amount", "paid_amount", "status")
    state = StateTable(spark, f"{tmp_path}/orders", "order_id", 16).create(orders)
    pays = fx.payment_f.orderBy("payment_id").limit(2)
    assert apply_changes([state], pays, L.apply_payments) and rows(state.read()) == rows(L.apply_payments(orders, pays))
    items = StateTable(spark, f"{tmp_path}/items", "item_id", 16).create(fx.order_item_f)
    ch = fx.item_status_change_f.limit(2)
    assert len(apply_changes([items], ch, L.apply_item_status)) <= 2
    assert rows(items.read()) == rows(L.apply_item_status(fx.order_item_f, ch))
    products = fx.product_f.select("product_id", "product_name", "price", "category_id")
    menu = StateTable(spark, f"{tmp_path}/menu", "product_id", 16).create(products)
    edits = fx.product_change_f.withColumnRenamed("new_price", "price").orderBy("change_id").limit(2)

    def upsert(dim, changes):
        return L.dimension_upsert(dim, changes, "product_id", ["price"], defaults={"category_id": F.lit(1)})
    before = times(menu.path)
    touched = apply_changes([menu], edits, upsert)
    assert changed_buckets(before, times(menu.path)) <= {str(b) for b in touched} and len(touched) <= 2
    assert rows(menu.read()) == rows(upsert(products, edits))


def test_a_bucket_may_become_empty(spark, tmp_path):
    dim = spark.createDataFrame([(k, float(k)) for k in range(8)], "id long, price double")
    state = StateTable(spark, f"{tmp_path}/dim", "id", 64).create(dim)
    gone = spark.createDataFrame([(1, 1, 3, None, True)], "change_id long, ts long, id long, price double, is_delete boolean")
    apply_changes([state], gone, lambda d, c: L.dimension_upsert(d, c, "id", ["price"]))
    assert sorted(r.id for r in state.read().collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert apply_changes([state], gone.limit(0), lambda d, c: d) == []
