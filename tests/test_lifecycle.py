"""Cart fold against a direct simulation; status and payment edges."""
import random

from tavola.operators import lifecycle as L


def simulate(actions):
    q = 0
    for a in actions:
        if a == "add":
            q += 1
        elif a == "remove":
            q = 0
        elif a == "increase":
            q = q + 1 if q > 0 else 0
        elif a == "decrease":
            q = q - 1 if q > 0 else 0
    return q


def test_cart_fold_matches_simulation(spark):
    rnd = random.Random(5)
    rows, expect = [], {}
    eid = 0
    for cart in range(40):
        acts = [rnd.choice(["add", "add", "increase", "decrease", "remove"]) for _ in range(rnd.randint(0, 30))]
        for i, a in enumerate(acts):
            # increasing times spread over hours and days, so every fold
            # level (hour, day, all) is used
            t = i * 37 * 60 + (i % 3) * 11
            rows.append((eid, f"2024-01-{1 + t // 86400:02d} {t % 86400 // 3600:02d}:{t % 3600 // 60:02d}:"
                              f"{t % 60:02d}", cart, 1, a))
            eid += 1
        if simulate(acts) > 0:
            expect[cart] = simulate(acts)
    df = spark.createDataFrame(rows, "event_id long, ts string, cart_id long, product_id long, action string")
    df = df.selectExpr("event_id", "to_timestamp_ntz(ts) AS ts", "cart_id", "product_id", "action")
    got = {r["cart_id"]: r["quantity"] for r in L.cart_fold(df).collect()}
    assert got == expect


def test_order_status_spreads_to_items(spark):
    orders = spark.createDataFrame([(1, 2), (2, 1)], "order_id long, status int")
    items = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (20, 2, 1)], "item_id long, order_id long, item_status int")
    ch = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1, 6), (2, "2024-01-01 11:00:00", 1, 2),
                                (3, "2024-01-01 09:00:00", 2, 3)],
                               "change_id long, ts string, order_id long, new_status int")
    o, i = L.apply_order_status(orders, items, ch)
    assert {r["order_id"]: r["status"] for r in o.collect()} == {1: 2, 2: 3}
    assert {r["item_id"]: r["item_status"] for r in i.collect()} == {10: 6, 11: 6, 20: 1}


def test_payment_guard(spark):
    orders = spark.createDataFrame([(1, 5, 100.0), (2, 1, 50.0), (3, 1, 90.0)], "order_id long, status int, total_amount double")
    orders = orders.selectExpr("order_id", "status", "CAST(total_amount AS DECIMAL(18,2)) AS total_amount")
    pays = spark.createDataFrame(
        [(1, 7, 2, 60.0), (2, 7, 2, 0.0), (3, 7, 1, 10.0), (4, 7, 9, 1.0),
         (6, 1, 2, 40.0), (5, 2, 2, 40.0), (7, 3, 2, 10.0), (8, 4, 2, 0.01), (9, 1, 3, 90.0)],
        "payment_id long, ts long, order_id long, amount double")
    pays = pays.selectExpr("payment_id", "ts", "order_id", "CAST(amount AS DECIMAL(18,2)) AS amount").repartition(4)
    rows = {r["payment_id"]: r for r in L.payment_guard(orders, pays).collect()}
    assert {i: r["reason"] for i, r in rows.items()} == {
        1: "exceeds_remaining", 2: "non_positive", 3: "exceeds_remaining", 4: "unknown_order",
        6: None, 5: "exceeds_remaining", 7: None, 8: "exceeds_remaining", 9: None}
    assert {i: float(rows[i]["remaining"]) for i in (6, 5, 7, 8, 9)} == {6: 50, 5: 10, 7: 10, 8: 0, 9: 90}


def _menu(spark):
    return spark.createDataFrame([(1, 5.0, True), (2, 7.0, False)], "product_id long, price double, is_available boolean"
                                 ).selectExpr("product_id", "CAST(price AS DECIMAL(18,2)) AS price", "is_available")


def test_requests_with_unavailable_products_are_refused_whole(spark):
    from tavola.operators import reports as R
    lines = spark.createDataFrame([(1, 1, 10, "Masa 1", 1, 1), (2, 2, 10, "Masa 1", 2, 1), (3, 3, 11, "Masa 1", 99, 2),
                                   (4, 4, 12, "Masa 2", 1, 3)],
                                  "line_id long, ts long, request_id long, table_number string, product_id long, quantity int")
    ok = {r["request_id"]: r["accepted"] for r in R.stock_check(lines, _menu(spark), "request_id").collect()}
    assert ok == {10: False, 11: True, 12: True}
    orders = spark.createDataFrame([(1, "Masa 1", 1, 3.0, 0)], "order_id long, table_number string, status int, total_amount double, created_at long")
    orders = orders.withColumn("total_amount", orders.total_amount.cast("decimal(18,2)"))
    items = spark.createDataFrame([("1-1", 1, 1, 1, 3.0, 1)], "item_id string, order_id long, product_id long, quantity int, unit_price double, item_status int")
    items = items.withColumn("unit_price", items.unit_price.cast("decimal(18,2)"))
    o, i = L.append_lines(orders, items, lines, _menu(spark))
    assert {r["item_id"] for r in i.collect()} == {"1-1", "new-3", "new-4"}
    totals = {r["table_number"]: float(r["total_amount"]) for r in o.collect()}
    assert totals == {"Masa 1": 3.0, "Masa 2": 15.0}


def test_rounding_ties_go_to_even(spark):
    from tavola.operators.mining import round_to
    df = spark.createDataFrame([(0.0625,), (0.1875,), (2.5,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(round_to("x", 3)).collect()] == [0.062, 0.188, 2.5, float("inf")]
    assert [r[0] for r in df.select(round_to("x", 0)).collect()][2] == 2.0


def test_items_of_an_order_of_many_lines_keep_their_own_keys(spark, tmp_path):
    from tavola.sources.fixtures import Fixtures
    rows = [(1 << 41, 7, 1, k, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for k in range(150)] + [((1 << 41) + 1, 7, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", None)]
    from tavola.sources.tables import TABLE_SCHEMAS
    spark.createDataFrame(rows, TABLE_SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "a", "Brand#1", "t", 1, 2.0)], TABLE_SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    items = Fixtures(spark, str(tmp_path)).order_item_f
    assert items.count() == items.select("item_id").distinct().count() == 151


def test_asof_join_takes_the_latest_fresh_reading(spark):
    import datetime as dt
    from tavola.operators.weather import attach_weather
    rnd, start = random.Random(2), dt.datetime(2024, 1, 1)
    readings = [(i, start + dt.timedelta(seconds=rnd.choice([0, 60, 1800, 1799, rnd.randint(0, 20_000)])), i % 100, float(i)) for i in range(40)]
    orders = [(i, start + dt.timedelta(seconds=rnd.choice([0, 60, 1800, 3600, rnd.randint(0, 25_000)]))) for i in range(200)]
    got = attach_weather(spark.createDataFrame(orders, "event_id long, ts timestamp_ntz"),
                         spark.createDataFrame(readings, "reading_id long, reading_ts timestamp_ntz, weather_code int, temperature double"))
    for r in got.collect():
        fresh = [x for x in readings if x[1] <= r["ts"] and r["ts"] - x[1] < dt.timedelta(minutes=30)]
        best = max(fresh, key=lambda x: (x[1], x[0]), default=(None, None, None, 20.0))
        assert (r["reading_id"], r["temperature"]) == (best[0], best[3])
    assert got.count() == 200


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    import pytest
    from types import SimpleNamespace as N
    from tavola.session import checkpoint_dir
    none = N(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = N(sparkContext=N(getCheckpointDir=lambda: None, getConf=lambda: none, master=master), conf=none)
        with pytest.raises(ValueError):
            checkpoint_dir(fake)


def test_half_cents_are_rounded_up_exactly(spark):
    from tavola.operators import campaigns as C
    cart = spark.createDataFrame([(1, 7, 1, "912.30", "Tea"), (1, 8, 3, "10.00", "Soup")], "cart_id int, product_id int, quantity int, price string, category_name string")
    cart = cart.withColumn("price", cart.price.cast("decimal(18,2)"))
    campaign = spark.createDataFrame([(1, 25, ["tea"])], "cart_id int, discount_percent int, target_categories array<string>")
    lines = {r.product_id: str(r.unit_price) for r in C.discounted_lines(cart, campaign).collect()}
    assert lines == {7: "684.23", 8: "10.00"}                      # 684.225
    assert [str(r.discount) for r in C.cart_discount(cart, campaign).collect()] == ["228.08"]      # 228.075
