"""Order-lifecycle queries (L1-L10) over the fixture change tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.operators import lifecycle as L
from tavola.plans.registry import register
from tavola.sources.fixtures import Fixtures, with_views

PAID0 = "CASE WHEN status = 5 THEN total_amount ELSE CAST(0 AS DECIMAL(18,2)) END"

APPEND_CTES = {
    "lines": """
 SELECT n.*, p.price FROM new_line_f n LEFT JOIN product_f p ON p.product_id = n.product_id
 WHERE n.request_id IN (SELECT n.request_id FROM new_line_f n LEFT JOIN product_f p ON p.product_id = n.product_id
  GROUP BY n.request_id HAVING bool_and(coalesce(p.is_available, true)))""",
    "newest": """
 SELECT table_number, arg_max(order_id, (created_at, order_id)) AS target_order
 FROM order_f WHERE status NOT IN (5, 6) GROUP BY table_number""",
    "firsts": """
 SELECT table_number, arg_min(line_id, (ts, line_id)) AS first_line, min(ts) AS first_ts
 FROM lines GROUP BY table_number""",
    "targets": """
 SELECT f.table_number, f.first_ts,
  coalesce(n.target_order, (SELECT max(order_id) FROM order_f) + 1 + f.first_line) AS order_id,
  n.target_order IS NULL AS is_new
 FROM firsts f LEFT JOIN newest n ON n.table_number = f.table_number""",
    "new_items": """
 SELECT 'new-' || CAST(l.line_id AS VARCHAR) AS item_id, t.order_id, l.product_id,
  l.quantity, CAST(coalesce(l.price, 0) AS DECIMAL(18,2)) AS unit_price, 0 AS item_status
 FROM lines l JOIN targets t ON t.table_number = l.table_number""",
    "all_items": """
 SELECT item_id, order_id, product_id, quantity, unit_price, item_status FROM order_item_f
 UNION ALL SELECT * FROM new_items""",
    "totals": """
 SELECT order_id, CAST(SUM(quantity * unit_price) AS DECIMAL(18,2)) AS total FROM all_items
 WHERE order_id IN (SELECT order_id FROM targets) GROUP BY order_id"""}


@register("orders_append", with_views("""
SELECT o.order_id, o.table_number, CASE WHEN t.total IS NOT NULL THEN 0 ELSE o.status END AS status,
 coalesce(t.total, o.total_amount) AS total_amount, o.created_at
FROM order_f o LEFT JOIN totals t ON t.order_id = o.order_id
UNION ALL
SELECT g.order_id, g.table_number, 0, t.total, g.first_ts FROM targets g JOIN totals t ON t.order_id = g.order_id
WHERE g.is_new""", "order_f", "order_item_f", "product_f", "new_line_f", extra=APPEND_CTES))
def orders_append(spark, sf):
    fx = Fixtures(spark, sf)
    orders, _ = L.append_lines(fx.order_f, fx.order_item_f, fx.new_line_f, fx.product_f)
    return orders


@register("orders_append_items", with_views("""
SELECT order_id, COUNT(*) AS n_items, SUM(quantity) AS n_units, max(item_id) AS last_item
FROM all_items GROUP BY order_id""", "order_f", "order_item_f", "product_f", "new_line_f", extra=APPEND_CTES))
def orders_append_items(spark, sf):
    fx = Fixtures(spark, sf)
    _, items = L.append_lines(fx.order_f, fx.order_item_f, fx.new_line_f, fx.product_f)
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"),
                                         F.sum("quantity").alias("n_units"), F.max("item_id").alias("last_item"))


STATUS_CTES = {
    "fin": """SELECT order_id, arg_max(new_status, (ts, change_id)) AS s FROM order_status_change_f GROUP BY order_id""",
    "spr": """SELECT order_id, arg_max(new_status, (ts, change_id)) AS s FROM order_status_change_f
 WHERE new_status IN (0, 6) GROUP BY order_id""",
    "items2": """SELECT i.item_id, i.order_id, coalesce(s.s, i.item_status) AS item_status
 FROM order_item_f i LEFT JOIN spr s ON s.order_id = i.order_id"""}


@register("apply_order_status", with_views("""
SELECT o.order_id, coalesce(f.s, o.status) AS status,
 coalesce((SELECT count_if(item_status = 0) FROM items2 i WHERE i.order_id = o.order_id), 0) AS items_pending,
 coalesce((SELECT count_if(item_status = 6) FROM items2 i WHERE i.order_id = o.order_id), 0) AS items_cancelled
FROM order_f o LEFT JOIN fin f ON f.order_id = o.order_id""",
                                         "order_f", "order_item_f", "order_status_change_f", extra=STATUS_CTES))
def apply_order_status(spark, sf):
    fx = Fixtures(spark, sf)
    o, i = L.apply_order_status(fx.order_f, fx.order_item_f, fx.order_status_change_f)
    counts = i.groupBy("order_id").agg(F.count_if(F.col("item_status") == 0).alias("items_pending"),
                                       F.count_if(F.col("item_status") == 6).alias("items_cancelled"))
    return (o.select("order_id", "status").join(counts, "order_id", "left")
             .fillna(0, subset=["items_pending", "items_cancelled"]))


@register("apply_item_status", with_views("""
SELECT i.item_id, i.order_id, coalesce(c.s, i.item_status) AS item_status
FROM order_item_f i LEFT JOIN (SELECT item_id, arg_max(new_status, (ts, change_id)) AS s
 FROM item_status_change_f GROUP BY item_id) c ON c.item_id = i.item_id""",
                                        "order_item_f", "item_status_change_f"))
def apply_item_status(spark, sf):
    fx = Fixtures(spark, sf)
    return L.apply_item_status(fx.order_item_f, fx.item_status_change_f).select(
        "item_id", "order_id", "item_status")


@register("apply_payments", with_views(f"""
SELECT o.order_id, o.table_number, o.total_amount,
 CAST({PAID0.replace('status', 'o.status').replace('total_amount', 'o.total_amount')} + coalesce(p.paid, 0)
  AS DECIMAL(18,2)) AS paid_amount,
 CASE WHEN p.n IS NOT NULL AND {PAID0.replace('status', 'o.status').replace('total_amount', 'o.total_amount')}
   + coalesce(p.paid, 0) >= o.total_amount THEN 5 ELSE o.status END AS status
FROM order_f o LEFT JOIN (SELECT order_id, SUM(amount) AS paid, COUNT(*) AS n FROM payment_f GROUP BY order_id) p
 ON p.order_id = o.order_id""", "order_f", "payment_f"))
def apply_payments(spark, sf):
    fx = Fixtures(spark, sf)
    return L.apply_payments(fx.order_f, fx.payment_f)


PAY_CTES = {
    "payable": """SELECT i.* FROM order_item_f i WHERE i.item_id IN (SELECT item_id FROM item_status_change_f)
  AND i.item_status NOT IN (5, 6)""",
    "gained": "SELECT order_id, SUM(quantity * unit_price) AS gain, COUNT(*) AS n FROM payable GROUP BY order_id",
    "settled": """SELECT i.order_id, bool_and(p.item_id IS NOT NULL OR i.item_status IN (5, 6)) AS all_done
  FROM order_item_f i LEFT JOIN payable p ON p.item_id = i.item_id GROUP BY i.order_id"""}


@register("pay_items", with_views(f"""
SELECT o.order_id, o.table_number, o.total_amount,
 CAST(o.paid0 + coalesce(g.gain, 0) AS DECIMAL(18,2)) AS paid_amount,
 CASE WHEN g.n IS NOT NULL AND (s.all_done OR o.paid0 + coalesce(g.gain, 0) >= o.total_amount) THEN 5
      ELSE o.status END AS status,
 CAST(coalesce(g.n, 0) AS BIGINT) AS items_paid
FROM (SELECT *, {PAID0} AS paid0 FROM order_f) o LEFT JOIN gained g ON g.order_id = o.order_id
LEFT JOIN settled s ON s.order_id = o.order_id""", "order_f", "order_item_f", "item_status_change_f",
                                extra=PAY_CTES))
def pay_items(spark, sf):
    fx = Fixtures(spark, sf)
    return L.pay_items(fx.order_f, fx.order_item_f, fx.item_status_change_f)[0]


MERGE_CTES = {
    "o0": f"SELECT *, {PAID0} AS paid_amount FROM order_f",
    "act": "SELECT * FROM o0 WHERE status NOT IN (5, 6)",
    "per_table": """SELECT table_number, arg_min(order_id, (created_at, order_id)) AS primary_id, COUNT(*) AS n
 FROM act GROUP BY table_number""",
    "mapping": """SELECT a.order_id, a.status, a.paid_amount, p.primary_id FROM act a
 JOIN per_table p ON p.table_number = a.table_number AND p.n > 1""",
    "header": """SELECT primary_id, CAST(SUM(paid_amount) AS DECIMAL(18,2)) AS paid_sum,
 MAX(CASE WHEN status = 0 AND order_id <> primary_id THEN 1 ELSE 0 END) AS other_pending
 FROM mapping GROUP BY primary_id""",
    "new_items": """SELECT i.item_id, coalesce(m.primary_id, i.order_id) AS order_id, i.product_id, i.quantity,
 i.unit_price, i.item_status FROM order_item_f i LEFT JOIN mapping m ON m.order_id = i.order_id""",
    "totals": """SELECT order_id, CAST(SUM(quantity * unit_price) AS DECIMAL(18,2)) AS total FROM new_items
 WHERE order_id IN (SELECT primary_id FROM header) GROUP BY order_id""",
    "merged": """SELECT o.order_id, o.table_number,
 CASE WHEN h.other_pending = 1 THEN 0 ELSE o.status END AS status,
 coalesce(h.paid_sum, o.paid_amount) AS paid_amount,
 CASE WHEN h.paid_sum IS NOT NULL THEN coalesce(t.total, CAST(0 AS DECIMAL(18,2))) ELSE o.total_amount END AS total_amount,
 o.created_at
 FROM o0 o LEFT JOIN header h ON h.primary_id = o.order_id LEFT JOIN totals t ON t.order_id = o.order_id
 WHERE o.order_id NOT IN (SELECT order_id FROM mapping WHERE order_id <> primary_id)"""}


@register("merge_active_orders", with_views("SELECT * FROM merged", "order_f", "order_item_f",
                                          extra=MERGE_CTES))
def merge_active_orders(spark, sf):
    fx = Fixtures(spark, sf)
    merged, _ = L.merge_active_orders(fx.order_f, fx.order_item_f)
    return merged


@register("merge_active_items", with_views("""
SELECT order_id, COUNT(*) AS n_items, SUM(quantity) AS n_units FROM new_items GROUP BY order_id""",
                                         "order_f", "order_item_f", extra=MERGE_CTES))
def merge_active_items(spark, sf):
    fx = Fixtures(spark, sf)
    _, items = L.merge_active_orders(fx.order_f, fx.order_item_f)
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("n_units"))


@register("cart_fold", with_views("""
SELECT cart_id, product_id, quantity FROM (
 SELECT cart_id, product_id,
  list_reduce(list_prepend(0, list(CASE action WHEN 'add' THEN 1 WHEN 'remove' THEN 2
    WHEN 'increase' THEN 3 ELSE 4 END ORDER BY ts, event_id)),
   lambda q, e: CASE WHEN e = 1 THEN q + 1 WHEN e = 2 THEN 0 WHEN e = 3 THEN CASE WHEN q > 0 THEN q + 1 ELSE 0 END
                     ELSE CASE WHEN q > 0 THEN q - 1 ELSE 0 END END) AS quantity
 FROM cart_event_f GROUP BY cart_id, product_id) WHERE quantity > 0""", "cart_event_f"))
def cart_fold(spark, sf):
    return L.cart_fold(Fixtures(spark, sf).cart_event_f)


@register("dimension_upsert", with_views("""
SELECT coalesce(p.product_id, l.product_id) AS product_id,
 coalesce(p.product_name, 'Ürün #' || CAST(l.product_id AS VARCHAR)) AS product_name,
 coalesce(l.new_price, p.price) AS price, coalesce(p.category_id, 1) AS category_id
FROM product_f p FULL JOIN latest l ON l.product_id = p.product_id
WHERE NOT coalesce(l.is_delete, false)""", "product_f", "product_change_f", extra={"latest": """
 SELECT product_id, arg_max(new_price, (ts, change_id)) AS new_price,
  arg_max(is_delete, (ts, change_id)) AS is_delete FROM product_change_f GROUP BY product_id"""}))
def dimension_upsert(spark, sf):
    fx = Fixtures(spark, sf)
    p = fx.product_f.select("product_id", "product_name", "price", "category_id")
    ch = fx.product_change_f.withColumnRenamed("new_price", "price")
    out = L.dimension_upsert(p, ch, "product_id", ["price"], defaults={
        "product_name": F.concat(F.lit("Ürün #"), F.col("product_id").cast("string")),
        "category_id": F.lit(1)})
    return out.select("product_id", "product_name", "price", "category_id")


@register("payment_guard", "WITH RECURSIVE " + with_views("""
SELECT payment_id, order_id, amount, left_before AS remaining,
 CASE WHEN amount > left_before THEN 'exceeds_remaining' END AS reason, amount <= left_before AS accepted
FROM fold WHERE n > 0
UNION ALL
SELECT payment_id, order_id, amount, NULL, CASE WHEN amount <= 0 THEN 'non_positive'
  WHEN opening IS NULL THEN 'unknown_order' ELSE 'exceeds_remaining' END, false
FROM p WHERE NOT open_for""", "order_f", "payment_f", extra={
    "p": f"""SELECT p.*, o.opening, coalesce(p.amount > 0 AND p.amount <= o.opening, false) AS open_for
 FROM payment_f p LEFT JOIN (SELECT order_id, CAST(total_amount - {PAID0} AS DECIMAL(18,2)) AS opening FROM order_f) o
 ON o.order_id = p.order_id""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, payment_id) AS n FROM p WHERE open_for",
    "fold": """SELECT DISTINCT order_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS payment_id,
  CAST(0 AS DECIMAL(18,2)) AS amount, opening AS left_before FROM numbered
 UNION ALL
 SELECT q.order_id, q.n, q.payment_id, q.amount, CAST(f.left_before - CASE WHEN f.amount <= f.left_before
   THEN f.amount ELSE 0 END AS DECIMAL(18,2)) FROM fold f JOIN numbered q ON q.order_id = f.order_id AND q.n = f.n + 1"""})
    .removeprefix("WITH "))
def payment_guard(spark, sf):
    fx = Fixtures(spark, sf)
    return L.payment_guard(fx.order_f, fx.payment_f)


@register("freed_tables", with_views(f"""
SELECT DISTINCT o.table_number FROM order_f o JOIN paid p ON p.order_id = o.order_id
WHERE o.status <> 5 AND {PAID0} + p.amount >= o.total_amount""", "order_f", "payment_f",
                                   extra={"paid": "SELECT order_id, SUM(amount) AS amount FROM payment_f GROUP BY order_id"}))
def freed_tables(spark, sf):
    """Tables whose order the payments close."""
    fx = Fixtures(spark, sf)
    return L.freed_tables(fx.order_f, L.apply_payments(fx.order_f, fx.payment_f))


@register("pay_items_state", with_views("""
SELECT i.item_id, i.order_id, CASE WHEN p.item_id IS NOT NULL THEN 5 ELSE i.item_status END AS item_status
FROM order_item_f i LEFT JOIN payable p ON p.item_id = i.item_id""", "order_item_f", "item_status_change_f",
                                      extra={"payable": PAY_CTES["payable"]}))
def pay_items_state(spark, sf):
    """The items' state after the payment."""
    fx = Fixtures(spark, sf)
    return L.pay_items(fx.order_f, fx.order_item_f, fx.item_status_change_f)[1].select(
        "item_id", "order_id", "item_status")
