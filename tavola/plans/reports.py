"""Report, filter, lookup and join queries over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola.functions import exprs as X
from tavola.operators import reports as R
from tavola.plans.registry import register
from tavola.session import scratch_path
from tavola.sources import files
from tavola.sources.fixtures import Fixtures, with_views

DATE_FROM, DATE_TO = "1995-01-01", "2001-12-31"
TODAY = "1998-06-15"

# --------------------------------------------------------------------------- S1/P1


@register("scan_products", with_views(
    "SELECT product_id, product_name, description, price, category_id, is_active, is_available "
    "FROM product_f", "product_f"))
def scan_products(spark, sf):
    return Fixtures(spark, sf).product_f.drop("basket_label", "basket_type")


@register("scan_categories", with_views(
    "SELECT category_id, category_name, station_id FROM category_f", "category_f"))
def scan_categories(spark, sf):
    return Fixtures(spark, sf).category_f


@register("staff_public", with_views(
    "SELECT staff_id, name, surname, username, phone, code, is_active FROM staff_f", "staff_f"))
def staff_public(spark, sf):
    return R.staff_public(Fixtures(spark, sf).staff_f)


# --------------------------------------------------------------------------- A1
DAILY_SALES_SQL = """SELECT CAST(created_at AS DATE) AS sale_date,
 CAST(SUM(total_amount) AS DECIMAL(38,2)) AS total_amount, COUNT(*) AS order_count
FROM order_f WHERE status = 5 AND CAST(created_at AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'
GROUP BY 1""".format(a=DATE_FROM, b=DATE_TO)


@register("daily_sales", with_views(DAILY_SALES_SQL, "order_f"))
def daily_sales(spark, sf):
    return R.daily_sales(Fixtures(spark, sf).order_f, DATE_FROM, DATE_TO)


# --------------------------------------------------------------------------- A2
@register("top_products", with_views("""
SELECT i.product_id, coalesce(p.product_name, 'Bilinmeyen Ürün') AS product_name,
 SUM(i.quantity) AS total_quantity,
 CAST(SUM(i.quantity * i.unit_price) AS DECIMAL(38,2)) AS total_revenue
FROM order_item_f i JOIN order_f o ON o.order_id = i.order_id AND o.status = 5
LEFT JOIN product_f p ON p.product_id = i.product_id
GROUP BY i.product_id, p.product_name
ORDER BY total_revenue DESC, i.product_id LIMIT 10""", "order_f", "order_item_f", "product_f"))
def top_products(spark, sf):
    fx = Fixtures(spark, sf)
    return R.top_products(fx.order_f, fx.order_item_f, fx.product_f, 10)


# --------------------------------------------------------------------------- A3
CATEGORY_SHARE_SQL = with_views("""
SELECT category_name, total_revenue,
 CAST(total_revenue AS DOUBLE) / CAST(SUM(total_revenue) OVER () AS DOUBLE) * 100 AS percentage
FROM per_cat QUALIFY SUM(total_revenue) OVER () <> 0""",
    "order_f", "order_item_f", "product_f", "category_f", extra={"per_cat": """
 SELECT coalesce(c.category_name, 'Diğer') AS category_name,
  CAST(SUM(i.quantity * i.unit_price) AS DECIMAL(38,2)) AS total_revenue
 FROM order_item_f i JOIN order_f o ON o.order_id = i.order_id AND o.status = 5
 LEFT JOIN product_f p ON p.product_id = i.product_id
 LEFT JOIN category_f c ON c.category_id = p.category_id
 GROUP BY 1"""})


@register("category_share", CATEGORY_SHARE_SQL)
def category_share(spark, sf):
    fx = Fixtures(spark, sf)
    return R.category_share(fx.order_f, fx.order_item_f, fx.product_f, fx.category_f)


# --------------------------------------------------------------------------- A4
@register("report_summary", with_views("""
SELECT CAST(coalesce(SUM(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue,
 CAST(COUNT(*) AS BIGINT) AS order_count,
 CASE WHEN COUNT(*) > 0 THEN CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) ELSE 0.0 END AS average_basket
FROM order_f WHERE status = 5 AND CAST(created_at AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'
""".format(a=DATE_FROM, b=DATE_TO), "order_f"))
def report_summary(spark, sf):
    return R.report_summary(R.daily_sales(Fixtures(spark, sf).order_f, DATE_FROM, DATE_TO))


# --------------------------------------------------------------------------- S10
@register("daily_sales_export", with_views("""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS tarih,
 CAST(CAST(SUM(total_amount) AS DECIMAL(38,2)) AS VARCHAR) AS ciro,
 COUNT(*) AS siparis_sayisi
FROM order_f WHERE status = 5 AND CAST(created_at AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'
GROUP BY CAST(created_at AS DATE)""".format(a=DATE_FROM, b=DATE_TO), "order_f"))
def daily_sales_export(spark, sf):
    """The daily sales report, written as CSV and read back."""
    path = scratch_path(spark, f"daily_sales/{uuid.uuid4().hex}")
    files.write_csv(files.daily_sales_file_rows(R.daily_sales(Fixtures(spark, sf).order_f, DATE_FROM, DATE_TO)), path)
    return files.read_csv(spark, path, files.DAILY_SALES_SCHEMA)


# --------------------------------------------------------------------------- J4/A6/P15/A7/A5
OCCUPANCY_CTES = {
    "per_table": """
 SELECT table_number, COUNT(*) AS n, MAX(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS pending,
  CAST(SUM(total_amount) AS DECIMAL(38,2)) AS amount,
  arg_min(order_id, (created_at, order_id)) AS current_order_id
 FROM order_f WHERE status NOT IN (5, 6) GROUP BY table_number""",
    "occ": """
 SELECT t.table_id, t.table_number, t.capacity, p.n IS NOT NULL AS is_occupied,
  coalesce(p.pending = 1, false) AS has_pending_order, p.current_order_id,
  coalesce(p.amount, CAST(0 AS DECIMAL(38,2))) AS current_order_amount
 FROM table_f t LEFT JOIN per_table p ON p.table_number = t.table_number"""}


def _occ_sql(body):
    return with_views(body, "order_f", "table_f", extra=OCCUPANCY_CTES)


def _occupancy(spark, sf):
    fx = Fixtures(spark, sf)
    return R.table_occupancy(fx.table_f, fx.order_f)


@register("table_occupancy", _occ_sql("SELECT * FROM occ"))
def table_occupancy(spark, sf):
    return _occupancy(spark, sf)


@register("table_state", _occ_sql("""SELECT table_id, table_number,
 CASE WHEN has_pending_order THEN 'pending' WHEN is_occupied THEN 'occupied' ELSE 'empty' END AS state
FROM occ"""))
def table_state(spark, sf):
    return R.table_state(_occupancy(spark, sf))


@register("table_counts", _occ_sql("""SELECT count_if(NOT is_occupied) AS empty_tables,
 count_if(is_occupied) AS occupied_tables, count_if(has_pending_order) AS pending_tables FROM occ"""))
def table_counts(spark, sf):
    return R.table_counts(_occupancy(spark, sf))


@register("dashboard_kpis", _occ_sql("""SELECT (SELECT COUNT(*) FROM occ) AS total_tables,
 (SELECT count_if(is_occupied) FROM occ) AS occupied_tables,
 (SELECT count_if(status IN (0, 10)) FROM order_f) AS pending_orders,
 (SELECT CAST(coalesce(SUM(CASE WHEN CAST(created_at AS DATE) = DATE '{t}' AND status = 5
   THEN total_amount END), 0) AS DECIMAL(38,2)) FROM order_f) AS daily_revenue""".format(t=TODAY)))
def dashboard_kpis(spark, sf):
    fx = Fixtures(spark, sf)
    return R.dashboard_kpis(R.table_occupancy(fx.table_f, fx.order_f), fx.order_f, TODAY)


# --------------------------------------------------------------------------- A8
@register("order_totals", with_views("""
SELECT order_id, CAST(SUM(quantity * unit_price) AS DECIMAL(38,2)) AS total_amount
FROM order_item_f GROUP BY order_id""", "order_item_f"))
def order_totals(spark, sf):
    return R.order_totals(Fixtures(spark, sf).order_item_f)


# --------------------------------------------------------------------------- J1
@register("order_lines_wide", with_views("""
SELECT o.order_id, o.table_number, o.status, i.item_id, i.product_id,
 coalesce(p.product_name, 'Bilinmeyen Ürün') AS product_name, p.category_id,
 coalesce(c.category_name, 'Diğer') AS category_name, c.station_id,
 i.quantity, i.unit_price, i.item_status
FROM order_f o LEFT JOIN order_item_f i ON i.order_id = o.order_id
LEFT JOIN product_f p ON p.product_id = i.product_id
LEFT JOIN category_f c ON c.category_id = p.category_id""",
                                       "order_f", "order_item_f", "product_f", "category_f"))
def order_lines_wide(spark, sf):
    fx = Fixtures(spark, sf)
    return R.order_lines_wide(fx.order_f, fx.order_item_f, fx.product_f, fx.category_f)


# --------------------------------------------------------------------------- P4
@register("order_documents", with_views("SELECT * FROM docs", "order_f", "order_item_f", "product_f",
                                       extra={"docs": """
 SELECT o.order_id, o.total_amount, COUNT(i.item_id) AS item_count,
  coalesce(SUM(i.quantity), 0) AS item_quantity,
  CAST(coalesce(SUM(i.quantity * i.unit_price), 0) AS DECIMAL(38,2)) AS items_value,
  coalesce(SUM(CASE WHEN p.product_name IS NULL AND i.item_id IS NOT NULL THEN 1 ELSE 0 END), 0) AS unknown_names,
  min(i.item_id) AS first_item_id
 FROM order_f o LEFT JOIN order_item_f i ON i.order_id = o.order_id
 LEFT JOIN product_f p ON p.product_id = i.product_id GROUP BY o.order_id, o.total_amount"""}))
def order_documents(spark, sf):
    fx = Fixtures(spark, sf)
    d = R.order_documents(fx.order_f, fx.order_item_f, fx.product_f)
    # check form: counts and sums of the nested array
    return d.select(
        "order_id", "total_amount", F.size("items").cast("long").alias("item_count"),
        F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["quantity"]).alias("item_quantity"),
        F.aggregate("items", F.lit(0).cast("decimal(38,2)"),
                    lambda a, x: (a + x["quantity"] * x["unit_price"]).cast("decimal(38,2)")).alias("items_value"),
        F.size(F.filter("items", lambda x: x["product_name"] == "Bilinmeyen Ürün")).cast("long").alias("unknown_names"),
        F.try_element_at("items", F.lit(1))["item_id"].alias("first_item_id"))


# --------------------------------------------------------------------------- J5
@register("station_queue", with_views("""
SELECT c.station_id, i.item_id, i.order_id, o.table_number, i.product_id, p.product_name,
 i.quantity, i.unit_price, i.item_status AS station_status
FROM order_item_f i JOIN order_f o ON o.order_id = i.order_id AND o.status NOT IN (5, 6)
JOIN product_f p ON p.product_id = i.product_id
JOIN category_f c ON c.category_id = p.category_id
WHERE i.item_status NOT IN (4, 3, 10)""", "order_f", "order_item_f", "product_f", "category_f"))
def station_queue(spark, sf):
    fx = Fixtures(spark, sf)
    return R.station_queue(fx.order_f, fx.order_item_f, fx.product_f, fx.category_f)


# --------------------------------------------------------------------------- W2
@register("recent_orders", with_views("""
SELECT order_id, table_number, status, total_amount, created_at FROM order_f
ORDER BY created_at DESC, order_id DESC LIMIT 5""", "order_f"))
def recent_orders(spark, sf):
    return R.recent_orders(Fixtures(spark, sf).order_f, 5)


# --------------------------------------------------------------------------- W3/W4
def _active_pick_sql(fn):
    return with_views(f"""
SELECT table_number, {fn}(order_id, (created_at, order_id)) AS order_id,
 {fn}(created_at, (created_at, order_id)) AS created_at,
 {fn}(status, (created_at, order_id)) AS status
FROM order_f WHERE status NOT IN (5, 6) GROUP BY table_number""", "order_f")


@register("latest_active_order", _active_pick_sql("arg_max"))
def latest_active_order(spark, sf):
    return R.active_order_per_table(Fixtures(spark, sf).order_f, newest=True)


@register("oldest_active_order", _active_pick_sql("arg_min"))
def oldest_active_order(spark, sf):
    return R.active_order_per_table(Fixtures(spark, sf).order_f, newest=False)


# --------------------------------------------------------------------------- P8
@register("order_tabs", with_views("""
SELECT count_if(status IN (1, 2, 3)) AS active, count_if(status = 0) AS pending,
 count_if(status IN (5, 6)) AS completed, COUNT(*) AS all_orders FROM order_f""", "order_f"))
def order_tabs(spark, sf):
    return R.order_tabs(Fixtures(spark, sf).order_f)


# --------------------------------------------------------------------------- P9
@register("orders_by_table", with_views("""
SELECT order_id, table_number, status, total_amount, created_at FROM order_f
WHERE table_number = 'Masa 7'""", "order_f"))
def orders_by_table(spark, sf):
    o = Fixtures(spark, sf).order_f
    return (o.filter(F.col("table_number") == "Masa 7")
             .select("order_id", "table_number", "status", "total_amount", "created_at")
             .orderBy(F.desc("created_at"), F.desc("order_id")))


# --------------------------------------------------------------------------- P10
@register("orders_by_ids", with_views("""
SELECT o.order_id, o.status, o.total_amount FROM order_f o
WHERE o.order_id IN (SELECT order_id FROM payment_f)""", "order_f", "payment_f"))
def orders_by_ids(spark, sf):
    fx = Fixtures(spark, sf)
    return (fx.order_f.join(fx.payment_f.select("order_id"), "order_id", "left_semi")
              .select("order_id", "status", "total_amount"))


# --------------------------------------------------------------------------- P11
@register("order_by_item", with_views("""
SELECT o.order_id, o.table_number FROM order_f o
WHERE EXISTS (SELECT 1 FROM order_item_f i WHERE i.order_id = o.order_id
  AND i.item_id IN (SELECT item_id FROM item_status_change_f))""",
                                    "order_f", "order_item_f", "item_status_change_f"))
def order_by_item(spark, sf):
    fx = Fixtures(spark, sf)
    hit = fx.order_item_f.join(fx.item_status_change_f.select("item_id"), "item_id", "left_semi")
    return fx.order_f.join(hit.select("order_id"), "order_id", "left_semi").select("order_id", "table_number")


# --------------------------------------------------------------------------- P5/P6/P7
@register("menu_filter", with_views("""
SELECT product_id, product_name, category_id FROM product_f
WHERE is_active AND category_id = 3 AND contains(lower(product_name), lower('GEAR'))""", "product_f"))
def menu_filter(spark, sf):
    return R.menu_filter(Fixtures(spark, sf).product_f, "GEAR", 3).select(
        "product_id", "product_name", "category_id")


@register("menu_search", with_views("""
SELECT product_id, product_name, description FROM product_f
WHERE contains(lower(product_name), 'plate') OR coalesce(contains(lower(description), 'plate'), false)
   OR contains(lower(product_name), lower('Brand#1')) OR contains(lower(description), lower('Brand#1'))
""", "product_f"))
def menu_search(spark, sf):
    p = Fixtures(spark, sf).product_f
    return R.menu_search(p, "plate", "Brand#1").select("product_id", "product_name", "description")


@register("staff_search", with_views("""
SELECT staff_id, name, surname, phone FROM staff_f
WHERE contains(lower(concat_ws(' ', name, surname)), lower('AD3 SOYAD1'))
   OR contains(phone, '00007')""", "staff_f"))
def staff_search(spark, sf):
    s = Fixtures(spark, sf).staff_f
    return R.staff_search(s, "AD3 SOYAD1", "00007").select("staff_id", "name", "surname", "phone")


# --------------------------------------------------------------------------- P12
@register("sql_order_frame", with_views("""
SELECT o.order_id, o.total_amount, o.created_at, o.weather_condition, o.temperature,
 CAST(dayofweek(o.created_at) AS INTEGER) AS weekday_no, CAST(hour(o.created_at) AS INTEGER) AS hour_no,
 CAST(month(o.created_at) AS INTEGER) AS month_no,
 (SELECT COUNT(*) FROM order_item_f i WHERE i.order_id = o.order_id) AS item_count
FROM order_f o WHERE o.status >= 1""", "order_f", "order_item_f"))
def sql_order_frame(spark, sf):
    """The same frame written as SQL text over temp views (Catalyst
    decorrelates the scalar subquery into an aggregate + left join)."""
    fx = Fixtures(spark, sf)
    fx.order_f.createOrReplaceTempView("order_f")
    fx.order_item_f.createOrReplaceTempView("order_item_f")
    return spark.sql("""
SELECT o.order_id, o.total_amount, o.created_at, o.weather_condition, o.temperature,
 CAST(dayofweek(o.created_at) - 1 AS INT) AS weekday_no, CAST(hour(o.created_at) AS INT) AS hour_no,
 CAST(month(o.created_at) AS INT) AS month_no,
 (SELECT COUNT(*) FROM order_item_f i WHERE i.order_id = o.order_id) AS item_count
FROM order_f o WHERE o.status >= 1""")


# --------------------------------------------------------------------------- J3
@register("order_item_counts", with_views("""
SELECT o.order_id, (SELECT COUNT(*) FROM order_item_f i WHERE i.order_id = o.order_id) AS item_count
FROM order_f o""", "order_f", "order_item_f"))
def order_item_counts(spark, sf):
    fx = Fixtures(spark, sf)
    counts = fx.order_item_f.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (fx.order_f.select("order_id").join(counts, "order_id", "left")
              .select("order_id", F.coalesce("item_count", F.lit(0)).alias("item_count")))


# --------------------------------------------------------------------------- J2
@register("order_product_pairs", with_views("""
SELECT o.order_id, p.product_name, i.quantity FROM order_f o
JOIN order_item_f i ON i.order_id = o.order_id JOIN product_f p ON p.product_id = i.product_id
WHERE o.status >= 1""", "order_f", "order_item_f", "product_f"))
def order_product_pairs(spark, sf):
    fx = Fixtures(spark, sf)
    return (fx.order_f.filter(F.col("status") >= 1).select("order_id")
              .join(fx.order_item_f.select("order_id", "product_id", "quantity"), "order_id")
              .join(fx.product_f.select("product_id", "product_name"), "product_id")
              .select("order_id", "product_name", "quantity"))


# --------------------------------------------------------------------------- P13
@register("unpaid_items", with_views("""
SELECT o.order_id, COUNT(*) AS unpaid_item_count,
 CAST(SUM(i.quantity * i.unit_price) AS DECIMAL(38,2)) AS unpaid_value,
 o.total_amount - CASE WHEN o.status = 5 THEN o.total_amount ELSE 0 END AS remaining_amount
FROM order_f o JOIN order_item_f i ON i.order_id = o.order_id AND i.item_status NOT IN (5, 6)
GROUP BY o.order_id, o.total_amount, o.status""", "order_f", "order_item_f"))
def unpaid_items(spark, sf):
    fx = Fixtures(spark, sf)
    return R.unpaid_items(fx.order_f, fx.order_item_f)


# --------------------------------------------------------------------------- P14
STATUS_SQL_TEXT = ("CASE status WHEN 0 THEN 'Bekliyor' WHEN 10 THEN 'Onay Bek.' WHEN 1 THEN 'Onaylandı' "
                   "WHEN 2 THEN 'Hazırlanıyor' WHEN 3 THEN 'Hazır' WHEN 5 THEN 'Tamamlandı' "
                   "WHEN 6 THEN 'İptal' ELSE '—' END")
STATUS_SQL_CHIP = ("CASE WHEN status IN (0, 10) THEN 'chip-pending' WHEN status IN (1, 2, 3) THEN 'chip-active' "
                   "WHEN status = 5 THEN 'chip-completed' WHEN status = 6 THEN 'chip-cancelled' ELSE '' END")


@register("status_labels", with_views(f"""
SELECT order_id, status, {STATUS_SQL_TEXT} AS status_text, {STATUS_SQL_CHIP} AS chip_class
FROM order_f""", "order_f"))
def status_labels(spark, sf):
    o = Fixtures(spark, sf).order_f
    return o.select("order_id", "status", X.status_text(F.col("status")).alias("status_text"),
                    X.status_chip(F.col("status")).alias("chip_class"))


# --------------------------------------------------------------------------- P16
WEATHER_SQL = """CASE WHEN weather_code = 0 THEN 'Güneşli' WHEN weather_code IN (1,2,3) THEN 'Bulutlu'
 WHEN weather_code IN (45,48) THEN 'Sisli' WHEN weather_code IN (51,53,55) THEN 'Çiseli'
 WHEN weather_code IN (61,63,65) THEN 'Yağmurlu' WHEN weather_code IN (66,67) THEN 'Dondurucu Yağmur'
 WHEN weather_code IN (71,73,75) THEN 'Karlı' WHEN weather_code = 77 THEN 'Kar Taneleri'
 WHEN weather_code IN (80,81,82) THEN 'Sağanak Yağışlı' WHEN weather_code IN (85,86) THEN 'Yoğun Kar'
 WHEN weather_code = 95 THEN 'Gök Gürültülü Fırtına' WHEN weather_code IN (96,99) THEN 'Dolu Fırtınası'
 ELSE 'Bilinmiyor' END"""


@register("weather_decode", with_views(f"""
SELECT reading_id, weather_code, {WEATHER_SQL} AS weather_text FROM weather_reading_f""",
                                     "weather_reading_f"))
def weather_decode(spark, sf):
    w = Fixtures(spark, sf).weather_reading_f
    return w.select("reading_id", "weather_code", X.weather_text(F.col("weather_code")).alias("weather_text"))


# --------------------------------------------------------------------------- P17
# Ordered keyword rules for the test vocabulary (first match wins).
TEST_TAG_RULES = [(("widget", "gizmo"), "gadget"), (("gear", "bolt", "rod"), "hardware"),
                  (("plate", "anvil"), "heavy"), (("ring",), "jewel")]


@register("keyword_tags", with_views("""
SELECT product_id, product_name,
 CASE WHEN contains(lower(product_name), 'widget') OR contains(lower(product_name), 'gizmo') THEN 'gadget'
      WHEN contains(lower(product_name), 'gear') OR contains(lower(product_name), 'bolt')
        OR contains(lower(product_name), 'rod') THEN 'hardware'
      WHEN contains(lower(product_name), 'plate') OR contains(lower(product_name), 'anvil') THEN 'heavy'
      WHEN contains(lower(product_name), 'ring') THEN 'jewel' ELSE 'other' END AS tag
FROM product_f""", "product_f"))
def keyword_tags(spark, sf):
    p = Fixtures(spark, sf).product_f
    return p.select("product_id", "product_name",
                    X.first_match_tag(F.col("product_name"), TEST_TAG_RULES, "other").alias("tag"))


# --------------------------------------------------------------------------- P18
@register("stock_check", with_views("""
SELECT n.request_id, bool_and(coalesce(p.is_available, true)) AS accepted
FROM new_line_f n LEFT JOIN product_f p ON p.product_id = n.product_id
GROUP BY n.request_id""", "new_line_f", "product_f"))
def stock_check(spark, sf):
    fx = Fixtures(spark, sf)
    return R.stock_check(fx.new_line_f, fx.product_f, key="request_id")


# --------------------------------------------------------------------------- P19
@register("row_validation", with_views("""
SELECT staff_id, phone, code,
 CASE WHEN NOT regexp_full_match(phone, '[1-9][0-9]{9}') THEN 'invalid_phone'
      WHEN NOT regexp_full_match(code, '[0-9]{4}') THEN 'invalid_code' END AS reason,
 regexp_full_match(phone, '[1-9][0-9]{9}') AND regexp_full_match(code, '[0-9]{4}') AS is_valid
FROM staff_f""", "staff_f"))
def row_validation(spark, sf):
    return R.row_validation(Fixtures(spark, sf).staff_f)


# --------------------------------------------------------------------------- P20
@register("table_label", with_views("""
SELECT table_id, CASE WHEN starts_with(lower(lbl), 'masa') THEN lbl ELSE concat('Masa ', lbl) END AS label
FROM (SELECT table_id, CASE WHEN table_id % 2 = 0 THEN table_number ELSE CAST(table_id AS VARCHAR) END AS lbl
      FROM table_f)""", "table_f"))
def table_label(spark, sf):
    t = Fixtures(spark, sf).table_f
    lbl = F.when(F.col("table_id") % 2 == 0, F.col("table_number")).otherwise(F.col("table_id").cast("string"))
    return t.select("table_id", X.table_label(lbl).alias("label"))


# --------------------------------------------------------------------------- J13
@register("lookup_default", with_views("""
SELECT n.line_id AS item_id, n.product_id,
 coalesce(p.product_name, concat('Ürün #', CAST(n.product_id AS VARCHAR))) AS display_name
FROM new_line_f n LEFT JOIN (SELECT * FROM product_f WHERE is_active) p ON p.product_id = n.product_id""",
                                     "new_line_f", "product_f"))
def lookup_default(spark, sf):
    fx = Fixtures(spark, sf)
    lines = fx.new_line_f.select(F.col("line_id").alias("item_id"), "product_id")
    return R.lookup_default(lines, fx.product_f.filter(F.col("is_active")))


# --------------------------------------------------------------------------- A22
@register("split_bill_total", with_views("""
SELECT order_id, CAST(SUM(quantity * unit_price) AS DECIMAL(38,2)) AS selected_total,
 COUNT(*) AS selected_items
FROM order_item_f WHERE item_id IN (SELECT item_id FROM item_status_change_f)
GROUP BY order_id""", "order_item_f", "item_status_change_f"))
def split_bill_total(spark, sf):
    fx = Fixtures(spark, sf)
    return R.split_bill_total(fx.order_item_f, fx.item_status_change_f)
