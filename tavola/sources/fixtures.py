"""Restaurant-shaped views over the driver's TPC-H-like Parquet tables.

Each view exists twice: as a DataFrame builder (what the Spark queries use)
and as SQL text (what the DuckDB oracle uses).  Both read whole tables; the
views only rename and re-map columns, they never sample.

Mapping (fixed values, see FIXTURES.md):
  part      -> products   (category = 1 + p_size % 8)
  orders    -> orders     (status from o_orderstatus and the key)
  lineitem  -> order items (item id = order key and line rank)
  customer  -> tables, supplier -> staff, events -> change and event streams
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.sources.tables import read_table

MONEY = "decimal(18,2)"

# The eight menu categories (id, name, kitchen station).
CATEGORY_ROWS = [
    (1, "Başlangıçlar", 1), (2, "Salatalar", 1), (3, "Burgerler", 1),
    (4, "Pizzalar", 1), (5, "Ana Yemekler", 1), (6, "Makarnalar", 1),
    (7, "İçecekler", 2), (8, "Tatlılar", 1),
]

# Weather label per o_orderkey % 7 (6 -> NULL).
ORDER_WEATHER = ["Güneşli", "Bulutlu", "Serin", "Yağmurlu", "Soğuk/Karlı", "Sisli"]


def _case(key: Column, mapping: list[tuple[int, object]], default=None) -> Column:
    expr = None
    for k, v in mapping:
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def category_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that products are in, with their names and stations."""
    names = spark.createDataFrame(CATEGORY_ROWS, "category_id int, category_name string, station_id int")
    used = read_table(spark, sf_dir, "part").select((F.lit(1) + F.col("p_size") % 8).alias("category_id")).distinct()
    return names.join(used, "category_id", "left_semi")


def product_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("description"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        (F.lit(1) + F.col("p_size") % 8).alias("category_id"),
        (F.col("p_partkey") % 20 != 0).alias("is_active"),
        (F.col("p_partkey") % 10 != 0).alias("is_available"),
        F.col("p_brand").alias("basket_label"),
        F.col("p_type").alias("basket_type"),
    )


def order_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    open_status = _case(k % 6, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], 10)
    status = (F.when(F.col("o_orderstatus") == "F", F.lit(5))
               .when(F.col("o_orderstatus") == "P",
                     F.when(k % 5 == 0, F.lit(6)).otherwise(F.lit(5)))
               .otherwise(open_status))
    weather = _case(k % 7, list(enumerate(ORDER_WEATHER)))
    return o.select(
        k.alias("order_id"),
        F.concat(F.lit("Masa "), F.col("o_custkey").cast("string")).alias("table_number"),
        status.cast("int").alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        (F.col("o_orderdate")
         + F.make_dt_interval(F.lit(0), (F.lit(8) + k % 16).cast("int"),
                              (k % 60).cast("int"), F.lit(0))).alias("created_at"),
        weather.alias("weather_condition"),
        F.when(k % 10 == 0, F.lit(None).cast("double"))
         .otherwise(((k * 13) % 41 - 5).cast("double")).alias("temperature"),
    )


def order_item_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_discount", "l_tax", "l_returnflag")
    rf = F.col("l_returnflag")
    return (li.join(part, li.l_partkey == part.p_partkey)
              .select(
                  F.concat_ws("-", F.col("l_orderkey"), F.row_number().over(w)).alias("item_id"),
                  F.col("l_orderkey").alias("order_id"),
                  F.col("l_partkey").alias("product_id"),
                  F.col("l_quantity").cast("int").alias("quantity"),
                  F.col("p_retailprice").cast(MONEY).alias("unit_price"),
                  F.when(rf == "R", F.lit(6)).when(rf == "A", F.lit(5))
                   .otherwise(F.col("l_linenumber") % 4).cast("int").alias("item_status")))


def table_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("table_id"),
        F.concat(F.lit("Masa "), F.col("c_custkey").cast("string")).alias("table_number"),
        F.when(F.col("c_custkey") % 10 < 8, F.lit(4)).otherwise(F.lit(6)).alias("capacity"))


def _events(spark, sf_dir, event_type=None):
    e = read_table(spark, sf_dir, "events")
    return e if event_type is None else e.filter(F.col("event_type") == event_type)


def weather_reading_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "view").select(
        F.col("event_id").alias("reading_id"), F.col("ts").alias("reading_ts"),
        (F.col("event_id") % 100).cast("int").alias("weather_code"),
        (F.col("value") / 10 - 5).alias("temperature"))


def order_event_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("table_id"), "event_type",
        F.col("value").cast(MONEY).alias("amount"))


def basket_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (basket, product) over every order."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("basket_id"),
                     F.col("l_partkey").alias("product_id")).distinct()


def staff_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("staff_id"),
        F.concat(F.lit("Ad"), (k % 7).cast("string")).alias("name"),
        F.concat(F.lit("Soyad"), k.cast("string")).alias("surname"),
        F.concat(F.lit("user"), k.cast("string")).alias("username"),
        F.concat(F.when(k % 3 == 0, F.lit("0")).otherwise(F.lit("5")),
                 F.lpad(k.cast("string"), 9, "0")).alias("phone"),
        F.lpad(k.cast("string"), F.when(k % 5 == 0, F.lit(3)).otherwise(F.lit(4)),
               "0").alias("code"),
        F.concat(F.lit("hash"), F.col("s_name")).alias("password_hash"),
        (k % 4 != 0).alias("is_active"))


def _size(spark: SparkSession, sf_dir: str, table: str) -> Column:
    """Rows of a table as a scalar subquery: changes are spread over all keys."""
    return read_table(spark, sf_dir, table).select(F.count(F.lit(1))).scalar()


def payment_order(spark: SparkSession, sf_dir: str) -> Column:
    """Order that an event pays: eight events in a row pay the same order."""
    return F.floor(F.col("event_id") / 8).cast("long") % _size(spark, sf_dir, "orders")


def payment_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "purchase").select(
        F.col("event_id").alias("payment_id"), "ts",
        payment_order(spark, sf_dir).alias("order_id"),
        (F.col("value").cast(MONEY) * 1000).cast(MONEY).alias("amount"))


def order_status_change_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").select(
        F.col("event_id").alias("change_id"), "ts",
        (F.floor(F.col("event_id") / 4).cast("long") % _size(spark, sf_dir, "orders")).alias("order_id"),
        (F.col("event_id") % 7).cast("int").alias("new_status"))


def item_status_change_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir, "error").select(
        e.alias("change_id"), "ts",
        F.concat_ws("-", e % _size(spark, sf_dir, "orders"), 1 + e % 4).alias("item_id"),
        (e % 7).cast("int").alias("new_status"))


def new_line_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir, "signup").select(
        e.alias("line_id"), "ts",
        F.concat(F.lit("Masa "), F.col("user_id").cast("string")).alias("table_number"),
        (e * 7 % _size(spark, sf_dir, "part")).alias("product_id"),
        (F.col("user_id") * 16 + e % 16).alias("request_id"),
        (F.lit(1) + e % 5).cast("int").alias("quantity"))


def cart_event_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    action = (F.when(t.isin("view", "purchase"), F.lit("add"))
               .when(t == "click", F.lit("increase"))
               .when(t == "error", F.lit("decrease"))
               .otherwise(F.lit("remove")))
    return _events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("cart_id"),
        (F.col("user_id") * 5 % _size(spark, sf_dir, "part") + F.col("event_id") % 5).alias("product_id"), action.alias("action"))


def product_change_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir, "view").select(
        e.alias("change_id"), "ts", (e % (_size(spark, sf_dir, "part") + 20)).alias("product_id"),
        F.col("value").cast(MONEY).alias("new_price"), (e % 17 == 0).alias("is_delete"))


def campaign_log_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation log, one per terminal (the event's user); NULL = deactivate."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        e.alias("log_id"), "ts", F.col("user_id").alias("terminal_id"),
        F.when(F.col("event_type") == "signup", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("camp-"), (e % 5).cast("string"))).alias("campaign_id"))


BUILDERS = {
    "category_f": category_f, "product_f": product_f, "order_f": order_f,
    "order_item_f": order_item_f, "table_f": table_f,
    "weather_reading_f": weather_reading_f, "order_event_f": order_event_f,
    "basket_f": basket_f, "staff_f": staff_f, "payment_f": payment_f,
    "order_status_change_f": order_status_change_f,
    "item_status_change_f": item_status_change_f, "new_line_f": new_line_f,
    "cart_event_f": cart_event_f, "product_change_f": product_change_f,
    "campaign_log_f": campaign_log_f,
}


class Fixtures:
    """Lazy accessor: ``fx = Fixtures(spark, sf_dir); fx.order_f``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BUILDERS:
            return BUILDERS[name](self.spark, self.sf_dir)
        raise AttributeError(name)


# --------------------------------------------------------------------------
# The same views as SQL text for the DuckDB oracle.
# --------------------------------------------------------------------------
FIXTURE_SQL = {
    "category_f": """SELECT * FROM (VALUES (1,'Başlangıçlar',1),(2,'Salatalar',1),(3,'Burgerler',1),
 (4,'Pizzalar',1),(5,'Ana Yemekler',1),(6,'Makarnalar',1),(7,'İçecekler',2),
 (8,'Tatlılar',1)) AS t(category_id, category_name, station_id)
WHERE category_id IN (SELECT 1 + p_size % 8 FROM part)""",
    "product_f": """SELECT p_partkey AS product_id, p_name AS product_name,
 concat(p_type, ' ', p_brand) AS description,
 CAST(p_retailprice AS DECIMAL(18,2)) AS price, 1 + p_size % 8 AS category_id,
 p_partkey % 20 <> 0 AS is_active, p_partkey % 10 <> 0 AS is_available,
 p_brand AS basket_label, p_type AS basket_type
FROM part""",
    "order_f": """SELECT o_orderkey AS order_id,
 concat('Masa ', CAST(o_custkey AS VARCHAR)) AS table_number,
 CAST(CASE WHEN o_orderstatus = 'F' THEN 5
      WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 6 ELSE 5 END
      ELSE CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2
           WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 10 END END AS INTEGER) AS status,
 CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
 o_orderdate + INTERVAL '1' HOUR * (8 + o_orderkey % 16)
             + INTERVAL '1' MINUTE * (o_orderkey % 60) AS created_at,
 CASE o_orderkey % 7 WHEN 0 THEN 'Güneşli' WHEN 1 THEN 'Bulutlu' WHEN 2 THEN 'Serin'
      WHEN 3 THEN 'Yağmurlu' WHEN 4 THEN 'Soğuk/Karlı' WHEN 5 THEN 'Sisli'
      ELSE NULL END AS weather_condition,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL
      ELSE CAST((o_orderkey * 13) % 41 - 5 AS DOUBLE) END AS temperature
FROM orders""",
    "order_item_f": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey,
  l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax,
  l_returnflag) AS VARCHAR)) AS item_id,
 l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
 CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
 CAST(CASE l_returnflag WHEN 'R' THEN 6 WHEN 'A' THEN 5 ELSE l_linenumber % 4 END AS INTEGER) AS item_status
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "table_f": """SELECT c_custkey AS table_id, concat('Masa ', CAST(c_custkey AS VARCHAR)) AS table_number,
 CASE WHEN c_custkey % 10 < 8 THEN 4 ELSE 6 END AS capacity
FROM customer""",
    "weather_reading_f": """SELECT event_id AS reading_id, ts AS reading_ts,
 CAST(event_id % 100 AS INTEGER) AS weather_code, value / 10 - 5 AS temperature
FROM events WHERE event_type = 'view'""",
    "order_event_f": """SELECT event_id, ts, user_id AS table_id, event_type,
 CAST(value AS DECIMAL(18,2)) AS amount
FROM events""",
    "basket_f": """SELECT DISTINCT l_orderkey AS basket_id, l_partkey AS product_id
FROM lineitem""",
    "staff_f": """SELECT s_suppkey AS staff_id, concat('Ad', CAST(s_suppkey % 7 AS VARCHAR)) AS name,
 concat('Soyad', CAST(s_suppkey AS VARCHAR)) AS surname,
 concat('user', CAST(s_suppkey AS VARCHAR)) AS username,
 concat(CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE '5' END,
        lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS phone,
 lpad(CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 5 = 0 THEN 3 ELSE 4 END, '0') AS code,
 concat('hash', s_name) AS password_hash, s_suppkey % 4 <> 0 AS is_active
FROM supplier""",
    "payment_f": """SELECT event_id AS payment_id, ts, event_id // 8 % (SELECT COUNT(*) FROM orders) AS order_id,
 CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS DECIMAL(18,2)) AS amount
FROM events WHERE event_type = 'purchase'""",
    "order_status_change_f": """SELECT event_id AS change_id, ts, event_id // 4 % (SELECT COUNT(*) FROM orders) AS order_id,
 CAST(event_id % 7 AS INTEGER) AS new_status
FROM events WHERE event_type = 'click'""",
    "item_status_change_f": """SELECT event_id AS change_id, ts, concat_ws('-', CAST(event_id % (SELECT COUNT(*) FROM orders) AS VARCHAR),
  CAST(1 + event_id % 4 AS VARCHAR)) AS item_id,
 CAST(event_id % 7 AS INTEGER) AS new_status
FROM events WHERE event_type = 'error'""",
    "new_line_f": """SELECT event_id AS line_id, ts, concat('Masa ', CAST(user_id AS VARCHAR)) AS table_number,
 event_id * 7 % (SELECT COUNT(*) FROM part) AS product_id, user_id * 16 + event_id % 16 AS request_id, CAST(1 + event_id % 5 AS INTEGER) AS quantity
FROM events WHERE event_type = 'signup'""",
    "cart_event_f": """SELECT event_id, ts, user_id AS cart_id,
 user_id * 5 % (SELECT COUNT(*) FROM part) + event_id % 5 AS product_id,
 CASE event_type WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'add'
  WHEN 'click' THEN 'increase' WHEN 'error' THEN 'decrease' ELSE 'remove' END AS action
FROM events""",
    "product_change_f": """SELECT event_id AS change_id, ts, event_id % ((SELECT COUNT(*) FROM part) + 20) AS product_id,
 CAST(value AS DECIMAL(18,2)) AS new_price, event_id % 17 = 0 AS is_delete
FROM events WHERE event_type = 'view'""",
    "campaign_log_f": """SELECT event_id AS log_id, ts, user_id AS terminal_id,
 CASE WHEN event_type = 'signup' THEN NULL
 ELSE concat('camp-', CAST(event_id % 5 AS VARCHAR)) END AS campaign_id
FROM events""",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named fixture views (and extras)."""
    parts = [f"{n} AS ({FIXTURE_SQL[n]})" for n in names]
    for n, text in (extra or {}).items():
        parts.append(f"{n} AS ({text})")
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
