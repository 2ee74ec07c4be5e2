"""Campaign queries: contexts are the orders (weather, temperature, hour,
weekday) and the terminals of the activation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.functions import rules as RU
from tavola.operators import campaigns as C
from tavola.operators import lifecycle as L
from tavola.plans.recommend import sql_values
from tavola.plans.registry import register
from tavola.sources.fixtures import Fixtures, with_views

SEED = 7


def order_contexts(fx: Fixtures):
    o = fx.order_f
    return o.select(F.col("order_id").alias("context_id"),
                    F.coalesce("weather_condition", F.lit("Güneşli")).alias("weather"),
                    F.coalesce("temperature", F.lit(20.0)).alias("temperature"),
                    F.hour("created_at").alias("hour"), F.weekday("created_at").alias("weekday"))


def terminal_contexts(fx: Fixtures):
    """Terminal context at its last log entry, with the source's default
    weather (sunny, 20 degrees)."""
    last = fx.campaign_log_f.groupBy("terminal_id").agg(F.max("ts").alias("ts"))
    return last.select(F.col("terminal_id"), F.lit("Güneşli").alias("weather"), F.lit(20.0).alias("temperature"),
                       F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" if xs else "CAST([] AS VARCHAR[])"


CAMP_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c[0]}', '{c[1]}', {c[2]}, {_sql_list(c[3])}, '{c[4]}', '{c[5]}', "
    f"{'NULL' if c[6] is None else c[6]}, {'NULL' if c[7] is None else c[7]}, {i})"
    for i, c in enumerate(C.CONTEXT_CAMPAIGNS)) + \
    ") AS t(campaign_id, title, discount_percent, target_categories, priority, kind, p1, p2, seq)"
POOL_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c[0]}', '{c[1]}', {c[2]}, {_sql_list(c[3])}, '{c[4]}')" for i, c in enumerate(C.ALWAYS_ON_POOL)) + \
    ") AS t(entry, campaign_id, title, discount_percent, target_categories, priority)"

COND_SQL = """CASE c.kind
  WHEN 'cold' THEN x.weather IN ('Soğuk/Karlı', 'Yağmurlu') OR x.temperature < 10
  WHEN 'sunny_hot' THEN x.weather = 'Güneşli' AND x.temperature > 25
  WHEN 'sunny_mild' THEN x.weather = 'Güneşli' AND x.temperature >= 15 AND x.temperature <= 25
  WHEN 'hour' THEN CASE WHEN c.p1 <= c.p2 THEN x.hour >= c.p1 AND x.hour < c.p2 ELSE x.hour >= c.p1 OR x.hour < c.p2 END
  WHEN 'weekday' THEN x.weekday >= c.p1 AND x.weekday <= c.p2 ELSE false END"""

CTX_CTES = {
    "camp": CAMP_SQL,
    "ctx": """SELECT order_id AS context_id, coalesce(weather_condition, 'Güneşli') AS weather,
 coalesce(temperature, 20.0) AS temperature, CAST(hour(created_at) AS INTEGER) AS hour,
 CAST(isodow(created_at) - 1 AS INTEGER) AS weekday FROM order_f""",
    "cands": f"""SELECT x.context_id, c.campaign_id, c.title, c.discount_percent, c.target_categories, c.priority, c.seq,
 CASE c.priority WHEN 'yuksek' THEN 0 WHEN 'orta' THEN 1 ELSE 2 END AS priority_rank,
 CASE c.priority WHEN 'yuksek' THEN 1 WHEN 'orta' THEN 2 ELSE 3 END AS priority_number
 FROM ctx x JOIN camp c ON {COND_SQL}""",
    "top": """SELECT context_id, arg_min(campaign_id, (priority_rank, seq)) AS campaign_id,
 arg_min(title, (priority_rank, seq)) AS title, arg_min(discount_percent, (priority_rank, seq)) AS discount_percent,
 arg_min(target_categories, (priority_rank, seq)) AS target_categories,
 arg_min(priority_number, (priority_rank, seq)) AS priority_number FROM cands GROUP BY context_id""",
}


@register("campaign_candidates", with_views("SELECT * FROM cands", "order_f", extra=CTX_CTES))
def campaign_candidates(spark, sf):
    return C.in_priority_order(C.campaign_candidates(order_contexts(Fixtures(spark, sf)), spark, SEED, with_pool=False))


POOL_CTES = {
    "pool": POOL_SQL,
    "picks": f"""SELECT *, row_number() OVER (PARTITION BY context_id
   ORDER BY md5(concat_ws('-', CAST(context_id AS VARCHAR), CAST(entry AS VARCHAR), '{SEED}')), entry) AS r
  FROM ctx, pool""",
}


@register("campaign_pool", with_views(f"""
SELECT * FROM cands
UNION ALL
SELECT context_id, campaign_id, title, discount_percent, target_categories, priority, 1000 + r,
 CASE priority WHEN 'yuksek' THEN 0 WHEN 'orta' THEN 1 ELSE 2 END, CASE priority WHEN 'yuksek' THEN 1 WHEN 'orta' THEN 2 ELSE 3 END
FROM picks WHERE r <= 2 + CAST('0x' || substr(md5(concat_ws('-', CAST(context_id AS VARCHAR), '{SEED}')), 1, 8) AS BIGINT) % 2""",
                                      "order_f", extra={**CTX_CTES, **POOL_CTES}))
def campaign_pool(spark, sf):
    """Context campaigns plus 2-3 seeded picks from the always-on pool."""
    return C.campaign_candidates(order_contexts(Fixtures(spark, sf)), spark, SEED, with_pool=True)


@register("campaign_top", with_views("SELECT * FROM top", "order_f", extra=CTX_CTES))
def campaign_top(spark, sf):
    cands = C.campaign_candidates(order_contexts(Fixtures(spark, sf)), spark, SEED, with_pool=True)
    return C.top_campaign(cands)


FRAG_SQL = sql_values(RU.CAMPAIGN_CATEGORY_IDS, ["fragment", "category_id"])


@register("campaign_target_ids", with_views("""
SELECT t.context_id, coalesce(ids.target_ids, CAST([] AS INTEGER[])) AS target_ids FROM top t LEFT JOIN (
 SELECT context_id, list_sort(list_distinct(list(f.category_id))) AS target_ids
 FROM (SELECT context_id, unnest(target_categories) AS target FROM top) u
 JOIN frag f ON contains(lower(u.target), lower(f.fragment)) GROUP BY context_id) ids
 ON ids.context_id = t.context_id""", "order_f", extra={**CTX_CTES, "frag": FRAG_SQL}))
def campaign_target_ids(spark, sf):
    top = C.top_campaign(C.campaign_candidates(order_contexts(Fixtures(spark, sf)), spark, SEED))
    return C.target_category_ids(top, spark, key="context_id")


LOG_CTES = {
    "act": """SELECT terminal_id, arg_max_null(campaign_id, (ts, log_id)) AS active_campaign_id
 FROM campaign_log_f GROUP BY terminal_id""",
}


@register("active_campaign", with_views("SELECT * FROM act", "campaign_log_f", extra=LOG_CTES))
def active_campaign(spark, sf):
    return C.active_campaign(Fixtures(spark, sf).campaign_log_f)


TERMINAL_CTES = {
    **LOG_CTES,
    "camp": CAMP_SQL, "pool": POOL_SQL,
    "allc": "SELECT campaign_id, title, discount_percent, target_categories FROM camp UNION ALL "
            "SELECT campaign_id, title, discount_percent, target_categories FROM pool",
    "ctx": """SELECT terminal_id AS context_id, 'Güneşli' AS weather, 20.0 AS temperature,
 CAST(hour(max(ts)) AS INTEGER) AS hour, CAST(isodow(max(ts)) - 1 AS INTEGER) AS weekday
 FROM campaign_log_f GROUP BY terminal_id""",
    "cands": f"""SELECT x.context_id, c.campaign_id, c.title, c.discount_percent, c.target_categories, c.seq,
 CASE c.priority WHEN 'yuksek' THEN 0 WHEN 'orta' THEN 1 ELSE 2 END AS priority_rank
 FROM ctx x JOIN camp c ON {COND_SQL}""",
    "sug": """SELECT context_id AS terminal_id, arg_min(campaign_id, (priority_rank, seq)) AS campaign_id,
 arg_min(title, (priority_rank, seq)) AS title, arg_min(discount_percent, (priority_rank, seq)) AS discount_percent,
 arg_min(target_categories, (priority_rank, seq)) AS target_categories FROM cands GROUP BY context_id""",
    "cur": """SELECT coalesce(a.terminal_id, s.terminal_id) AS terminal_id,
 CASE WHEN ac.title IS NOT NULL THEN a.active_campaign_id ELSE s.campaign_id END AS campaign_id,
 CASE WHEN ac.title IS NOT NULL THEN ac.title ELSE s.title END AS title,
 CASE WHEN ac.title IS NOT NULL THEN ac.discount_percent ELSE s.discount_percent END AS discount_percent,
 CASE WHEN ac.title IS NOT NULL THEN ac.target_categories ELSE s.target_categories END AS target_categories,
 ac.title IS NOT NULL AS is_active
 FROM act a LEFT JOIN allc ac ON ac.campaign_id = a.active_campaign_id
 FULL JOIN sug s ON s.terminal_id = a.terminal_id""",
}


def _current(spark, sf):
    fx = Fixtures(spark, sf)
    ctx = terminal_contexts(fx).withColumnRenamed("terminal_id", "context_id")
    sug = C.top_campaign(C.campaign_candidates(ctx, spark, SEED)).withColumnRenamed("context_id", "terminal_id")
    return C.current_campaign(C.active_campaign(fx.campaign_log_f), sug.drop("priority_number"), spark)


@register("campaign_current", with_views("SELECT * FROM cur", "campaign_log_f", extra=TERMINAL_CTES))
def campaign_current(spark, sf):
    return _current(spark, sf)


CART_CTES = {
    **TERMINAL_CTES,
    "folded": """SELECT cart_id, product_id, quantity FROM (
 SELECT cart_id, product_id,
  list_reduce(list_prepend(0, list(CASE action WHEN 'add' THEN 1 WHEN 'remove' THEN 2
    WHEN 'increase' THEN 3 ELSE 4 END ORDER BY ts, event_id)),
   lambda q, e: CASE WHEN e = 1 THEN q + 1 WHEN e = 2 THEN 0 WHEN e = 3 THEN CASE WHEN q > 0 THEN q + 1 ELSE 0 END
                     ELSE CASE WHEN q > 0 THEN q - 1 ELSE 0 END END) AS quantity
 FROM cart_event_f GROUP BY cart_id, product_id) WHERE quantity > 0""",
    "lines": """SELECT f.cart_id, f.product_id, f.quantity, p.price, c.category_name
 FROM folded f JOIN product_f p ON p.product_id = f.product_id
 LEFT JOIN category_f c ON c.category_id = p.category_id""",
    "lc": """SELECT l.*, cu.discount_percent, coalesce(cu.discount_percent > 0 AND
   list_bool_or(list_transform(cu.target_categories, lambda t: contains(lower(l.category_name), lower(t)))), false) AS hit
 FROM lines l LEFT JOIN cur cu ON cu.terminal_id = l.cart_id""",
}


def _cart_lines(spark, sf):
    fx = Fixtures(spark, sf)
    folded = L.cart_fold(fx.cart_event_f)
    return (folded.join(fx.product_f.select("product_id", "price", "category_id"), "product_id")
                  .join(fx.category_f.select("category_id", "category_name"), "category_id", "left")
                  .drop("category_id"))


@register("cart_discount", with_views("""
SELECT cart_id, CAST(SUM(CASE WHEN hit THEN CAST(price AS DECIMAL(14,2)) * CAST(quantity AS DECIMAL(9,0))
  * CAST(discount_percent AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)) ELSE 0 END) AS DECIMAL(18,2))
 AS discount FROM lc GROUP BY cart_id""", "campaign_log_f", "cart_event_f", "product_f", "category_f",
                                    extra=CART_CTES))
def cart_discount(spark, sf):
    cur = _current(spark, sf).withColumnRenamed("terminal_id", "cart_id")
    return C.cart_discount(_cart_lines(spark, sf), cur)


@register("discounted_lines", with_views("""
SELECT cart_id, product_id, quantity,
 CAST(CASE WHEN hit THEN CAST(price AS DECIMAL(14,2)) * (100 - CAST(discount_percent AS DECIMAL(4,0)))
  * CAST(0.01 AS DECIMAL(3,2)) ELSE price END AS DECIMAL(18,2)) AS unit_price,
 CASE WHEN hit THEN trim('[Kampanya %' || CAST(discount_percent AS VARCHAR) || '] ') ELSE '' END AS note
FROM lc""", "campaign_log_f", "cart_event_f", "product_f", "category_f", extra=CART_CTES))
def discounted_lines(spark, sf):
    cur = _current(spark, sf).withColumnRenamed("terminal_id", "cart_id")
    return C.discounted_lines(_cart_lines(spark, sf), cur)


@register("campaign_categories", with_views("""
SELECT t.context_id, c.category_id, c.category_name FROM top t JOIN category_f c
 ON list_bool_or(list_transform(t.target_categories, lambda x: contains(lower(c.category_name), lower(x))))""",
                                          "order_f", "category_f", extra=CTX_CTES))
def campaign_categories(spark, sf):
    """Per order's top campaign, the categories whose name contains a target."""
    fx = Fixtures(spark, sf)
    top = C.top_campaign(C.campaign_candidates(order_contexts(fx), spark, SEED))
    return C.campaign_categories(top, fx.category_f)
