"""Remaining queries: weather as-of join, dashboard list, meal wizard,
keyword and set operators, category cap, cart totals, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.functions import exprs as X
from tavola.functions import rules as RU
from tavola.operators import lifecycle as L
from tavola.operators import recommend as RC
from tavola.operators import weather as W
from tavola.plans.mining import mining_ctes
from tavola.plans.recommend import NAME, alias_rows, complement_rows, kw_cte, pairing_rows, rules_by_name, sql_values, sql_words
from tavola.plans.registry import register
from tavola.plans.reports import WEATHER_SQL
from tavola.session import reuse
from tavola.sources.fixtures import Fixtures, with_views

WIZARD_SEED = 11


# ----------------------------------------------------------------- J14
@register("weather_asof", with_views(f"""
SELECT o.event_id, o.ts, arg_max(w.reading_id, (w.reading_ts, w.reading_id)) AS reading_id,
 coalesce(arg_max({WEATHER_SQL.replace('weather_code', 'w.weather_code')}, (w.reading_ts, w.reading_id)),
          'Bilinmiyor') AS weather_condition,
 coalesce(arg_max(w.temperature, (w.reading_ts, w.reading_id)), 20.0) AS temperature
FROM (SELECT event_id, ts FROM order_event_f WHERE event_type = 'purchase') o
LEFT JOIN weather_reading_f w ON w.reading_ts <= o.ts AND o.ts - w.reading_ts < INTERVAL 30 MINUTE
GROUP BY o.event_id, o.ts""", "order_event_f", "weather_reading_f"))
def weather_asof(spark, sf):
    fx = Fixtures(spark, sf)
    orders = fx.order_event_f.filter(F.col("event_type") == "purchase").select("event_id", "ts")
    return W.attach_weather(orders, fx.weather_reading_f, 30)


# ----------------------------------------------------------------- R4
# Every (asking product, candidate) pair, with the rule part summed per pair of names.
DASHBOARD_CTES = {
    "comp": sql_values(complement_rows(), ["src_category", "pos", "category_id", "weight"]),
    "pair": sql_values(pairing_rows(RU.TEST_PAIRINGS), ["keyword", "pos", "category_id", "target_name", "boost"]),
    "canon": sql_values(sorted(RU.TEST_CANONICAL.items()), ["word", "canonical"]),
    "cat": "SELECT product_id, product_name, category_id, price FROM product_f WHERE is_active AND is_available",
    "names": "SELECT DISTINCT product_name FROM cat",
    "qw": f"""SELECT product_name, unnest({sql_words('product_name')}) AS word,
  generate_subscripts({sql_words('product_name')}, 1) AS word_pos FROM names""",
    "qk": """SELECT qw.product_name, qw.word_pos,
  CASE WHEN coalesce(c.canonical, qw.word) IN (SELECT keyword FROM pair) THEN coalesce(c.canonical, qw.word) ELSE qw.word END AS keyword
 FROM qw LEFT JOIN canon c ON c.word = qw.word""",
    "asked": """SELECT DISTINCT qw.product_name, s.tetikleyici, s.oneri FROM qw JOIN sugg s
 ON length(qw.word) > 2 AND contains(lower(s.tetikleyici), qw.word)""",
    "rn": "SELECT tetikleyici, oneri, lower(trim(unnest(string_split(oneri, ',')))) AS rn FROM sugg",
    "reach": """SELECT DISTINCT rn.tetikleyici, rn.oneri, n.product_name FROM rn JOIN names n
 ON contains(lower(n.product_name), rn.rn) OR contains(rn.rn, lower(n.product_name))
 OR list_bool_or(list_transform(list_filter(string_split(rn.rn, ' '), lambda w: length(w) > 3), lambda w: contains(lower(n.product_name), w)))""",
    "by_rule": """SELECT a.product_name AS q_name, r.product_name, SUM(CAST(CAST(s.confidence AS DECIMAL(20,10)) * 0.4 AS DECIMAL(20,10))) AS score,
  arg_min('Apriori (güven: %' || CAST(CAST(trunc(s.confidence * 100) AS INTEGER) AS VARCHAR) || ')', (-s.lift, s.tetikleyici, s.oneri)) AS reason
 FROM asked a JOIN reach r ON r.tetikleyici = a.tetikleyici AND r.oneri = a.oneri
 JOIN sugg s ON s.tetikleyici = a.tetikleyici AND s.oneri = a.oneri GROUP BY a.product_name, r.product_name""",
    "by_pair": """SELECT q_cat, q_name, category_id, product_name, SUM(score) AS score, arg_min(reason, k) AS reason FROM (
  SELECT q.category_id AS q_cat, q.product_name AS q_name, c.category_id, c.product_name,
   CAST(CAST(co.weight AS DECIMAL(20,10)) * 0.5 AS DECIMAL(20,10)) AS score, 'Kategori tamamlayıcı' AS reason, (1, 0, co.pos) AS k
  FROM cls q JOIN comp co ON co.src_category = q.category_id JOIN cls c ON c.category_id = co.category_id
  UNION ALL
  SELECT q.category_id, q.product_name, c.category_id, c.product_name,
   CAST(CAST(p.boost AS DECIMAL(20,10)) * CASE WHEN coalesce(contains(lower(c.product_name), lower(p.target_name)), false) THEN 0.6 ELSE 0.3 END AS DECIMAL(20,10)),
   CASE WHEN coalesce(contains(lower(c.product_name), lower(p.target_name)), false) THEN '''' || q.product_name || ''' ile eşleşme' ELSE 'Akıllı eşleştirme' END,
   (2, qk.word_pos, p.pos)
  FROM cls q JOIN qk ON qk.product_name = q.product_name JOIN pair p ON p.keyword = qk.keyword JOIN cls c ON c.category_id = p.category_id)
 GROUP BY ALL""",
    "cls": "SELECT DISTINCT category_id, product_name FROM cat",
    "scored": """SELECT q.product_id, c.product_id AS rec_id, c.product_name AS rec_name, c.category_id AS rec_category, c.price,
  q.category_id <> c.category_id AS other, b.score IS NOT NULL OR r.score IS NOT NULL AS is_scored,
  CAST(coalesce(b.score, 0) + coalesce(r.score, 0) AS DECIMAL(20,10)) AS score, coalesce(b.reason, r.reason) AS reason
 FROM cat q JOIN cat c ON c.product_id <> q.product_id
 LEFT JOIN by_pair b ON b.q_cat = q.category_id AND b.q_name = q.product_name AND b.category_id = c.category_id AND b.product_name = c.product_name
 LEFT JOIN by_rule r ON r.q_name = q.product_name AND r.product_name = c.product_name""",
    "n_scored": "SELECT product_id, COUNT(*) FILTER (is_scored) AS n FROM scored GROUP BY product_id",
}
DASHBOARD_CTES = {k: DASHBOARD_CTES[k] for k in ("comp", "pair", "canon", "cat", "cls", "names", "qw", "qk", "asked", "rn", "reach",
                                                 "by_rule", "by_pair", "scored", "n_scored")}


@register("dashboard_recommendations", with_views("""
SELECT product_id, rank, rec_id, rec_name, rec_category, price,
 round_even(least(CAST(score AS DOUBLE), 1.0) * 1000, 0) / 1000 AS confidence, reason FROM (
 SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, rec_id) AS rank FROM (
  SELECT s.product_id, rec_id, rec_name, rec_category, price, CASE WHEN is_scored THEN score ELSE CAST(0.05 AS DECIMAL(20,10)) END AS score,
   CASE WHEN is_scored THEN reason ELSE 'Popüler ürün' END AS reason
  FROM scored s JOIN n_scored n ON n.product_id = s.product_id WHERE is_scored OR (n.n < 8 AND other AND rec_category BETWEEN 1 AND 8)))
WHERE rank <= 8""", "order_item_f", "product_f", extra={**mining_ctes(*NAME), **DASHBOARD_CTES}))
def dashboard_recommendations(spark, sf):
    """R4 for every catalogue product."""
    fx = Fixtures(spark, sf)
    return RC.dashboard_recommendations(
        fx.product_f, RU.complements_df(spark), RU.pairings_df(spark, RU.TEST_PAIRINGS),
        RU.canonical_df(spark, RU.TEST_CANONICAL), rules_by_name(spark, sf), limit=8)


# ----------------------------------------------------------------- R5-R7
def _requests(fx):
    """One wizard session per order: hunger from the item count, main
    category from the order's first item."""
    first = fx.order_item_f.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("product_id", F.col("item_id")).alias("first_product"))
    req = first.join(fx.product_f.select(F.col("product_id").alias("first_product"),
                                         F.col("category_id").alias("main_category")), "first_product", "left")
    hunger = F.when(F.col("n") <= 2, F.lit("az")).when(F.col("n") <= 4, F.lit("orta")).otherwise(F.lit("cok"))
    return req.select(F.col("order_id").alias("request_id"), hunger.alias("hunger"), "main_category")


def _menu(fx):
    return fx.product_f.filter(F.col("is_active"))


def _draw_ctes(name: str, requests: str, group: str, pool: str) -> dict[str, str]:
    """Four draws per request from the numbered pool of its group, as SQL."""
    h = f"CAST('0x' || substr(md5(concat_ws('-', CAST(request_id AS VARCHAR), '{{}}', '{WIZARD_SEED}')), 1, 8) AS BIGINT)"
    draw = ", ".join(f"CASE WHEN m > {k} THEN {h.format(k)} % (m - {k}) END AS r{k}" for k in range(4))
    return {
        f"{name}_pool": f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY product_id) - 1 AS number FROM ({pool})",
        f"{name}_r": f"""SELECT q.*, {draw} FROM ({requests}) q
 JOIN (SELECT {group}, COUNT(*) AS m FROM {name}_pool GROUP BY {group}) s USING ({group})""",
        f"{name}_1": f"SELECT *, r0 AS i0, r1 + CAST(r1 >= r0 AS INTEGER) AS i1 FROM {name}_r",
        f"{name}_2": f"""SELECT *, t + CAST(t >= greatest(i0, i1) AS INTEGER) AS i2
 FROM (SELECT *, r2 + CAST(r2 >= least(i0, i1) AS INTEGER) AS t FROM {name}_1)""",
        f"{name}_3": f"""SELECT *, t2 + CAST(t2 >= s[3] AS INTEGER) AS i3 FROM (
 SELECT *, t1 + CAST(t1 >= s[2] AS INTEGER) AS t2 FROM (
 SELECT *, r3 + CAST(r3 >= s[1] AS INTEGER) AS t1 FROM (SELECT *, list_sort([i0, i1, i2]) AS s FROM {name}_2)))""",
        f"{name}_d": f"""SELECT d.request_id, d.k AS slot, p.* FROM (
  SELECT request_id, {group}, unnest([0, 1, 2, 3]) AS k, unnest([i0, i1, i2, i3]) AS number FROM {name}_3) d
 JOIN {name}_pool p ON p.{group} = d.{group} AND p.number = d.number""",
    }


# Words of the test vocabulary that stand for drink words.
TEST_HOT, TEST_HEAVY, TEST_LIGHT = ["bolt"], ["gear", "plate"], ["widget", "nut"]


def _has(words: list[str], name: str = "product_name") -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


WIZARD_CTES = {
    "menu": "SELECT product_id, product_name, category_id, price FROM product_f WHERE is_active",
    "req": """SELECT f.order_id AS request_id, CASE WHEN n <= 2 THEN 'az' WHEN n <= 4 THEN 'orta' ELSE 'cok' END AS hunger,
  p.category_id AS main_category
 FROM (SELECT order_id, COUNT(*) AS n, arg_min(product_id, item_id) AS first_product FROM order_item_f GROUP BY order_id) f
 LEFT JOIN product_f p ON p.product_id = f.first_product""",
    **_draw_ctes("mains", "SELECT request_id, hunger FROM req", "hunger", "SELECT menu.*, l.hunger FROM menu JOIN (VALUES "
                 + ", ".join(f"('{h}', {c})" for h, cs in RC.HUNGER_CATEGORIES.items() for c in cs)
                 + ") AS l(hunger, category_id) ON l.category_id = menu.category_id"),
    "drinkable": f"SELECT * FROM menu WHERE category_id = 7 AND NOT {_has(TEST_HOT, 'lower(product_name)')}",
    **_draw_ctes("drinks", """SELECT request_id, meal || turn AS level FROM (SELECT request_id,
  CASE WHEN coalesce(main_category IN (3, 4, 5, 6), false) THEN 'heavy' ELSE 'light' END AS meal,
  unnest(['-first', '-last']) AS turn FROM req)""", "level", f"""SELECT *, meal || CASE WHEN pref THEN '-first' ELSE '-last' END AS level
 FROM (SELECT *, 'heavy' AS meal, {_has(TEST_HEAVY)} AS pref FROM drinkable
       UNION ALL SELECT *, 'light', {_has(TEST_LIGHT)} FROM drinkable)"""),
    "drinks": """SELECT request_id, CAST(pick AS INTEGER) AS pick, product_id, product_name, price FROM (
  SELECT d.*, slot + 1 + CASE WHEN pref THEN 0 ELSE coalesce(before, 0) END AS pick FROM drinks_d d
  LEFT JOIN (SELECT meal, least(4, COUNT(*)) AS before FROM drinks_pool WHERE pref GROUP BY meal) b USING (meal))
 WHERE pick <= 4""",
    **_draw_ctes("desserts", "SELECT request_id, 8 AS level FROM req", "level", "SELECT *, category_id AS level FROM menu WHERE category_id = 8"),
}


def _wizard_sql(body: str) -> str:
    return with_views(body, "product_f", "order_item_f", extra=WIZARD_CTES)


@register("wizard_mains", _wizard_sql(
    "SELECT request_id, CAST(slot + 1 AS INTEGER) AS pick, product_id, product_name, category_id, price FROM mains_d"))
def wizard_mains(spark, sf):
    fx = Fixtures(spark, sf)
    return RC.wizard_mains(_menu(fx), _requests(fx), WIZARD_SEED)


def _drinks(fx, req):
    return RC.wizard_drinks(_menu(fx), req, WIZARD_SEED, hot=TEST_HOT, heavy_words=TEST_HEAVY, light_words=TEST_LIGHT)


@register("wizard_drinks", _wizard_sql("SELECT * FROM drinks"))
def wizard_drinks(spark, sf):
    fx = Fixtures(spark, sf)
    return _drinks(fx, _requests(fx))


@register("wizard_desserts", _wizard_sql("""
SELECT s.request_id, CAST(s.slot + 1 AS INTEGER) AS pick, s.product_id, s.product_name, s.price,
 CAST(coalesce(m.price, 0) + coalesce(d.price, 0) + coalesce(f.price, 0) AS DECIMAL(20,2)) AS total
FROM desserts_d s
LEFT JOIN mains_d m ON m.request_id = s.request_id AND m.slot = 0
LEFT JOIN drinks d ON d.request_id = s.request_id AND d.pick = 1
LEFT JOIN desserts_d f ON f.request_id = s.request_id AND f.slot = 0"""))
def wizard_desserts(spark, sf):
    """Desserts plus the combo total of the first main, drink and dessert."""
    fx = Fixtures(spark, sf)
    req = reuse(_requests(fx))              # read by the three draws
    mains = RC.wizard_mains(_menu(fx), req, WIZARD_SEED).filter("pick = 1")
    drinks = _drinks(fx, req).filter("pick = 1")
    desserts = RC.wizard_desserts(_menu(fx), req, WIZARD_SEED)
    total = RC.combo_total(mains, drinks, desserts.filter("pick = 1"))
    return desserts.join(total, "request_id", "left").withColumn("total", F.col("total").cast("decimal(20,2)"))


# ----------------------------------------------------------------- U2
KW_EXTRA = {"alias_pairs": sql_values(alias_rows(RU.TEST_ALIASES), ["word", "keyword"]),
            "pk": kw_cte("product_f", "product_id", "product_name")}


@register("keyword_expand", with_views("SELECT product_id, keyword FROM pk", "product_f", extra=KW_EXTRA))
def keyword_expand(spark, sf):
    fx = Fixtures(spark, sf)
    return RC.keywords(fx.product_f, ["product_id"], "product_name", RU.alias_pairs_df(spark, RU.TEST_ALIASES))


# ----------------------------------------------------------------- U4
@register("missing_categories", with_views("""
SELECT basket_id, list_sort(list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda c: NOT list_contains(cats, c))) AS missing
FROM (SELECT b.basket_id, list(DISTINCT p.category_id) AS cats FROM basket_f b
      JOIN product_f p ON p.product_id = b.product_id GROUP BY b.basket_id)""", "basket_f", "product_f"))
def missing_categories(spark, sf):
    fx = Fixtures(spark, sf)
    cats = (fx.basket_f.join(fx.product_f.select("product_id", "category_id"), "product_id")
              .groupBy("basket_id").agg(F.collect_set("category_id").alias("cats")))
    allc = F.array(*[F.lit(c) for c in RU.ALL_CATEGORIES])
    return cats.select("basket_id", F.array_sort(F.array_except(allc, "cats")).alias("missing"))


# ----------------------------------------------------------------- J9/U5
@register("basket_products", with_views("""
SELECT b.basket_id, list_sort(list(b.product_name)) AS names, SUM(n.n) AS catalogue_products
FROM (SELECT DISTINCT b.basket_id, p.product_name FROM basket_f b JOIN product_f p ON p.product_id = b.product_id) b
JOIN (SELECT product_name, COUNT(*) AS n FROM product_f WHERE is_active GROUP BY product_name) n
 ON n.product_name = b.product_name
GROUP BY b.basket_id""", "basket_f", "product_f"))
def basket_products(spark, sf):
    """Distinct product names of each basket; J9: how many active
    catalogue products carry one of those names (semi join on the name,
    counted per name first so no basket x product rows are formed)."""
    fx = Fixtures(spark, sf)
    names = (fx.basket_f.join(fx.product_f.select("product_id", "product_name"), "product_id")
               .select("basket_id", "product_name").distinct())
    per_name = fx.product_f.filter(F.col("is_active")).groupBy("product_name").agg(F.count(F.lit(1)).alias("n"))
    return (names.join(per_name, "product_name")
                 .groupBy("basket_id").agg(F.array_sort(F.collect_set("product_name")).alias("names"),
                                           F.sum("n").alias("catalogue_products")))


# ----------------------------------------------------------------- W5
@register("category_cap", with_views("""
SELECT category_id, product_id, product_name, price FROM (
 SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY price DESC, product_id) AS rn
 FROM product_f WHERE is_active AND is_available) WHERE rn <= 2""", "product_f"))
def category_cap(spark, sf):
    p = Fixtures(spark, sf).product_f.filter(F.col("is_active") & F.col("is_available"))
    w = Window.partitionBy("category_id").orderBy(F.desc("price"), "product_id")
    return (p.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
             .select("category_id", "product_id", "product_name", "price"))


# ----------------------------------------------------------------- A17
@register("cart_totals", with_views("""
SELECT f.cart_id, SUM(f.quantity) AS items, CAST(SUM(p.price * f.quantity) AS DECIMAL(38,2)) AS value
FROM (SELECT cart_id, product_id, quantity FROM (
 SELECT cart_id, product_id,
  list_reduce(list_prepend(0, list(CASE action WHEN 'add' THEN 1 WHEN 'remove' THEN 2
    WHEN 'increase' THEN 3 ELSE 4 END ORDER BY ts, event_id)),
   lambda q, e: CASE WHEN e = 1 THEN q + 1 WHEN e = 2 THEN 0 WHEN e = 3 THEN CASE WHEN q > 0 THEN q + 1 ELSE 0 END
                     ELSE CASE WHEN q > 0 THEN q - 1 ELSE 0 END END) AS quantity
 FROM cart_event_f GROUP BY cart_id, product_id) WHERE quantity > 0) f
JOIN product_f p ON p.product_id = f.product_id GROUP BY f.cart_id""", "cart_event_f", "product_f"))
def cart_totals(spark, sf):
    fx = Fixtures(spark, sf)
    lines = L.cart_fold(fx.cart_event_f).join(fx.product_f.select("product_id", "price"), "product_id")
    return lines.groupBy("cart_id").agg(F.sum("quantity").alias("items"),
                                        X.money_sum(F.col("price") * F.col("quantity")).alias("value"))


# ----------------------------------------------------------------- X1-X24
@register("scalars_string", with_views("""
SELECT product_id, lower(product_name) AS low, contains(lower(product_name), 'ring') AS has_ring,
 starts_with(lower(product_name), 'small') AS starts_small,
 list_filter(regexp_split_to_array(trim(lower(replace(description || '-x', '-', ' '))), '\\s+'), lambda t: t <> '') AS words,
 list_transform(string_split(' ' || product_name || ' , ' || basket_label || ' ', ','), lambda s: trim(s)) AS parts,
 array_to_string(list_sort([basket_type, basket_label]), ', ') AS set_text,
 format('{} ({})', product_name, basket_label) AS template,
 regexp_full_match(split_part(description, ' ', 1), '[0-9]+') AS digits_head,
 trim(concat('[Not] ', product_name, ' ')) AS note
FROM product_f""", "product_f"))
def scalars_string(spark, sf):
    p = Fixtures(spark, sf).product_f
    name = F.col("product_name")
    return p.select(
        "product_id", F.lower(name).alias("low"), X.contains_ci(name, "ring").alias("has_ring"),
        F.lower(name).startswith("small").alias("starts_small"),
        X.words(F.concat(F.col("description"), F.lit("-x"))).alias("words"),
        X.split_trim(F.concat(F.lit(" "), name, F.lit(" , "), F.col("basket_label"), F.lit(" "))).alias("parts"),
        X.set_text(F.array("basket_type", "basket_label")).alias("set_text"),
        F.format_string("%s (%s)", name, F.col("basket_label")).alias("template"),
        F.split(F.col("description"), " ", 2)[0].rlike("^[0-9]+$").alias("digits_head"),
        F.trim(F.concat(F.lit("[Not] "), name, F.lit(" "))).alias("note"))


@register("scalars_date", with_views("""
SELECT order_id, CAST(created_at AS DATE) AS d, CAST(dayofweek(created_at) AS INTEGER) AS dow_sun0,
 CAST(isodow(created_at) - 1 AS INTEGER) AS dow_mon0, dayname(created_at) AS day_name,
 ['Pazartesi', 'Salı', 'Çarşamba', 'Perşembe', 'Cuma', 'Cumartesi', 'Pazar'][isodow(created_at)] AS gun_adi,
 CAST(hour(created_at) AS INTEGER) AS h, CAST(month(created_at) AS INTEGER) AS m,
 strftime(created_at, '%Y-%m-%d %H:%M') AS stamp, CAST(CAST(created_at AS DATE) + INTERVAL 7 DAY AS DATE) AS plus7,
 CAST(CAST(created_at AS DATE) - INTERVAL 7 DAY AS DATE) AS minus7
FROM order_f""", "order_f"))
def scalars_date(spark, sf):
    o = Fixtures(spark, sf).order_f
    ts = F.col("created_at")
    return o.select(
        "order_id", F.to_date(ts).alias("d"), X.weekday_sun0(ts).alias("dow_sun0"),
        X.weekday_mon0(ts).alias("dow_mon0"), X.weekday_name_en(ts).alias("day_name"),
        X.weekday_name_tr(ts).alias("gun_adi"), F.hour(ts).alias("h"), F.month(ts).alias("m"),
        F.date_format(ts, "yyyy-MM-dd HH:mm").alias("stamp"), F.date_add(F.to_date(ts), 7).alias("plus7"),
        F.date_sub(F.to_date(ts), 7).alias("minus7"))


@register("scalars_math", with_views("""
SELECT order_id, CAST(round(total_amount, 1) AS DOUBLE) AS r1,
 CAST(trunc(CAST(total_amount AS DOUBLE) / 1000) AS INTEGER) AS pct_int,
 CAST(greatest(1, (order_id % 9) // 2) AS BIGINT) AS group_est,
 greatest(0.5, least(0.95, (order_id % 100) / 100.0)) AS clamped,
 greatest(0.0, coalesce(temperature, 0.0) - 10) AS floor0,
 floor(sin(2 * pi() * (order_id % 7) / 7) * 1e10 + 0.5) / 1e10 AS s7
FROM order_f""", "order_f"))
def scalars_math(spark, sf):
    o = Fixtures(spark, sf).order_f
    return o.select(
        "order_id", F.round("total_amount", 1).cast("double").alias("r1"),
        (F.col("total_amount").cast("double") / 1000).cast("int").alias("pct_int"),
        X.group_estimate(F.col("order_id") % 9).alias("group_est"),
        X.clamp((F.col("order_id") % 100) / 100.0, 0.5, 0.95).alias("clamped"),
        X.clamp(F.coalesce("temperature", F.lit(0.0)) - 10, 0.0).alias("floor0"),
        (F.floor(F.sin(F.lit(2 * 3.141592653589793) * (F.col("order_id") % 7) / 7) * 1e10 + 0.5) / 1e10)
        .alias("s7"))


@register("scalars_null_map", with_views("""
SELECT order_id, coalesce(nullif(weather_condition, ''), 'Güneşli') AS weather,
 coalesce(temperature, 20.0) AS temp,
 CASE weather_condition WHEN 'Güneşli' THEN 0 WHEN 'Bulutlu' THEN 1 WHEN 'Serin' THEN 2 WHEN 'Yağmurlu' THEN 3
  WHEN 'Soğuk/Karlı' THEN 4 ELSE 2 END AS weather_code,
 TRY_CAST(substr(table_number, 6) AS INTEGER) AS table_no,
 CAST(status IN (5, 6) AS INTEGER) AS closed_flag
FROM order_f""", "order_f"))
def scalars_null_map(spark, sf):
    from tavola.operators.datasets import WEATHER_CODE
    o = Fixtures(spark, sf).order_f
    return o.select(
        "order_id", X.blank_default(F.col("weather_condition"), "Güneşli").alias("weather"),
        F.coalesce("temperature", F.lit(20.0)).alias("temp"),
        X.lookup(F.col("weather_condition"), list(WEATHER_CODE.items()), 2).alias("weather_code"),
        F.expr("try_cast(substr(table_number, 6) AS INT)").alias("table_no"),
        F.col("status").isin(5, 6).cast("int").alias("closed_flag"))


@register("scalars_array", with_views("""
SELECT order_id, list_bool_and(list_transform(sts, lambda s: s IN (5, 6))) AS all_settled,
 list_bool_or(list_transform(sts, lambda s: s = 0)) AS any_pending,
 list_sort(list_distinct(sts)) AS status_set, len(sts) AS n
FROM (SELECT order_id, list(item_status) AS sts FROM order_item_f GROUP BY order_id)""", "order_item_f"))
def scalars_array(spark, sf):
    i = Fixtures(spark, sf).order_item_f
    a = i.groupBy("order_id").agg(F.collect_list("item_status").alias("sts"))
    return a.select("order_id", F.forall("sts", lambda s: s.isin(5, 6)).alias("all_settled"),
                    F.exists("sts", lambda s: s == 0).alias("any_pending"),
                    F.array_sort(F.array_distinct("sts")).alias("status_set"), F.size("sts").alias("n"))
