"""Dataset, export and training-frame queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola.operators import datasets as D
from tavola.operators import reports as R
from tavola.plans.registry import register
from tavola.session import scratch_path
from tavola.sources import files
from tavola.sources.fixtures import Fixtures, with_views

SUMMARY_CTES = {
    "named": """
 SELECT i.order_id, i.item_id, i.quantity, coalesce(p.product_name, 'Ürün') AS product_name
 FROM order_item_f i LEFT JOIN product_f p ON p.product_id = i.product_id""",
    "contents": """
 SELECT order_id, COUNT(*) AS urun_sayisi,
  string_agg(CAST(quantity AS VARCHAR) || ' ' || product_name, ', ' ORDER BY item_id) AS siparis_icerigi,
  string_agg(product_name, ',' ORDER BY item_id) AS line
 FROM named GROUP BY order_id""",
    "summary": """
 SELECT o.order_id AS siparis_id, o.table_number AS qr_masa_id,
  strftime(o.created_at, '%Y-%m-%d %H:%M') AS tarih_saat, dayname(o.created_at) AS gun,
  CAST(hour(o.created_at) AS INTEGER) AS saat, CAST(month(o.created_at) AS INTEGER) AS ay,
  CAST(dayofweek(o.created_at) IN (0, 6) AS INTEGER) AS hafta_sonu, CAST(NULL AS VARCHAR) AS ozel_gun,
  '25-34' AS yas_grubu, 2 AS kisi_sayisi,
  coalesce(nullif(o.weather_condition, ''), 'Güneşli') AS hava_durumu,
  coalesce(o.temperature, 20.0) AS sicaklik_c, CAST(round(o.total_amount, 1) AS DOUBLE) AS toplam_tutar,
  0 AS ikram_var, 0 AS iptal_var, coalesce(c.urun_sayisi, 0) AS urun_sayisi,
  coalesce(c.siparis_icerigi, '') AS siparis_icerigi
 FROM order_f o LEFT JOIN contents c ON c.order_id = o.order_id"""}

SUMMARY_VIEWS = ("order_f", "order_item_f", "product_f")


def _summary(spark, sf):
    fx = Fixtures(spark, sf)
    return D.order_summary(fx.order_f, fx.order_item_f, fx.product_f)


def _summary_sql(body, extra=None):
    return with_views(body, *SUMMARY_VIEWS, extra={**SUMMARY_CTES, **(extra or {})})


@register("order_summary", _summary_sql("SELECT * FROM summary"))
def order_summary(spark, sf):
    return _summary(spark, sf)


@register("csv_roundtrip", _summary_sql("SELECT * FROM summary"))
def csv_roundtrip(spark, sf):
    """S3: write the summary as quoted CSV with header, read it back with the
    declared schema."""
    path = scratch_path(spark, f"csv_roundtrip/{uuid.uuid4().hex}")
    files.write_csv(_summary(spark, sf), path)
    return files.read_csv(spark, path, files.SUMMARY_SCHEMA)


@register("json_roundtrip", with_views("""
SELECT CAST(created_at AS DATE) AS sale_date,
 CAST(SUM(total_amount) AS DECIMAL(38,2)) AS total_amount, COUNT(*) AS order_count
FROM order_f WHERE status = 5 GROUP BY 1""", "order_f"))
def json_roundtrip(spark, sf):
    """Daily sales written as JSON, read back with a declared schema."""
    path = scratch_path(spark, f"json_roundtrip/{uuid.uuid4().hex}")
    files.write_json(R.daily_sales(Fixtures(spark, sf).order_f), path)
    return files.read_json(spark, path, "sale_date date, total_amount decimal(38,2), order_count long")


@register("basket_lines", _summary_sql("SELECT order_id, line FROM contents"))
def basket_lines(spark, sf):
    fx = Fixtures(spark, sf)
    return D.basket_lines(fx.order_item_f, fx.product_f)


# The basket labels of the test products (the form is Brand#nm, n and m 1 to 5).
BASKET_LABELS = [f"Brand#{n}{m}" for n in range(1, 6) for m in range(1, 6)]
PRESENCE = """SELECT DISTINCT i.order_id, p.basket_label FROM order_item_f i
  JOIN product_f p ON p.product_id = i.product_id"""


@register("basket_onehot", with_views("SELECT order_id, " + ", ".join(
    f"max(CASE WHEN basket_label = '{v}' THEN 1 ELSE 0 END) AS \"{v}\"" for v in BASKET_LABELS)
    + " FROM presence GROUP BY order_id", "order_item_f", "product_f", extra={"presence": PRESENCE}))
def basket_onehot(spark, sf):
    fx = Fixtures(spark, sf)
    return D.basket_onehot(fx.order_item_f, fx.product_f, "basket_label", BASKET_LABELS)


@register("basket_presence", with_views(PRESENCE, "order_item_f", "product_f"))
def basket_presence(spark, sf):
    """S7/A15 in the long form, for any number of labels."""
    fx = Fixtures(spark, sf)
    return D.basket_onehot(fx.order_item_f, fx.product_f, "basket_label")


@register("order_features", with_views("""
SELECT o.order_id AS siparis_id, o.total_amount AS toplam_tutar, CAST(hour(o.created_at) AS INTEGER) AS saat,
 CAST(dayofweek(o.created_at) AS INTEGER) AS gun_no, o.weather_condition AS hava_durumu,
 o.temperature AS sicaklik_c, coalesce(c.n, 0) AS urun_sayisi,
 CAST(dayofweek(o.created_at) IN (0, 6) AS INTEGER) AS hafta_sonu,
 CAST(greatest(1, coalesce(c.n, 0) // 2) AS BIGINT) AS kisi_sayisi, '25-34' AS yas_grubu
FROM order_f o LEFT JOIN (SELECT order_id, COUNT(*) AS n FROM order_item_f GROUP BY order_id) c
 ON c.order_id = o.order_id""", "order_f", "order_item_f"))
def order_features(spark, sf):
    fx = Fixtures(spark, sf)
    return D.order_features(fx.order_f, fx.order_item_f)


DAILY_DB_CTE = {"db_daily": """
 SELECT CAST(o.created_at AS DATE) AS tarih,
  CAST(SUM(i.unit_price * i.quantity) AS DOUBLE) AS toplam_ciro,
  COUNT(DISTINCT o.order_id) AS siparis_sayisi,
  arg_min(coalesce(o.weather_condition, 'Güneşli'), o.order_id) AS hava,
  round(AVG(o.temperature), 6) AS sicaklik, 'db' AS kaynak
 FROM order_f o JOIN order_item_f i ON i.order_id = o.order_id
 WHERE o.status >= 1 GROUP BY 1"""}

DAILY_CSV_CTE = {"csv_daily": """
 SELECT CAST(strptime(tarih_saat, '%Y-%m-%d %H:%M') AS DATE) AS tarih,
  round(SUM(toplam_tutar), 6) AS toplam_ciro, COUNT(siparis_id) AS siparis_sayisi,
  round(AVG(sicaklik_c), 6) AS sicaklik, 'csv' AS kaynak
 FROM summary GROUP BY 1""",
                 "csv_mode": """
 SELECT tarih, hava FROM (
  SELECT CAST(strptime(tarih_saat, '%Y-%m-%d %H:%M') AS DATE) AS tarih, hava_durumu AS hava,
   row_number() OVER (PARTITION BY CAST(strptime(tarih_saat, '%Y-%m-%d %H:%M') AS DATE)
                      ORDER BY COUNT(*) DESC, hava_durumu) AS rn
  FROM summary GROUP BY 1, 2) WHERE rn = 1""",
                 "csv_final": """
 SELECT c.tarih, c.toplam_ciro, c.siparis_sayisi, m.hava, c.sicaklik, c.kaynak
 FROM csv_daily c JOIN csv_mode m ON m.tarih = c.tarih"""}


@register("daily_from_orders", with_views("SELECT * FROM db_daily", "order_f", "order_item_f",
                                          extra=DAILY_DB_CTE))
def daily_from_orders(spark, sf):
    fx = Fixtures(spark, sf)
    return D.daily_from_orders(fx.order_f, fx.order_item_f)


@register("daily_from_summary", _summary_sql("SELECT * FROM csv_final", extra=DAILY_CSV_CTE))
def daily_from_summary(spark, sf):
    return D.daily_from_summary(_summary(spark, sf)).select(
        "tarih", "toplam_ciro", "siparis_sayisi", "hava", "sicaklik", "kaynak")


@register("mode_hour", _summary_sql("""
SELECT gun, saat AS peak_hour FROM (
 SELECT gun, saat, row_number() OVER (PARTITION BY gun ORDER BY COUNT(*) DESC, saat) AS rn
 FROM summary GROUP BY gun, saat) WHERE rn = 1"""))
def mode_hour(spark, sf):
    return D.mode_by(_summary(spark, sf), "gun", "saat", "peak_hour")


TRAINING_EXTRA = {**DAILY_DB_CTE, **DAILY_CSV_CTE, "training": """
 SELECT tarih, toplam_ciro, siparis_sayisi, hava, sicaklik, kaynak FROM db_daily
 UNION ALL
 SELECT tarih, toplam_ciro, siparis_sayisi, hava, sicaklik, kaynak FROM csv_final
 WHERE tarih NOT IN (SELECT tarih FROM db_daily)"""}


def _training(spark, sf):
    fx = Fixtures(spark, sf)
    primary = D.daily_from_orders(fx.order_f, fx.order_item_f)
    baseline = D.daily_from_summary(D.order_summary(fx.order_f, fx.order_item_f, fx.product_f))
    return D.daily_training(primary, baseline)


@register("daily_training", _summary_sql("SELECT * FROM training", extra=TRAINING_EXTRA))
def daily_training(spark, sf):
    return _training(spark, sf)


@register("training_stats", _summary_sql("""
SELECT kaynak, COUNT(*) AS days,
 CAST(min(tarih) AS VARCHAR) || ' → ' || CAST(max(tarih) AS VARCHAR) AS date_range,
 round(SUM(toplam_ciro), 2) AS total_revenue
FROM training GROUP BY kaynak""", extra=TRAINING_EXTRA))
def training_stats(spark, sf):
    return D.training_stats(_training(spark, sf))


@register("order_stats", _summary_sql("""
SELECT COUNT(*) AS total_orders, round(SUM(toplam_tutar), 2) AS total_revenue,
 round(AVG(toplam_tutar), 2) AS average_order,
 strftime(min(strptime(tarih_saat, '%Y-%m-%d %H:%M')), '%Y-%m-%d') || ' - ' ||
 strftime(max(strptime(tarih_saat, '%Y-%m-%d %H:%M')), '%Y-%m-%d') AS date_range
FROM summary"""))
def order_stats(spark, sf):
    s = _summary(spark, sf).withColumn("tarih_saat", F.to_timestamp("tarih_saat", "yyyy-MM-dd HH:mm"))
    return (R.order_stats(s).withColumn("total_revenue", F.round("total_revenue", 2))
             .withColumn("average_order", F.round("average_order", 2)))


@register("top_product_mentions", _summary_sql("""
SELECT product_name, COUNT(*) AS mentions FROM (
 SELECT CASE WHEN regexp_full_match(split_part(e, ' ', 1), '[0-9]+') AND strpos(e, ' ') > 0
   THEN substr(e, strpos(e, ' ') + 1) ELSE e END AS product_name
 FROM (SELECT trim(unnest(string_split(siparis_icerigi, ','))) AS e FROM summary) WHERE e <> '')
GROUP BY product_name ORDER BY mentions DESC, product_name LIMIT 10"""))
def top_product_mentions(spark, sf):
    return R.top_product_mentions(_summary(spark, sf), 10)
