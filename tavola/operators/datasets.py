"""Derived datasets: order summary export, basket files, daily training frames.

Per-order text columns are built with one shuffle on ``order_id`` (the items
are already clustered by order after the item-key window), the daily frames
are two-level aggregates (per order, then per day) so no COUNT DISTINCT
expansion is needed and the day-level shuffle sees one row per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import exprs as X

# Export constants and the model's encodings.
EXPORT_AGE_GROUP = "25-34"
EXPORT_GROUP_SIZE = 2
EXPORT_WEATHER_DEFAULT = "Güneşli"
EXPORT_TEMPERATURE_DEFAULT = 20.0
UNKNOWN_PRODUCT = "Ürün"
WEATHER_CODE = {"Güneşli": 0, "Bulutlu": 1, "Serin": 2, "Yağmurlu": 3, "Soğuk/Karlı": 4}
AGE_CODE = {"18-24": 0, "25-34": 1, "35-44": 2, "45-54": 3, "55+": 4}
MONTH_TEMPERATURE = {1: 5, 2: 7, 3: 12, 4: 17, 5: 22, 6: 28, 7: 32, 8: 31, 9: 26, 10: 20,
                     11: 13, 12: 7}


def _named_items(items: DataFrame, products: DataFrame) -> DataFrame:
    return (items.join(products.select("product_id", "product_name"), "product_id", "left")
                 .withColumn("product_name", F.coalesce("product_name", F.lit(UNKNOWN_PRODUCT))))


def order_contents(items: DataFrame, products: DataFrame) -> DataFrame:
    """Per order: item count, "qty name, qty name" text and the name list,
    in item-id order."""
    named = _named_items(items, products)
    per_order = named.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("urun_sayisi"),
        F.array_sort(F.collect_list(F.struct("item_id", "quantity", "product_name"))).alias("_lines"))
    return per_order.select(
        "order_id", "urun_sayisi",
        F.array_join(F.transform("_lines", lambda x: F.concat(x["quantity"].cast("string"), F.lit(" "),
                                                               x["product_name"])), ", ").alias("siparis_icerigi"),
        F.transform("_lines", lambda x: x["product_name"]).alias("names"))


# --------------------------------------------------------------------------- S5
def order_summary(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """The 17-column order summary (export form) for every order."""
    contents = order_contents(items, products).drop("names")
    o = orders.join(contents, "order_id", "left")
    ts = F.col("created_at")
    return o.select(
        F.col("order_id").alias("siparis_id"),
        F.col("table_number").alias("qr_masa_id"),
        F.date_format(ts, "yyyy-MM-dd HH:mm").alias("tarih_saat"),
        X.weekday_name_en(ts).alias("gun"),
        F.hour(ts).alias("saat"),
        F.month(ts).alias("ay"),
        F.dayofweek(ts).isin(1, 7).cast("int").alias("hafta_sonu"),
        F.lit(None).cast("string").alias("ozel_gun"),
        F.lit(EXPORT_AGE_GROUP).alias("yas_grubu"),
        F.lit(EXPORT_GROUP_SIZE).alias("kisi_sayisi"),
        X.blank_default(F.col("weather_condition"), EXPORT_WEATHER_DEFAULT).alias("hava_durumu"),
        F.coalesce(F.col("temperature"), F.lit(EXPORT_TEMPERATURE_DEFAULT)).alias("sicaklik_c"),
        F.round(F.col("total_amount"), 1).cast("double").alias("toplam_tutar"),
        F.lit(0).alias("ikram_var"),
        F.lit(0).alias("iptal_var"),
        F.coalesce(F.col("urun_sayisi"), F.lit(0)).cast("long").alias("urun_sayisi"),
        F.coalesce(F.col("siparis_icerigi"), F.lit("")).alias("siparis_icerigi"))


# --------------------------------------------------------------------------- S6
def basket_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """One text line per order that has items: product names joined by ','."""
    c = order_contents(items, products)
    return c.select("order_id", F.array_join("names", ",").alias("line"))


# --------------------------------------------------------------------------- S7/A15
def basket_presence(items: DataFrame, products: DataFrame, label: str) -> DataFrame:
    """Long form of the one-hot matrix: (order, label) present once."""
    return (items.join(products.select("product_id", label), "product_id")
                 .groupBy("order_id", label).agg(F.count(F.lit(1)).alias("_n"))
                 .filter(F.col("_n") > 0).drop("_n"))


LABELS_A_WORD = 62


def basket_onehot(items: DataFrame, products: DataFrame, label: str,
                  values: list[str] | None = None) -> DataFrame:
    """Order x label 0/1 matrix, one column per label of ``values``.  Without
    a list the matrix stays in its long form (order, label), which has no
    bound on the number of labels and collects none to the driver.

    An order's labels are gathered as bits, a number for each ``LABELS_A_WORD`` labels,
    so a task holds a few bytes an order; the columns are made from the bits."""
    if values is None:
        return basket_presence(items, products, label)
    words = [values[i:i + LABELS_A_WORD] for i in range(0, len(values), LABELS_A_WORD)]
    bits = [F.coalesce(X.lookup(F.col(label), [(v, 1 << i) for i, v in enumerate(w)], 0), F.lit(0)).cast("long") for w in words]
    sets = (items.join(products.select("product_id", label), "product_id")
                 .select("order_id", *[b.alias(f"_w{k}") for k, b in enumerate(bits)])
                 .groupBy("order_id").agg(*[F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(len(words))]))
    return sets.select("order_id", *[F.shiftright(f"_w{k}", i).bitwiseAND(F.lit(1)).cast("int").alias(v)
                                     for k, w in enumerate(words) for i, v in enumerate(w)])


# --------------------------------------------------------------------------- A16
def order_features(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sync form of the order summary (customer columns dropped, D3)."""
    counts = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("urun_sayisi"))
    o = orders.join(counts, "order_id", "left").withColumn(
        "urun_sayisi", F.coalesce("urun_sayisi", F.lit(0)).cast("long"))
    gun = X.weekday_sun0(F.col("created_at"))
    return o.select(
        F.col("order_id").alias("siparis_id"), F.col("total_amount").alias("toplam_tutar"),
        F.hour("created_at").alias("saat"), gun.alias("gun_no"),
        F.col("weather_condition").alias("hava_durumu"), F.col("temperature").alias("sicaklik_c"),
        "urun_sayisi", gun.isin(0, 6).cast("int").alias("hafta_sonu"),
        X.group_estimate(F.col("urun_sayisi")).alias("kisi_sayisi"),
        F.lit(EXPORT_AGE_GROUP).alias("yas_grubu"))


# --------------------------------------------------------------------------- A9
def daily_from_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Daily training rows from orders joined to items, status >= 1.

    Kept from the source: the mean temperature is over joined rows (weighted
    by item count) and the weather is one order's label (D8: the smallest
    order id of the day).  Done as per-order then per-day aggregation."""
    per_order = (items.groupBy("order_id")
                      .agg(F.sum(F.col("unit_price") * F.col("quantity")).alias("rev"),
                           F.count(F.lit(1)).alias("n")))
    o = (orders.filter(F.col("status") >= 1)
               .select("order_id", "created_at", "weather_condition", "temperature")
               .join(per_order, "order_id"))
    day = o.groupBy(F.to_date("created_at").alias("tarih")).agg(
        F.sum("rev").cast("double").alias("toplam_ciro"),
        F.count(F.lit(1)).alias("siparis_sayisi"),
        F.min_by(F.coalesce("weather_condition", F.lit(EXPORT_WEATHER_DEFAULT)), F.col("order_id")).alias("hava"),
        (F.sum(F.col("temperature") * F.col("n"))
         / F.sum(F.when(F.col("temperature").isNotNull(), F.col("n")))).alias("sicaklik"))
    return day.withColumn("sicaklik", F.round("sicaklik", 6)).withColumn("kaynak", F.lit("db"))


# --------------------------------------------------------------------------- A10/A11
def daily_from_summary(summary: DataFrame) -> DataFrame:
    """Daily rows from the exported summary: sum, count, modal weather
    (smallest label on ties), mean temperature."""
    s = summary.withColumn("tarih", F.to_date(F.to_timestamp("tarih_saat", "yyyy-MM-dd HH:mm")))
    day = s.groupBy("tarih").agg(
        F.sum("toplam_tutar").alias("toplam_ciro"),
        F.count("siparis_id").alias("siparis_sayisi"),
        F.mode("hava_durumu", deterministic=True).alias("hava"),
        F.avg("sicaklik_c").alias("sicaklik"))
    return (day.withColumn("toplam_ciro", F.round("toplam_ciro", 6))
               .withColumn("sicaklik", F.round("sicaklik", 6))
               .withColumn("kaynak", F.lit("csv")))


def mode_by(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key, smallest value on ties."""
    return df.groupBy(key).agg(F.mode(value, deterministic=True).alias(out))


# --------------------------------------------------------------------------- U1/J7
def daily_training(primary: DataFrame, baseline: DataFrame) -> DataFrame:
    """Primary rows win per date; baseline fills dates the primary lacks."""
    cols = ["tarih", "toplam_ciro", "siparis_sayisi", "hava", "sicaklik", "kaynak"]
    only_base = baseline.join(primary.select("tarih"), "tarih", "left_anti")
    return primary.select(*cols).unionByName(only_base.select(*cols))


# --------------------------------------------------------------------------- A19
def training_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy("kaynak").agg(
        F.count(F.lit(1)).alias("days"),
        F.concat(F.min("tarih").cast("string"), F.lit(" → "), F.max("tarih").cast("string")).alias("date_range"),
        F.round(F.sum("toplam_ciro"), 2).alias("total_revenue"))
