"""Rule-based campaigns.

Campaign conditions are a small rule table with null-able bounds; matching
contexts (orders, terminals, hours) against it is a broadcast theta join
whose rule side has a fixed size.  Random picks from the always-on pool
use a seeded hash order, so results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions import rules as RU
from tavola.operators.text_match import contained

# Campaigns of the source -- id, title, discount percent,
# target category names, priority -- and their conditions.
COLD_WEATHER = ["Soğuk/Karlı", "Yağmurlu"]
CONTEXT_CAMPAIGNS = [
    # id, title, discount, targets, priority, condition kind, parameters
    ("cold-soup", "🍲 Soğuk Hava Kampanyası", 30, ["Çorba"], "yuksek", "cold", None, None),
    ("cold-hot-drink", "☕ Sıcak İçecek Fırsatı", 20, ["İçecek - Sıcak"], "orta", "cold", None, None),
    ("hot-cold-drink", "🧊 Serinle Kampanyası", 50, ["İçecek - Soğuk"], "yuksek", "sunny_hot", None, None),
    ("nice-weather-terrace", "☀️ Teras Keyfi", 15, ["İçecek - Soğuk"], "orta", "sunny_mild", None, None),
    ("breakfast-early", "🌅 Erken Kuş Kahvaltı", 8, ["Kahvaltı"], "yuksek", "hour", 8, 11),
    ("lunch-quick", "⚡ Öğle Hızlı Menü", 12, ["Ana Yemek", "İçecek"], "yuksek", "hour", 11, 14),
    ("afternoon-dessert", "🍰 İkindi Tatlı Keyfi", 15, ["Tatlı", "İçecek - Sıcak"], "orta", "hour", 14, 17),
    ("dinner-prime", "🍽️ Akşam Yemeği Özel", 0, ["Ana Yemek", "Tatlı"], "yuksek", "hour", 17, 21),
    ("dinner-steak", "🥩 Akşam Et Menüsü", 10, ["Ana Yemek"], "orta", "hour", 17, 21),
    ("late-night-snack", "🌙 Gece Atıştırma", 25, ["Başlangıç"], "yuksek", "hour", 21, 2),
    ("late-dessert", "🍫 Gece Tatlı Fırsatı", 18, ["Tatlı", "İçecek - Sıcak"], "orta", "hour", 21, 2),
    ("weekend-family", "👨‍👩‍👧‍👦 Hafta Sonu Aile Paketi", 0, ["Tatlı"], "orta", "weekday", 5, 6),
    ("weekend-brunch", "🥂 Hafta Sonu Brunch", 15, ["Kahvaltı", "Tatlı"], "yuksek", "weekday", 5, 6),
    ("monday-motivation", "💪 Pazartesi Motivasyon", 20, ["İçecek - Sıcak"], "yuksek", "weekday", 0, 0),
    ("tuesday-pide", "🫓 Salı Pide Günü", 15, ["Hamur İşi"], "yuksek", "weekday", 1, 1),
    ("wednesday-pasta", "🍝 Çarşamba Makarna Festivali", 15, ["Makarna"], "yuksek", "weekday", 2, 2),
    ("thursday-kebab", "🥩 Perşembe Kebap Şöleni", 10, ["Ana Yemek - Kebap"], "yuksek", "weekday", 3, 3),
    ("friday-pizza", "🍕 Cuma Pizza Partisi", 50, ["Pizza"], "yuksek", "weekday", 4, 4),
]
ALWAYS_ON_POOL = [
    ("combo-burger", "🍔 Burger Kombo", 14, ["Burger", "Başlangıç", "İçecek"], "orta"),
    ("happy-hour", "🎉 Happy Hour", 50, ["İçecek - Soğuk"], "orta"),
    ("dessert-lovers", "🎂 Tatlı Severler", 33, ["Tatlı"], "orta"),
    ("salad-fit", "🥗 Fit Menü", 10, ["Salata", "İçecek"], "dusuk"),
    ("coffee-cake", "☕ Kahve & Tatlı", 12, ["İçecek - Sıcak", "Tatlı"], "orta"),
    ("share-platter", "🍽️ Paylaşım Tabağı", 8, ["Başlangıç"], "dusuk"),
    ("new-tastes", "✨ Yeni Lezzetler", 15, ["Ana Yemek"], "orta"),
    ("loyalty-program", "⭐ Sadakat Programı", 0, [], "dusuk"),
]
PRIORITY_RANK = {"yuksek": 0, "orta": 1, "dusuk": 2}     # sort order (C3)
PRIORITY_NUMBER = {"yuksek": 1, "orta": 2, "dusuk": 3}   # API number (C9)

CAMPAIGN_SCHEMA = ("campaign_id string, title string, discount_percent int, target_categories array<string>, "
                   "priority string, kind string, p1 int, p2 int, seq int")


def campaign_rules(spark: SparkSession) -> DataFrame:
    rows = [(c[0], c[1], c[2], c[3], c[4], c[5], c[6], c[7], i) for i, c in enumerate(CONTEXT_CAMPAIGNS)]
    return spark.createDataFrame(rows, CAMPAIGN_SCHEMA)


def pool_rules(spark: SparkSession) -> DataFrame:
    rows = [(c[0], c[1], c[2], c[3], c[4], "always", None, None, i) for i, c in enumerate(ALWAYS_ON_POOL)]
    return spark.createDataFrame(rows, CAMPAIGN_SCHEMA)


def _condition(weather: Column, temp: Column, hour: Column, weekday: Column) -> Column:
    """Does a rule row hold for the context?"""
    kind, p1, p2 = F.col("kind"), F.col("p1"), F.col("p2")
    sunny = weather == F.lit("Güneşli")
    hour_in = F.when(p1 <= p2, (hour >= p1) & (hour < p2)).otherwise((hour >= p1) | (hour < p2))
    return (F.when(kind == "cold", weather.isin(*COLD_WEATHER) | (temp < 10))
             .when(kind == "sunny_hot", sunny & (temp > 25))
             .when(kind == "sunny_mild", sunny & (temp >= 15) & (temp <= 25))
             .when(kind == "hour", hour_in)
             .when(kind == "weekday", (weekday >= p1) & (weekday <= p2))
             .otherwise(F.lit(False)))


def context_campaigns(contexts: DataFrame, spark: SparkSession, key: str = "context_id") -> DataFrame:
    """Every matching context campaign per context.  ``contexts`` has
    (key, weather, temperature, hour, weekday [Mon=0])."""
    rules = F.broadcast(campaign_rules(spark))
    cond = _condition(F.col("weather"), F.col("temperature"), F.col("hour"), F.col("weekday"))
    return contexts.select(key, "weather", "temperature", "hour", "weekday").join(rules, cond)


def pool_picks(contexts: DataFrame, spark: SparkSession, seed: int, key: str = "context_id") -> DataFrame:
    """2 or 3 picks from the always-on pool per context, in the order of
    md5(context, entry, seed).  The fixed pool is sorted inside the row."""
    def hashed(*parts) -> Column:
        return F.md5(F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))

    k = F.col(key)
    count = F.lit(2) + (F.conv(F.substring(hashed(k, seed), 1, 8), 16, 10).cast("long") % 2).cast("int")
    entries = F.transform(F.sequence(F.lit(0), F.lit(len(ALWAYS_ON_POOL) - 1)),
                          lambda s: F.struct(hashed(k, s, seed).alias("h"), s.alias("seq")))
    chosen = (contexts.select(key, F.posexplode(F.slice(F.array_sort(entries), F.lit(1), count)).alias("_r", "_e"))
                      .select(key, F.col("_e.seq").alias("seq"), (F.col("_r") + 1).alias("pick_order")))
    return chosen.join(F.broadcast(pool_rules(spark)), "seq").withColumn(
        "seq", F.lit(1000) + F.col("pick_order")).drop("pick_order")


def _priority_cols() -> list[Column]:
    rank = F.coalesce(*[F.when(F.col("priority") == k, F.lit(v)) for k, v in PRIORITY_RANK.items()], F.lit(2))
    number = F.coalesce(*[F.when(F.col("priority") == k, F.lit(v)) for k, v in PRIORITY_NUMBER.items()],
                        F.lit(3))
    return [rank.alias("priority_rank"), number.alias("priority_number")]


def campaign_candidates(contexts: DataFrame, spark: SparkSession, seed: int,
                        key: str = "context_id", with_pool: bool = True) -> DataFrame:
    """All campaigns of each context in priority order (stable:
    context campaigns in list order, then pool picks in pick order)."""
    cols = [key, "campaign_id", "title", "discount_percent", "target_categories", "priority", "seq"]
    ctx = context_campaigns(contexts, spark, key).select(*cols)
    if with_pool:
        ctx = ctx.unionByName(pool_picks(contexts, spark, seed, key).select(*cols))
    return ctx.select(*cols, *_priority_cols())


def in_priority_order(candidates: DataFrame, key: str = "context_id") -> DataFrame:
    """The campaigns of each context by priority, then list position.

    Only the order's columns and the campaign's id are sorted; what the fixed rule
    tables say of the campaign is added to the sorted rows."""
    narrow = candidates.select(key, "campaign_id", "seq", "priority_rank").orderBy(key, "priority_rank", "seq")
    rules = [*CONTEXT_CAMPAIGNS, *ALWAYS_ON_POOL]
    about = F.create_map(*[F.lit(x) if isinstance(x, str) else x for c in rules for x in (c[0], F.struct(
        F.lit(c[1]).alias("title"), F.lit(c[2]).alias("discount_percent"),
        F.array(*[F.lit(t) for t in c[3]]).cast("array<string>").alias("target_categories"), F.lit(c[4]).alias("priority")))])
    rows = narrow.withColumn("_c", F.try_element_at(about, F.col("campaign_id"))).select("*", "_c.*").drop("_c")
    return rows.withColumns({n: c for n, c in zip(("priority_rank", "priority_number"), _priority_cols())}).select(*candidates.columns)


def top_campaign(candidates: DataFrame, key: str = "context_id") -> DataFrame:
    """C4: first campaign per context by (priority, list position).

    The order and the campaign's place in the fixed rule tables are one number, so tasks keep
    a number a context; what the tables say of the campaign is added to the result."""
    rules = [*CONTEXT_CAMPAIGNS, *ALWAYS_ON_POOL]
    place = F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(rules) for x in (c[0], i)]), F.col("campaign_id"))
    order = (F.col("priority_rank").cast("long") * 10 ** 6 + F.col("seq")) * len(rules) + place
    about = F.array(*[F.struct(
        F.lit(c[0]).alias("campaign_id"), F.lit(c[1]).alias("title"), F.lit(c[2]).alias("discount_percent"),
        F.array(*[F.lit(t) for t in c[3]]).cast("array<string>").alias("target_categories"),
        F.lit(PRIORITY_NUMBER.get(c[4], 3)).alias("priority_number")) for c in rules])
    best = candidates.select(key, order.alias("_order")).groupBy(key).agg(F.min("_order").alias("_order"))
    return best.withColumn("c", F.get(about, (F.col("_order") % len(rules)).cast("int"))).select(key, "c.*")


def active_campaign(log: DataFrame, key: str = "terminal_id") -> DataFrame:
    """Latest log row per terminal; NULL campaign means deactivated."""
    return log.groupBy(key).agg(F.max_by("campaign_id", F.struct("ts", "log_id")).alias("active_campaign_id"))


def all_campaigns(spark: SparkSession) -> DataFrame:
    return campaign_rules(spark).unionByName(pool_rules(spark))


def current_campaign(active: DataFrame, suggested: DataFrame, spark: SparkSession,
                     key: str = "terminal_id") -> DataFrame:
    """The active campaign when there is one, else the top suggestion."""
    catalog = F.broadcast(all_campaigns(spark).select(
        F.col("campaign_id").alias("active_campaign_id"), F.col("title").alias("a_title"),
        F.col("discount_percent").alias("a_discount"), F.col("target_categories").alias("a_targets")))
    a = active.join(catalog, "active_campaign_id", "left")
    j = a.join(suggested, key, "full")
    use_active = F.col("a_title").isNotNull()
    return j.select(
        key,
        F.when(use_active, F.col("active_campaign_id")).otherwise(F.col("campaign_id")).alias("campaign_id"),
        F.when(use_active, F.col("a_title")).otherwise(F.col("title")).alias("title"),
        F.when(use_active, F.col("a_discount")).otherwise(F.col("discount_percent")).alias("discount_percent"),
        F.when(use_active, F.col("a_targets")).otherwise(F.col("target_categories")).alias("target_categories"),
        use_active.alias("is_active"))


def target_category_ids(campaigns: DataFrame, spark: SparkSession, key: str = "campaign_id") -> DataFrame:
    """Target names -> category ids by case-insensitive substring."""
    frag = RU.campaign_category_df(spark).withColumn("fragment", F.lower("fragment"))
    t = campaigns.select(key, F.explode("target_categories").alias("target")).withColumn("target", F.lower("target"))
    hits = t.join(contained(t, "target", frag, "fragment"), "target").join(frag, "fragment")
    ids = hits.groupBy(key).agg(F.array_sort(F.collect_set("category_id")).alias("target_ids"))
    return campaigns.select(key).distinct().join(ids, key, "left").withColumn(
        "target_ids", F.coalesce("target_ids", F.array().cast("array<int>")))


def campaign_categories(campaigns: DataFrame, categories: DataFrame, key: str = "context_id") -> DataFrame:
    """Per campaign the categories whose name contains a target (ignoring case)."""
    targets = campaigns.select(key, F.explode("target_categories").alias("target")).withColumn("target", F.lower("target"))
    named = categories.select("category_id", "category_name", F.lower("category_name").alias("name"))
    hits = contained(named, "name", targets, "target").join(named, "name").select("target", "category_id", "category_name")
    return targets.join(hits, "target").select(key, "category_id", "category_name").distinct()


def matches_category(category_name: Column, targets: Column) -> Column:
    """The category name contains any target (ignoring case)."""
    return F.coalesce(F.exists(targets, lambda t: F.lower(category_name).contains(F.lower(t))), F.lit(False))


def cart_discount(cart: DataFrame, campaign: DataFrame, key: str = "cart_id") -> DataFrame:
    """sum(price x qty x pct / 100) over lines in matching categories.
    ``cart``: (key, product_id, quantity, price, category_name)."""
    c = cart.join(campaign.select(key, "discount_percent", "target_categories"), key, "left")
    hit = (F.col("discount_percent") > 0) & matches_category(F.col("category_name"), F.col("target_categories"))
    line = F.when(hit, (F.col("price") * F.col("quantity") * F.col("discount_percent") / 100)).otherwise(
        F.lit(0))
    return c.groupBy(key).agg(F.sum(line).cast("decimal(18,2)").alias("discount"))


def discounted_lines(cart: DataFrame, campaign: DataFrame, key: str = "cart_id") -> DataFrame:
    """Order lines with the discounted unit price and a campaign note."""
    c = cart.join(campaign.select(key, "discount_percent", "target_categories"), key, "left")
    hit = (F.coalesce(F.col("discount_percent"), F.lit(0)) > 0) & matches_category(
        F.col("category_name"), F.col("target_categories"))
    note = F.coalesce(F.col("note"), F.lit("")) if "note" in cart.columns else F.lit("")
    new_price = F.col("price") - F.col("price") * F.col("discount_percent") / 100
    return c.select(key, "product_id", "quantity",
                    F.when(hit, new_price).otherwise(F.col("price")).cast("decimal(18,2)").alias("unit_price"),
                    F.when(hit, F.trim(F.concat(F.lit("[Kampanya %"), F.col("discount_percent").cast("string"),
                                                F.lit("] "), note))).otherwise(note).alias("note"))
