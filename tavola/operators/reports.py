"""Sales reports, dashboard KPIs, projections, filters and lookups.

Operators take DataFrames (orders, items, products, categories, tables ...)
and parameters, and return DataFrames.  Large inputs are aggregated before
they are joined to dimensions (items -> per product -> category), so the big
shuffle is the partial-aggregated one.  Only fixed-size inputs (the category
list) are broadcast by hint; product and table dimensions are left to AQE,
which broadcasts them only when their runtime size is under the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import exprs as X

ACTIVE_STATES = (X.CONFIRMED, X.PREPARING, X.READY)
CLOSED_STATES = (X.PAID, X.CANCELLED)
PENDING_STATES = (X.PENDING, X.AWAITING)


def paid_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items of Paid orders (semi join: no order columns are carried)."""
    paid = orders.filter(F.col("status") == X.PAID).select("order_id")
    return items.join(paid, "order_id", "left_semi")


# --------------------------------------------------------------------------- A1
def daily_sales(orders: DataFrame, start=None, end=None) -> DataFrame:
    """Paid orders per calendar day: revenue and order count, by date."""
    o = orders.filter(F.col("status") == X.PAID)
    d = F.to_date("created_at")
    if start is not None:
        o = o.filter(d >= F.lit(start).cast("date"))
    if end is not None:
        o = o.filter(d <= F.lit(end).cast("date"))
    return (o.groupBy(d.alias("sale_date"))
             .agg(X.money_sum(F.col("total_amount")).alias("total_amount"),
                  F.count(F.lit(1)).alias("order_count")))


# --------------------------------------------------------------------------- A2/W1
def top_products(orders: DataFrame, items: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """Top ``n`` products of Paid orders by revenue; unknown name -> default."""
    per_product = (paid_items(orders, items)
                   .groupBy("product_id")
                   .agg(F.sum("quantity").alias("total_quantity"),
                        X.money_sum(F.col("quantity") * F.col("unit_price")).alias("total_revenue")))
    named = per_product.join(products.select("product_id", "product_name"), "product_id", "left")
    return (named.select("product_id",
                         F.coalesce("product_name", F.lit("Bilinmeyen Ürün")).alias("product_name"),
                         "total_quantity", "total_revenue")
                 .orderBy(F.desc("total_revenue"), F.asc("product_id"))
                 .limit(n))


# --------------------------------------------------------------------------- A3/W8
def category_share(orders: DataFrame, items: DataFrame, products: DataFrame,
                   categories: DataFrame) -> DataFrame:
    """Revenue per category name and its percent of the total (Paid only).

    Items are pre-aggregated per product before the product join, so the join
    input is one row per product, not per line."""
    per_product = (paid_items(orders, items)
                   .groupBy("product_id")
                   .agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("rev")))
    cats = categories.select("category_id", "category_name")
    with_cat = (per_product
                .join(products.select("product_id", "category_id"), "product_id", "left")
                .join(cats, "category_id", "left"))
    per_cat = (with_cat.groupBy(F.coalesce("category_name", F.lit("Diğer")).alias("category_name"))
                       .agg(X.money_sum(F.col("rev")).alias("total_revenue")))
    total = per_cat.agg(F.sum("total_revenue")).scalar()   # one row per category name -> scalar
    return (per_cat.withColumn("_total", total)
                   .filter(F.col("_total") != 0)
                   .select("category_name", "total_revenue",
                           (F.col("total_revenue").cast("double") / F.col("_total").cast("double")
                            * 100).alias("percentage")))


# --------------------------------------------------------------------------- A4
def report_summary(daily: DataFrame) -> DataFrame:
    """Total revenue, order count and average basket (0 when no orders)."""
    return daily.agg(
        F.coalesce(X.money_sum(F.col("total_amount")), F.lit(0).cast("decimal(38,2)")).alias("total_revenue"),
        F.coalesce(F.sum("order_count"), F.lit(0)).cast("long").alias("order_count"),
    ).select("total_revenue", "order_count",
             F.when(F.col("order_count") > 0,
                    F.col("total_revenue").cast("double") / F.col("order_count"))
              .otherwise(F.lit(0.0)).alias("average_basket"))


# --------------------------------------------------------------------------- A6/J4
def table_occupancy(tables: DataFrame, orders: DataFrame) -> DataFrame:
    """Per table: any active order, any Pending order, summed totals, oldest
    active order id.  Active = not Paid and not Cancelled.  Orders are
    aggregated per table number first, then left-joined to tables."""
    active = orders.filter(~F.col("status").isin(*CLOSED_STATES))
    per_table = active.groupBy("table_number").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max((F.col("status") == X.PENDING).cast("int")).alias("_pending"),
        X.money_sum(F.col("total_amount")).alias("current_order_amount"),
        F.min_by("order_id", F.struct("created_at", "order_id")).alias("current_order_id"))
    return (tables.join(per_table, "table_number", "left")
                  .select("table_id", "table_number", "capacity",
                          F.col("_n").isNotNull().alias("is_occupied"),
                          F.coalesce(F.col("_pending") == 1, F.lit(False)).alias("has_pending_order"),
                          "current_order_id",
                          F.coalesce("current_order_amount",
                                     F.lit(0).cast("decimal(38,2)")).alias("current_order_amount")))


# --------------------------------------------------------------------------- P15
def table_state(occupancy: DataFrame) -> DataFrame:
    """First match: pending, occupied, empty."""
    state = (F.when(F.col("has_pending_order"), F.lit("pending"))
              .when(F.col("is_occupied"), F.lit("occupied")).otherwise(F.lit("empty")))
    return occupancy.select("table_id", "table_number", state.alias("state"))


# --------------------------------------------------------------------------- A7
def table_counts(occupancy: DataFrame) -> DataFrame:
    return occupancy.agg(
        F.count_if(~F.col("is_occupied")).alias("empty_tables"),
        F.count_if(F.col("is_occupied")).alias("occupied_tables"),
        F.count_if(F.col("has_pending_order")).alias("pending_tables"))


# --------------------------------------------------------------------------- A5
def dashboard_kpis(occupancy: DataFrame, orders: DataFrame, today) -> DataFrame:
    t = occupancy.agg(F.count(F.lit(1)).alias("total_tables"),
                      F.count_if(F.col("is_occupied")).alias("occupied_tables"))
    o = orders.agg(
        F.count_if(F.col("status").isin(*PENDING_STATES)).alias("pending_orders"),
        F.coalesce(X.money_sum(F.when((F.to_date("created_at") == F.lit(today).cast("date"))
                                      & (F.col("status") == X.PAID), F.col("total_amount"))),
                   F.lit(0).cast("decimal(38,2)")).alias("daily_revenue"))
    return t.select("*", *[o.select(c).scalar().alias(c) for c in o.columns])


# --------------------------------------------------------------------------- A8/L2
def order_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        X.money_sum(F.col("quantity") * F.col("unit_price")).alias("total_amount"))


# --------------------------------------------------------------------------- J1
def order_lines_wide(orders, items, products, categories) -> DataFrame:
    """order -> items -> product -> category, all outer to the left."""
    cats = categories.select("category_id", "category_name", "station_id")
    return (orders.select("order_id", "table_number", "status", "created_at")
                  .join(items.select("item_id", "order_id", "product_id", "quantity", "unit_price",
                                     "item_status"), "order_id", "left")
                  .join(products.select("product_id", "product_name", "category_id"), "product_id", "left")
                  .join(cats, "category_id", "left")
                  .select("order_id", "table_number", "status", "item_id", "product_id",
                          F.coalesce("product_name", F.lit("Bilinmeyen Ürün")).alias("product_name"),
                          "category_id", F.coalesce("category_name", F.lit("Diğer")).alias("category_name"),
                          "station_id", "quantity", "unit_price", "item_status"))


# --------------------------------------------------------------------------- P4
def order_documents(orders, items, products) -> DataFrame:
    """Order with its nested list of items (array of structs, sorted by item)."""
    lines = (items.join(products.select("product_id", "product_name"), "product_id", "left")
                  .select("order_id", F.struct(
                      "item_id", "product_id",
                      F.coalesce("product_name", F.lit("Bilinmeyen Ürün")).alias("product_name"),
                      "quantity", "unit_price", "item_status").alias("line")))
    nested = lines.groupBy("order_id").agg(F.array_sort(F.collect_list("line")).alias("items"))
    return (orders.select("order_id", "table_number", "status", "total_amount", "created_at")
                  .join(nested, "order_id", "left")
                  .withColumn("items", F.coalesce("items", F.array().cast(nested.schema["items"].dataType))))


# --------------------------------------------------------------------------- J5
def station_queue(orders, items, products, categories, station_id: int | None = None) -> DataFrame:
    """Kitchen queue: live orders, item's category on the station, item not
    Delivered / Ready / AwaitingApproval.  ``station_id=None`` = every station."""
    live = orders.filter(~F.col("status").isin(*CLOSED_STATES)).select("order_id", "table_number")
    cats = categories.select("category_id", "station_id")
    if station_id is not None:
        cats = cats.filter(F.col("station_id") == station_id)
    todo = items.filter(~F.col("item_status").isin(X.DELIVERED, X.READY, X.AWAITING))
    return (todo.join(live, "order_id")
                .join(products.select("product_id", "product_name", "category_id"), "product_id")
                .join(cats, "category_id")
                .select("station_id", "item_id", "order_id", "table_number", "product_id",
                        "product_name", "quantity", "unit_price",
                        F.col("item_status").alias("station_status")))


# --------------------------------------------------------------------------- W2
def recent_orders(orders: DataFrame, n: int = 5) -> DataFrame:
    return (orders.select("order_id", "table_number", "status", "total_amount", "created_at")
                  .orderBy(F.desc("created_at"), F.desc("order_id")).limit(n))


# --------------------------------------------------------------------------- W3/W4
def active_order_per_table(orders: DataFrame, newest: bool) -> DataFrame:
    """Newest (W3) or oldest (W4) active order per table, via max_by/min_by
    (a partial aggregate, no per-table sort of all rows)."""
    active = orders.filter(~F.col("status").isin(*CLOSED_STATES))
    key = F.struct("created_at", "order_id")
    pick = F.max_by if newest else F.min_by
    return active.groupBy("table_number").agg(
        pick("order_id", key).alias("order_id"),
        pick("created_at", key).alias("created_at"),
        pick("status", key).alias("status"))


# --------------------------------------------------------------------------- P8
def order_tab(orders: DataFrame, tab: str) -> DataFrame:
    states = {"active": ACTIVE_STATES, "pending": (X.PENDING,), "completed": CLOSED_STATES}
    return orders.filter(F.col("status").isin(*states[tab])) if tab in states else orders


def order_tabs(orders: DataFrame) -> DataFrame:
    """Counts of each tab (active, pending, completed, all) in one pass."""
    return orders.agg(
        F.count_if(F.col("status").isin(*ACTIVE_STATES)).alias("active"),
        F.count_if(F.col("status") == X.PENDING).alias("pending"),
        F.count_if(F.col("status").isin(*CLOSED_STATES)).alias("completed"),
        F.count(F.lit(1)).alias("all_orders"))


# --------------------------------------------------------------------------- P5/P6/P7
def menu_filter(products: DataFrame, term: str | None, category_id: int | None = None) -> DataFrame:
    p = products.filter(F.col("is_active"))
    if category_id is not None:
        p = p.filter(F.col("category_id") == category_id)
    if term and term.strip():
        p = p.filter(X.contains_ci(F.col("product_name"), term))
    return p


def _any_term(df: DataFrame, terms: tuple[str, ...], match) -> DataFrame:
    """Rows that one of the terms matches; a blank term matches all."""
    if any(not t or not t.strip() for t in terms):
        return df
    return df.filter(F.coalesce(reduce(lambda a, b: a | b, map(match, terms)), F.lit(False)))


def menu_search(products: DataFrame, *terms: str) -> DataFrame:
    return _any_term(products, terms, lambda t: X.contains_ci(F.col("product_name"), t)
                     | F.coalesce(X.contains_ci(F.col("description"), t), F.lit(False)))


def staff_search(staff: DataFrame, *terms: str) -> DataFrame:
    full = F.concat_ws(" ", "name", "surname")
    return _any_term(staff, terms, lambda t: X.contains_ci(full, t) | F.coalesce(F.col("phone").contains(t), F.lit(False)))


def staff_public(staff: DataFrame) -> DataFrame:
    """Everything but the secret column."""
    return staff.drop("password_hash")


# --------------------------------------------------------------------------- P13
def unpaid_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items not Paid / Cancelled, and per order the remaining amount
    (total - paid), where the paid amount starts at the total for Paid orders."""
    o = orders.select("order_id", "total_amount",
                      F.when(F.col("status") == X.PAID, F.col("total_amount"))
                       .otherwise(F.lit(0).cast("decimal(18,2)")).alias("paid_amount"))
    open_items = (items.filter(~F.col("item_status").isin(*CLOSED_STATES))
                       .groupBy("order_id")
                       .agg(F.count(F.lit(1)).alias("unpaid_item_count"),
                            X.money_sum(F.col("quantity") * F.col("unit_price")).alias("unpaid_value")))
    return (o.join(open_items, "order_id")
             .select("order_id", "unpaid_item_count", "unpaid_value",
                     (F.col("total_amount") - F.col("paid_amount")).alias("remaining_amount")))


# --------------------------------------------------------------------------- P18
def stock_check(new_lines: DataFrame, products: DataFrame, key: str = "line_id") -> DataFrame:
    """A request (group of lines) with any known but unavailable product is
    rejected; unknown products pass.  One row per request with accepted flag."""
    avail = products.select("product_id", "is_available")
    flagged = new_lines.join(avail, "product_id", "left")
    return flagged.groupBy(key).agg(
        F.bool_and(F.coalesce("is_available", F.lit(True))).alias("accepted"))


# --------------------------------------------------------------------------- P19
def row_validation(staff: DataFrame) -> DataFrame:
    """10-digit phone not starting with 0; 4-digit code.  First failing rule."""
    reason = (F.when(~F.col("phone").rlike(r"^[1-9][0-9]{9}$"), F.lit("invalid_phone"))
               .when(~F.col("code").rlike(r"^[0-9]{4}$"), F.lit("invalid_code")))
    return staff.select("staff_id", "phone", "code", reason.alias("reason"),
                        reason.isNull().alias("is_valid"))


# --------------------------------------------------------------------------- A12
def order_stats(summary: DataFrame) -> DataFrame:
    """Count, sum and mean of the order summary, and the date range text."""
    return summary.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("toplam_tutar").alias("total_revenue"),
        F.avg("toplam_tutar").alias("average_order"),
        F.concat(F.date_format(F.min("tarih_saat"), "yyyy-MM-dd"), F.lit(" - "),
                 F.date_format(F.max("tarih_saat"), "yyyy-MM-dd")).alias("date_range"))


# --------------------------------------------------------------------------- A13
def top_product_mentions(summary: DataFrame, n: int = 10) -> DataFrame:
    """From "qty name, qty name" text: the most frequent product names."""
    part = F.explode(X.split_trim(F.col("siparis_icerigi"), ","))
    tokens = summary.select(part.alias("entry")).filter(F.col("entry") != "")
    name = F.when(F.split(F.col("entry"), " ", 2)[0].rlike(r"^[0-9]+$") & (F.size(F.split(F.col("entry"), " ", 2)) > 1),
                  F.split(F.col("entry"), " ", 2)[1]).otherwise(F.col("entry"))
    return (tokens.groupBy(name.alias("product_name")).agg(F.count(F.lit(1)).alias("mentions"))
                  .orderBy(F.desc("mentions"), F.asc("product_name")).limit(n))


# --------------------------------------------------------------------------- J13
def lookup_default(items: DataFrame, products: DataFrame) -> DataFrame:
    """Item's product name, or "Ürün #id" when the product is unknown."""
    return (items.join(products.select("product_id", "product_name"), "product_id", "left")
                 .select("item_id", "product_id",
                         F.coalesce("product_name",
                                    F.concat(F.lit("Ürün #"), F.col("product_id").cast("string")))
                          .alias("display_name")))


# --------------------------------------------------------------------------- A22
def split_bill_total(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Sum of quantity x price of the selected items, per order."""
    chosen = items.join(selected.select("item_id").distinct(), "item_id", "left_semi")
    return chosen.groupBy("order_id").agg(
        X.money_sum(F.col("quantity") * F.col("unit_price")).alias("selected_total"),
        F.count(F.lit(1)).alias("selected_items"))
