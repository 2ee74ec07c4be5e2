"""Order lifecycle as set operations: state DataFrame x change DataFrame.

The source mutates one order per request; here a whole batch of requests is
applied at once.  "Last change wins" steps use ``max_by`` over
``(ts, change_id)`` -- a partial aggregate, so an order or item that receives
a large share of all changes is combined map-side instead of being sorted in
one task.  Order-dependent folds spread one key over many tasks: the cart composes
event functions over ranges (``segmented``), the payment guard settles an order in
rounds of prefix sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.functions import exprs as X
from tavola.operators.segmented import fold_events
from tavola.operators.reports import CLOSED_STATES, stock_check
from tavola.session import cut_lineage


def _zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def initial_paid(orders: DataFrame) -> DataFrame:
    """Orders carry no paid amount in the test views: Paid orders start fully
    paid, all others at 0."""
    if "paid_amount" in orders.columns:
        return orders
    return orders.withColumn("paid_amount", F.when(F.col("status") == X.PAID, F.col("total_amount"))
                                             .otherwise(_zero()))


def last_change(changes: DataFrame, key: str, value: str, order=("ts", "change_id")) -> DataFrame:
    """Latest value per key by (ts, id)."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


# --------------------------------------------------------------------------- L1
def append_lines(orders: DataFrame, items: DataFrame, new_lines: DataFrame,
                 products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New lines go to the newest active order of their table (which becomes
    Pending and is re-totalled); a table without one gets one new order,
    opened by its first accepted line.  A request (``request_id``) with an
    unavailable product is refused as a whole (P18).  Returns (orders, items)."""
    accepted = stock_check(new_lines, products, "request_id").filter("accepted").select("request_id")
    lines = (new_lines.join(accepted, "request_id", "left_semi")
                      .join(products.select("product_id", "price"), "product_id", "left"))
    active = orders.filter(~F.col("status").isin(*CLOSED_STATES))
    newest = active.groupBy("table_number").agg(
        F.max_by("order_id", F.struct("created_at", "order_id")).alias("target_order"))
    # one row per table that receives lines: its target, or a new order id
    firsts = lines.groupBy("table_number").agg(
        F.min_by("line_id", F.struct("ts", "line_id")).alias("first_line"),
        F.min("ts").alias("first_ts"))
    # new keys are offset by the current maxima (scalar subqueries, run once)
    max_order = orders.select(F.max("order_id")).scalar()
    targets = (firsts.join(newest, "table_number", "left")
                     .select("table_number", "first_ts",
                             F.coalesce("target_order", max_order + 1 + F.col("first_line"))
                              .alias("order_id"),
                             F.col("target_order").isNull().alias("is_new")))
    new_items = (lines.join(targets.select("table_number", "order_id"), "table_number")
                      .select(F.concat(F.lit("new-"), F.col("line_id").cast("string")).alias("item_id"), "order_id",
                              "product_id", "quantity",
                              F.coalesce("price", _zero()).cast("decimal(18,2)").alias("unit_price"),
                              F.lit(X.PENDING).alias("item_status")))
    all_items = items.select(*new_items.columns).unionByName(new_items)
    touched = targets.select("order_id", "table_number", "first_ts", "is_new")
    totals = (all_items.join(touched.select("order_id"), "order_id", "left_semi")
                       .groupBy("order_id")
                       .agg(F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("_total")))
    cols = ["order_id", "table_number", "status", "total_amount", "created_at"]
    updated = (orders.select(*cols).join(totals, "order_id", "left")
                     .select("order_id", "table_number",
                             F.when(F.col("_total").isNotNull(), F.lit(X.PENDING)).otherwise(F.col("status"))
                              .alias("status"),
                             F.coalesce("_total", "total_amount").alias("total_amount"), "created_at"))
    created = (touched.filter("is_new").join(totals, "order_id")
                      .select("order_id", "table_number", F.lit(X.PENDING).alias("status"),
                              F.col("_total").alias("total_amount"), F.col("first_ts").alias("created_at")))
    return updated.unionByName(created), all_items


# --------------------------------------------------------------------------- L3
def apply_order_status(orders: DataFrame, items: DataFrame, changes: DataFrame):
    """Latest status per order; items follow the latest Pending/Cancelled
    change (later other changes leave items alone).  Returns (orders, items)."""
    final = last_change(changes, "order_id", "new_status")
    spread = last_change(changes.filter(F.col("new_status").isin(X.PENDING, X.CANCELLED)),
                         "order_id", "new_status").withColumnRenamed("new_status", "item_new")
    o = (orders.join(final, "order_id", "left")
               .withColumn("status", F.coalesce("new_status", "status")).drop("new_status"))
    i = (items.join(spread, "order_id", "left")
              .withColumn("item_status", F.coalesce("item_new", "item_status")).drop("item_new"))
    return o, i


# --------------------------------------------------------------------------- L4
def apply_item_status(items: DataFrame, changes: DataFrame) -> DataFrame:
    final = last_change(changes, "item_id", "new_status")
    return (items.join(final, "item_id", "left")
                 .withColumn("item_status", F.coalesce("new_status", "item_status")).drop("new_status"))


# --------------------------------------------------------------------------- L5
def apply_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """paid += sum of payments; Paid once paid >= total (amounts add up in
    any order, so the batch sum decides); unknown orders are ignored."""
    paid = payments.groupBy("order_id").agg(F.sum("amount").alias("_paid"), F.count(F.lit(1)).alias("_n"))
    o = initial_paid(orders).join(paid, "order_id", "left")
    new_paid = (F.col("paid_amount") + F.coalesce("_paid", _zero())).cast("decimal(18,2)")
    return o.select(
        "order_id", "table_number", "total_amount", new_paid.alias("paid_amount"),
        F.when(F.col("_n").isNotNull() & (new_paid >= F.col("total_amount")), F.lit(X.PAID))
         .otherwise(F.col("status")).alias("status"))


def freed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose order turned Paid in this batch become Available."""
    was = before.select("order_id", F.col("status").alias("_old"))
    return (after.join(was, "order_id")
                 .filter((F.col("status") == X.PAID) & (F.col("_old") != X.PAID))
                 .select("table_number").distinct())


# --------------------------------------------------------------------------- L6
def pay_items(orders: DataFrame, items: DataFrame, pay_list: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pay listed items: items not Paid/Cancelled add their value and become
    Paid; the order closes when all its items are settled or paid >= total.
    Returns (orders, items)."""
    listed = items.join(pay_list.select("item_id").distinct(), "item_id", "left_semi")
    payable = listed.filter(~F.col("item_status").isin(*CLOSED_STATES))
    gained = payable.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("_gain"),
        F.count(F.lit(1)).alias("_n_paid"))
    after_items = items.join(payable.select("item_id", F.lit(True).alias("_p")), "item_id", "left")
    settled = after_items.groupBy("order_id").agg(F.bool_and(
        F.coalesce("_p", F.lit(False)) | F.col("item_status").isin(*CLOSED_STATES)).alias("_all"))
    o = initial_paid(orders).join(gained, "order_id", "left").join(settled, "order_id", "left")
    new_paid = (F.col("paid_amount") + F.coalesce("_gain", _zero())).cast("decimal(18,2)")
    close = F.col("_n_paid").isNotNull() & (F.col("_all") | (new_paid >= F.col("total_amount")))
    paid_orders = o.select("order_id", "table_number", "total_amount", new_paid.alias("paid_amount"),
                           F.when(close, F.lit(X.PAID)).otherwise(F.col("status")).alias("status"),
                           F.coalesce("_n_paid", F.lit(0)).cast("long").alias("items_paid"))
    status = F.when(F.col("_p"), F.lit(X.PAID)).otherwise(F.col("item_status"))
    return paid_orders, after_items.withColumn("item_status", status).drop("_p")


# --------------------------------------------------------------------------- L7
def merge_active_orders(orders: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per table, active orders merge into the oldest: lines are re-keyed,
    paid amounts summed, Pending if any other was Pending, total recomputed.
    Tables with one active order pass unchanged.  Returns (orders, items)."""
    o = initial_paid(orders)
    active = o.filter(~F.col("status").isin(*CLOSED_STATES))
    key = F.struct("created_at", "order_id")
    per_table = active.groupBy("table_number").agg(
        F.min_by("order_id", key).alias("primary_id"),
        F.count(F.lit(1)).alias("_n"))
    mapping = (active.select("order_id", "table_number", "status", "paid_amount")
                     .join(per_table.filter(F.col("_n") > 1), "table_number"))
    header = mapping.groupBy("primary_id").agg(
        F.sum("paid_amount").cast("decimal(18,2)").alias("paid_sum"),
        F.max(((F.col("status") == X.PENDING) & (F.col("order_id") != F.col("primary_id"))).cast("int"))
         .alias("_other_pending"))
    remap = mapping.select("order_id", "primary_id")
    new_items = (items.join(remap, "order_id", "left")
                      .withColumn("order_id", F.coalesce("primary_id", "order_id")).drop("primary_id"))
    totals = (new_items.join(header.select(F.col("primary_id").alias("order_id")), "order_id", "left_semi")
                       .groupBy("order_id")
                       .agg(F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("_total")))
    removed = remap.filter(F.col("order_id") != F.col("primary_id")).select("order_id")
    kept = o.join(removed, "order_id", "left_anti")
    merged = (kept.join(header.withColumnRenamed("primary_id", "order_id"), "order_id", "left")
                  .join(totals, "order_id", "left")
                  .select("order_id", "table_number",
                          F.when(F.col("_other_pending") == 1, F.lit(X.PENDING)).otherwise(F.col("status"))
                           .alias("status"),
                          F.coalesce("paid_sum", "paid_amount").alias("paid_amount"),
                          F.when(F.col("paid_sum").isNotNull(), F.coalesce("_total", _zero()))
                           .otherwise(F.col("total_amount")).alias("total_amount"),
                          "created_at"))
    return merged, new_items


# --------------------------------------------------------------------------- L8
def cart_fold(events: DataFrame, cart_key: str = "cart_id") -> DataFrame:
    """Final cart lines (quantity > 0) after all add / increase / decrease /
    remove events, applied in (ts, event_id) order per cart and product."""
    return fold_events(events, [cart_key, "product_id"], ["ts", "event_id"], "action").filter(F.col("quantity") > 0)


# --------------------------------------------------------------------------- L9
def dimension_upsert(dim: DataFrame, changes: DataFrame, key: str, value_cols: list[str],
                     tombstone: str = "is_delete", defaults: dict[str, Column] | None = None) -> DataFrame:
    """Latest change per key wins; a delete removes the row; an update sets
    the value columns; an unknown key is inserted with defaults for the rest."""
    latest = changes.groupBy(key).agg(
        F.max_by(F.struct(*value_cols, tombstone), F.struct("ts", "change_id")).alias("_new"), F.lit(True).alias("_changed"))
    j = dim.join(latest, key, "full")
    out = j.filter(~F.coalesce(F.col(f"_new.{tombstone}"), F.lit(False)))
    for c in value_cols:        # a change to null is a change
        out = out.withColumn(c, F.when(F.col("_changed"), F.col(f"_new.{c}")).otherwise(F.col(c)))
    out = out.drop("_new", "_changed")
    for c, expr in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), expr))
    return out


# --------------------------------------------------------------------------- L10
ONE_ROW = 64             # payments of an order that one row may hold


def _size_class(cents: Column) -> Column:
    """k where 2 ** k <= cents < 2 ** (k + 1), for cents > 0."""
    return F.length(F.bin(cents)) - 1


def _guard_rows(payments: DataFrame) -> DataFrame:
    """(payment_id, order_id, cents, left, accepted) of orders of few payments
    (order_id, ts, payment_id, cents, opening), each folded as one short array."""
    one = payments.groupBy("order_id", "opening").agg(F.array_sort(F.collect_list(F.struct("ts", "payment_id", "cents"))).alias("p"))
    start = F.struct(F.col("opening").alias("left"), F.expr("CAST(array() AS array<struct<payment_id:bigint,cents:bigint,left:bigint>>)").alias("out"))
    step = lambda s, x: F.struct(                                                               # noqa: E731
        F.when(x["cents"] <= s["left"], s["left"] - x["cents"]).otherwise(s["left"]).alias("left"),
        F.array_append(s["out"], F.struct(x["payment_id"].cast("long").alias("payment_id"), x["cents"].alias("cents"), s["left"].alias("left"))).alias("out"))
    out = one.select("order_id", F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("r"))
    return out.select("r.payment_id", "order_id", "r.cents", "r.left", (F.col("r.cents") <= F.col("r.left")).alias("accepted"))


def _guard_rounds(payments: DataFrame) -> DataFrame:
    """The same for orders of any number of payments.  What is left of an order lies in
    [2 ** k, 2 ** (k + 1)).  As long as it does, smaller payments are accepted, their
    prefix sums tell what is left, larger ones are refused, and the first payment of
    the same size that fits takes it below 2 ** k.  A round settles the payments up to
    the one that does, for all orders at once, so an order needs as many rounds as its
    rest has sizes.  Prefix sums are taken in chunks of (order, time) and then over
    the chunks' sums, so one order's payments lie in many tasks."""
    spark = payments.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(payments.repartitionByRange(parts, "order_id", "ts", "payment_id").withColumn("chunk", F.spark_partition_id()))
    rows = rows.withColumnRenamed("opening", "left")
    at = F.struct("ts", "payment_id")
    done = []
    while True:
        size, rest = _size_class(F.col("cents")), _size_class(F.col("left"))
        rows = rows.withColumn("small", F.when(size < rest, F.col("cents")).otherwise(0))
        sums = rows.groupBy("order_id", "chunk").agg(F.sum("small").alias("s"))
        before = Window.partitionBy("order_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("order_id", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("order_id", "chunk").orderBy("ts", "payment_id").rowsBetween(Window.unboundedPreceding, -1)
        now = F.col("left") - F.col("offset") - F.coalesce(F.sum("small").over(inside), F.lit(0))
        # only rows up to the end of the round are read from here on; ``now`` is theirs alone
        rows = rows.join(offsets, ["order_id", "chunk"]).withColumn("now", now)
        after = F.col("now") - F.col("cents")
        ends = (F.col("cents") <= F.col("now")) & (((size < rest) & ((after <= 0) | (_size_class(after) < rest))) | (size == rest))
        rows = cut_lineage(rows.withColumn("ends", ends))
        end = cut_lineage(rows.where("ends").groupBy("order_id").agg(F.min(F.struct("ts", "payment_id", "now", "cents")).alias("e"))
                          .select("order_id", F.struct("e.ts", "e.payment_id").alias("end"), (F.col("e.now") - F.col("e.cents")).alias("new")))
        rows = rows.drop("offset", "small", "ends").join(end, "order_id", "left")
        settled = F.col("end").isNull() | (at <= F.col("end"))
        done.append(rows.where(settled).select("payment_id", "order_id", "cents", F.col("now").alias("left"),
                                               (F.col("cents") <= F.col("now")).alias("accepted")))
        more = rows.where(~settled)
        # nothing is left of an order: all its later payments are refused
        done.append(more.where("new = 0").select("payment_id", "order_id", "cents", F.col("new").alias("left"), F.lit(False).alias("accepted")))
        rows = cut_lineage(more.where("new > 0").select("order_id", "ts", "payment_id", "cents", F.col("new").alias("left"), "chunk"))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def payment_guard(orders: DataFrame, payments: DataFrame, one_row: int = ONE_ROW) -> DataFrame:
    """Each payment checked, in (ts, payment_id) order, against what is left of
    its order after the payments accepted before it: amount <= 0 or above the
    remaining amount is refused.

    A payment above the opening amount can never be accepted and changes nothing, so
    only the others are followed: orders of up to ``one_row`` of them as one array,
    orders of more in rounds."""
    o = initial_paid(orders).select(
        "order_id", (F.col("total_amount") - F.col("paid_amount")).cast("decimal(18,2)").alias("opening"))
    p = payments.select("payment_id", "ts", "order_id", "amount").join(o, "order_id", "left")
    open_for = F.coalesce((F.col("amount") > 0) & (F.col("amount") <= F.col("opening")), F.lit(False))
    cents = lambda c: (F.col(c).cast("decimal(18,2)") * 100).cast("long")                     # noqa: E731
    followed = p.filter(open_for).select("payment_id", "ts", "order_id", cents("amount").alias("cents"), cents("opening").alias("opening"))
    counts = followed.groupBy("order_id").agg((F.count(F.lit(1)) > one_row).alias("many"))
    followed = cut_lineage(followed.join(counts, "order_id"))
    folded = _guard_rows(followed.where("NOT many").drop("many"))
    many = followed.where("many").drop("many")
    if not many.isEmpty():
        folded = folded.unionByName(_guard_rounds(many))
    money = lambda c: (F.col(c).cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")
    folded = folded.select("payment_id", "order_id", money("cents").alias("amount"), money("left").alias("remaining"),
                           F.when(~F.col("accepted"), F.lit("exceeds_remaining")).alias("reason"))
    refused = p.filter(~open_for).select(
        "payment_id", "order_id", "amount", F.lit(None).cast("decimal(18,2)").alias("remaining"),
        F.when(F.col("amount") <= 0, F.lit("non_positive")).when(F.col("opening").isNull(), F.lit("unknown_order"))
         .otherwise(F.lit("exceeds_remaining")).alias("reason"))
    return folded.unionByName(refused).withColumn("accepted", F.col("reason").isNull())
