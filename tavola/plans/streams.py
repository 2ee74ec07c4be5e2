"""Streaming queries, run with availableNow; checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola.plans.lifecycle import PAID0
from tavola.plans.registry import register
from tavola.session import scratch_path
from tavola.sources.fixtures import Fixtures, payment_order, with_views
from tavola.streaming import streams as S


@register("stream_order_feed", with_views("""
SELECT event_id, ts, table_id, amount,
 'Masa ' || CAST(table_id AS VARCHAR) || ' sipariş verdi! (' || CAST(amount AS VARCHAR) || ')' AS message
FROM order_event_f WHERE event_type = 'purchase'""", "order_event_f"))
def stream_order_feed(spark, sf):
    return S.run_feed(S.order_feed(S.event_stream(spark, sf)), scratch_path(spark, f"feed/{uuid.uuid4().hex}"))


@register("stream_table_state", with_views("""
SELECT t.table_id, u.n IS NOT NULL AS is_occupied, coalesce(u.pending, false) AS has_pending_order,
 coalesce(u.n, 0) AS open_orders, u.amount AS open_amount, u.oldest AS oldest_order_at
FROM (SELECT DISTINCT table_id FROM order_event_f WHERE event_type IN ('signup', 'click', 'purchase')) t
LEFT JOIN (SELECT e.table_id, COUNT(*) AS n, bool_or(l.seen IS NULL OR (e.ts, e.event_id) > l.seen) AS pending,
  CAST(SUM(amount) AS DECIMAL(38,2)) AS amount, min(ts) AS oldest
 FROM order_event_f e JOIN (SELECT table_id, max((ts, event_id)) FILTER (event_type = 'signup') AS paid,
   max((ts, event_id)) FILTER (event_type = 'click') AS seen FROM order_event_f GROUP BY table_id) l
 ON l.table_id = e.table_id
 WHERE event_type = 'purchase' AND (l.paid IS NULL OR (e.ts, e.event_id) > l.paid) GROUP BY e.table_id) u
 ON u.table_id = t.table_id""", "order_event_f"))
def stream_table_state(spark, sf):
    return S.run_table_state(S.event_stream(spark, sf), scratch_path(spark, f"tables/{uuid.uuid4().hex}"))


@register("stream_payments", with_views(f"""
SELECT o.order_id, o.table_number, o.total_amount,
 CAST(o.paid0 + coalesce(p.paid, 0) AS DECIMAL(18,2)) AS paid_amount,
 CASE WHEN p.paid IS NOT NULL AND o.paid0 + p.paid >= o.total_amount THEN 5 ELSE o.status END AS status
FROM (SELECT *, {PAID0} AS paid0 FROM order_f) o
LEFT JOIN (SELECT order_id, SUM(amount) AS paid FROM payment_f GROUP BY order_id) p ON p.order_id = o.order_id""",
                                     "order_f", "payment_f"))
def stream_payments(spark, sf):
    ev = S.event_stream(spark, sf)
    payments = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("payment_id"), "ts", payment_order(spark, sf).alias("order_id"),
        (F.col("amount") * 1000).cast("decimal(18,2)").alias("amount"))
    out = scratch_path(spark, f"settled/{uuid.uuid4().hex}")
    S.settle_payments(spark, payments, out)
    return S.settled_state(spark, Fixtures(spark, sf).order_f, out)
