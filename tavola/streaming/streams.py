"""Structured Streaming views.

The source pushes every new order to all listeners; here the order events
arrive as a file stream.  Nothing in the source carries event time or late
data, so no watermark is needed: T1 is a stateless projection (append),
T2 keeps in a state store, by table, the events that its occupancy depends on and
writes the tables that a micro-batch changes, T3 sums payments per micro-batch.
Both write one folder per batch id, so a retried batch overwrites itself, and all
checkpoints lie beside the outputs, so a restart goes on where the last run ended
(exactly-once effect).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators import lifecycle as L
from tavola.sources.tables import TABLE_SCHEMAS, table_path


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Order events as a stream over the events Parquet files."""
    r = spark.readStream.schema(TABLE_SCHEMAS["events"])
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a glob over the table file(s) in the folder: new files matching it are
    # picked up as new micro-batches
    e = r.option("basePath", sf_dir.rstrip("/")).parquet(table_path(sf_dir, "events").replace(".parquet", "*.parquet"))
    return e.select("event_id", "ts", F.col("user_id").alias("table_id"), "event_type",
                    F.col("value").cast("decimal(18,2)").alias("amount"))


def order_feed(events: DataFrame) -> DataFrame:
    """One alert row per new order (purchase event)."""
    o = events.filter(F.col("event_type") == "purchase")
    return o.select("event_id", "ts", "table_id", "amount",
                    F.format_string("Masa %d sipariş verdi! (%s)", F.col("table_id"),
                                    F.col("amount").cast("string")).alias("message"))


def _key(kind: str):
    return F.when(F.col("event_type") == kind, F.struct("ts", "event_id"))


def live_events(events: DataFrame) -> DataFrame:
    """The events that a table's occupancy still depends on: its last payment
    (signup), its last confirmation (click), and the orders (purchase) since the
    last payment.  Any order of arrival gives the same rows, and rows that come
    twice count once."""
    last = events.groupBy("table_id").agg(F.max(_key("signup")).alias("_paid"), F.max(_key("click")).alias("_seen"))
    own = F.struct("ts", "event_id")
    keep = ((F.col("event_type") == "purchase") & (F.col("_paid").isNull() | (own > F.col("_paid")))) \
        | (own == F.col("_paid")) | (own == F.col("_seen"))
    return events.join(last, "table_id").filter(keep).select(*events.columns).distinct()


def occupancy(live: DataFrame) -> DataFrame:
    """Per table whether it has unpaid orders, whether one of them is not
    confirmed yet, their amount, number and oldest time."""
    last = live.groupBy("table_id").agg(F.max(_key("click")).alias("seen"))
    orders = live.filter(F.col("event_type") == "purchase").join(last, "table_id")
    pending = F.col("seen").isNull() | (F.struct("ts", "event_id") > F.col("seen"))
    unpaid = orders.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("open_orders"), F.max(pending).alias("has_pending_order"),
        F.sum("amount").cast("decimal(38,2)").alias("open_amount"), F.min("ts").alias("oldest_order_at"))
    return last.select("table_id").join(unpaid, "table_id", "left").select(
        "table_id", F.col("open_orders").isNotNull().alias("is_occupied"),
        F.coalesce("has_pending_order", F.lit(False)).alias("has_pending_order"),
        F.coalesce("open_orders", F.lit(0)).alias("open_orders"), "open_amount", "oldest_order_at")


def _checkpoint(out_dir: str) -> str:
    """A stream's checkpoint lies beside its output, so that a restart with the
    same output goes on where the last run ended."""
    return out_dir.rstrip("/") + "_checkpoint"


def run_feed(feed: DataFrame, out_dir: str) -> DataFrame:
    """Append the feed to files, each row once, and read them back."""
    q = (feed.writeStream.outputMode("append").format("parquet").option("path", out_dir)
             .option("checkpointLocation", _checkpoint(out_dir)).trigger(availableNow=True).start())
    q.awaitTermination()
    return feed.sparkSession.read.schema(feed.schema).parquet(out_dir)


STATE = ("paid_at long, paid_id long, seen_at long, seen_id long, at array<long>, ids array<long>, cents array<long>")
TABLE = ("table_id long, is_occupied boolean, has_pending_order boolean, open_orders long, open_cents long, oldest long")
ONLY = ("signup", "click", "purchase")


def _table_change(key, frames, state):
    """A table's occupancy after the events of a batch.  The state store holds its last
    payment, its last confirmation and the orders since that payment, no matter in
    which order events come; an event that comes twice counts once."""
    import pandas as pd
    paid, seen, orders = (-1 << 63, 0), (-1 << 63, 0), {}
    if state.exists:
        pa, pi, sa, si, at, ids, cents = state.get
        paid, seen, orders = (pa, pi), (sa, si), dict(zip(zip(at, ids), cents))
    for frame in frames:
        for kind, rows in frame.groupby("event_type"):
            own = list(zip(rows["at"].tolist(), rows["event_id"].tolist()))
            if kind == "signup":
                paid = max(paid, max(own))
            elif kind == "click":
                seen = max(seen, max(own))
            else:
                orders.update(zip(own, rows["cents"].tolist()))
    orders = {k: v for k, v in orders.items() if k > paid}
    state.update((*paid, *seen, [k[0] for k in orders], [k[1] for k in orders], list(orders.values())))
    yield pd.DataFrame({"table_id": [key[0]], "is_occupied": [bool(orders)],
                        "has_pending_order": [any(k > seen for k in orders)], "open_orders": [len(orders)],
                        "open_cents": pd.array([sum(orders.values()) if orders else None], dtype="Int64"),
                        "oldest": pd.array([min(orders)[0] if orders else None], dtype="Int64")})


def table_changes(events: DataFrame) -> DataFrame:
    """The occupancy of the tables that a micro-batch touches, from a state store
    keyed by table: a batch costs its own events and tables, not all tables."""
    rows = events.where(F.col("event_type").isin(*ONLY)).select(
        "table_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("amount") * 100).cast("long").alias("cents"))
    return rows.groupBy("table_id").applyInPandasWithState(_table_change, TABLE, STATE, "update", "NoTimeout")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _folders(spark: SparkSession, out_dir: str) -> list[tuple[str, int]]:
    """The (kind, batch id) of the finished folders ``base=N`` and ``change=N``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [f.getPath() for f in files.listStatus(root)]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [(n.split("=")[0], int(n.split("=")[1])) for n in done if "=" in n]


def _latest(spark: SparkSession, out_dir: str) -> tuple[DataFrame, int, list[int]]:
    """Newest row of each table, the base it starts from (-1: none) and the changes after it."""
    there = _folders(spark, out_dir)
    base = max((n for kind, n in there if kind == "base"), default=-1)
    changes = sorted(n for kind, n in there if kind == "change" and n > base)
    paths = [f"{out_dir}/base={base}"] * (base >= 0) + [f"{out_dir}/change={n}" for n in changes]
    schema = f"{TABLE}, version long"
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    cols = [f.name for f in rows.schema.fields if f.name != "table_id"]
    newest = rows.groupBy("table_id").agg(F.max_by(F.struct(*cols), "version").alias("r")).select("table_id", "r.*")
    return newest, base, changes


MERGE_AFTER = 8          # change folders that a reader looks through at most


def run_table_state(events: DataFrame, out_dir: str) -> DataFrame:
    """Write the changed tables of batch N to ``change=N``; a batch that is run again
    writes the same rows to the same place.  Every ``MERGE_AFTER`` batches the newest
    rows become ``base=N`` and what is older is deleted.  Returns the occupancy after
    the last batch."""
    spark = events.sparkSession
    ts = events.schema["ts"].dataType

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("version", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out_dir}/change={n}")
        newest, base, changes = _latest(spark, out_dir)
        if len(changes) >= MERGE_AFTER:
            newest.write.mode("overwrite").parquet(f"{out_dir}/base={n}")
            for old in [f"change={c}" for c in changes] + [f"base={base}"] * (base >= 0):
                _delete(spark, f"{out_dir}/{old}")

    q = (table_changes(events).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", _checkpoint(out_dir)).trigger(availableNow=True).start())
    q.awaitTermination()
    newest, _, _ = _latest(spark, out_dir)
    return newest.select("table_id", "is_occupied", "has_pending_order", "open_orders",
                         (F.col("open_cents").cast("decimal(38,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(38,2)").alias("open_amount"),
                         F.timestamp_micros("oldest").cast(ts).alias("oldest_order_at"))


def settle_payments(spark: SparkSession, payments: DataFrame, out_dir: str):
    """Per micro-batch, sum payments per order and write them to
    ``out_dir/batch_id=N`` (overwrite: replaying a batch id is idempotent)."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("order_id").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
              .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}"))

    q = (payments.writeStream.foreachBatch(apply).option("checkpointLocation", _checkpoint(out_dir))
                 .trigger(availableNow=True).start())
    q.awaitTermination()


def settled_state(spark: SparkSession, orders: DataFrame, out_dir: str) -> DataFrame:
    """Final order state after all settled batches (L5 over the batch sums)."""
    sums = spark.read.parquet(out_dir).select("order_id", "amount")
    return L.apply_payments(orders, sums)
