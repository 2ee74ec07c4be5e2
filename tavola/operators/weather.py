"""Weather attach with a staleness bound (J14), as a linear as-of join.

A reading counts for an order when it is the latest reading at or before
the order time and less than ``max_age`` old.  Time is cut into slots, thirty
of which make up ``max_age``.  Inside a slot one ordered window over both sides
gives each order the last reading before it.  Orders without one take the
latest reading of the slots before: each slot's last reading (one row a slot,
by partial ``max_by``) is handed to the thirty slots after it.  No order meets
more than one row of the other side, and a busy half hour is thirty windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions import exprs as X

DEFAULT_TEXT = "Bilinmiyor"
DEFAULT_TEMPERATURE = 20.0
SLOTS = 30


def attach_weather(orders: DataFrame, readings: DataFrame, max_age_minutes: int = 30,
                   order_key: str = "event_id", order_ts: str = "ts") -> DataFrame:
    """``readings``: (reading_id, reading_ts, weather_code, temperature)."""
    width = max_age_minutes * 60 * 1_000_000  # microseconds
    slot = F.floor(F.col("us") / (width // SLOTS)).alias("slot")
    reading = F.struct("us", "reading_id", "weather_code", "temperature")
    o = orders.select(F.col(order_key).alias("key"), F.col(order_ts).alias("at"),
                      F.unix_micros(F.col(order_ts).cast("timestamp")).alias("us")).select("*", slot)
    r = (readings.withColumn("us", F.unix_micros(F.col("reading_ts").cast("timestamp")))
                 .select("us", slot, reading.alias("reading")))
    both = (o.select("key", "at", "us", "slot", F.lit(None).cast(r.schema["reading"].dataType).alias("reading"))
             .unionByName(r, allowMissingColumns=True))
    order = Window.partitionBy("slot").orderBy("us", F.col("reading").isNull(), "reading.reading_id")
    near = (both.withColumn("last", F.last("reading", ignorenulls=True)
                            .over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .filter(F.col("reading").isNull()).drop("reading"))
    carried = (r.groupBy("slot").agg(F.max_by("reading", F.struct("us", "reading.reading_id")).alias("carry"))
                .select(F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + SLOTS)).alias("slot"), "carry")
                .groupBy("slot").agg(F.max_by("carry", F.struct("carry.us", "carry.reading_id")).alias("carry")))
    best = F.coalesce("last", "carry")
    j = (near.join(carried, "slot", "left")
             .withColumn("r", F.when(F.col("us") - best["us"] < width, best)))
    return j.select(F.col("key").alias(order_key), F.col("at").alias(order_ts),
                    F.col("r.reading_id").alias("reading_id"),
                    F.when(F.col("r").isNotNull(), X.weather_text(F.col("r.weather_code")))
                     .otherwise(F.lit(DEFAULT_TEXT)).alias("weather_condition"),
                    F.coalesce(F.col("r.temperature"), F.lit(DEFAULT_TEMPERATURE)).alias("temperature"))
