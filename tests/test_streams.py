"""Streams over several micro-batches and over a restart equal the batch result."""
import pytest
from pyspark.sql import functions as F

from tavola.streaming import streams as S


@pytest.fixture
def folder(spark, small_dir, tmp_path):
    """The events as several files, in turns of time and mixed."""
    e = spark.read.parquet(f"{small_dir}/events.parquet")
    for k in range(4):
        part = e.filter(F.pmod("event_id", F.lit(4)) == k) if k % 2 else e.filter(F.pmod("event_id", F.lit(4)) == k).orderBy("ts")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/events{k}.parquet")
    return tmp_path


def rows(df):
    return sorted(map(str, df.collect()))


def batch(spark, folder):
    return (spark.read.parquet(f"{folder}/in/events*.parquet")
            .select("event_id", "ts", F.col("user_id").alias("table_id"), "event_type", F.col("value").cast("decimal(18,2)").alias("amount")))


def test_table_state_over_batches(spark, folder):
    stream = S.event_stream(spark, f"{folder}/in", max_files=1)
    got = S.run_table_state(stream, f"{folder}/tables")
    want = S.occupancy(S.live_events(batch(spark, folder)))
    assert rows(got) == rows(want) and got.count() == got.select("table_id").distinct().count() > 0
    assert got.filter("is_occupied").count() > 0


def test_table_state_goes_on_after_a_restart(spark, folder):
    events = spark.read.parquet(f"{folder}/in/events*.parquet")
    got = S.run_table_state(S.event_stream(spark, f"{folder}/in", max_files=1), f"{folder}/tables")
    before = rows(got)
    assert rows(S.run_table_state(S.event_stream(spark, f"{folder}/in", max_files=3), f"{folder}/tables")) == before
    late = events.withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
    late.coalesce(1).write.parquet(f"{folder}/in/events9.parquet")
    got = S.run_table_state(S.event_stream(spark, f"{folder}/in", max_files=1), f"{folder}/tables")
    assert rows(got) == rows(S.occupancy(S.live_events(batch(spark, folder)))) != before


def test_payments_and_feed_are_not_counted_again(spark, folder):
    def run(n):
        events = S.event_stream(spark, f"{folder}/in", max_files=n)
        S.settle_payments(spark, events.filter("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), "amount"), f"{folder}/paid")
        feed = S.run_feed(S.order_feed(events), f"{folder}/feed")
        return spark.read.parquet(f"{folder}/paid").agg(F.sum("amount"), F.sum("n")).first(), feed.count()

    orders = batch(spark, folder).filter("event_type = 'purchase'")
    want = orders.agg(F.sum("amount"), F.count("*")).first()
    for n in (1, 3):
        paid, fed = run(n)
        assert tuple(paid) == tuple(want) and fed == want[1]


def test_changes_are_as_many_as_a_batch_touches(spark, folder):
    """A late batch of one table writes one row; old folders are merged and deleted."""
    out = f"{folder}/tables"
    S.run_table_state(S.event_stream(spark, f"{folder}/in", max_files=1), out)
    assert {k for k, _ in S._folders(spark, out)} == {"change"}
    one = spark.read.parquet(f"{folder}/in/events1.parquet").limit(1)
    for k in range(6):
        (one.withColumn("event_id", F.lit(5_000_000 + k).cast("long")).withColumn("event_type", F.lit("purchase"))
         .withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS")).coalesce(1).write.parquet(f"{folder}/in/events5{k}.parquet"))
        got = S.run_table_state(S.event_stream(spark, f"{folder}/in"), out)
        there = S._folders(spark, out)
        last = max(n for _, n in there)
        if ("change", last) in there:
            assert spark.read.parquet(f"{out}/change={last}").count() == 1
    assert len(there) <= S.MERGE_AFTER and ("base", 7) in there and ("change", 7) not in there
    assert rows(got) == rows(S.occupancy(S.live_events(batch(spark, folder))))
