"""Adding a day of orders rewrites one day of the export."""
import datetime as dt
import os

from pyspark.sql import functions as F

from tavola.operators import datasets as D
from tavola.plans.models import refresh_summary
from tavola.sources import files
from tavola.sources.fixtures import Fixtures
from tavola.sources.tables import TABLE_SCHEMAS


def add(spark, folder, first, day):
    when = dt.datetime(2024, 1, day)
    orders = [(first + k, 5, "F", 10.0 * k, when, "1-URGENT") for k in range(4)]
    lines = [(first + k, 7, 1, n, 2.0, 1.0, 0.0, 0.0, "N", "O", when) for k in range(4) for n in range(2)]
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, TABLE_SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def times(path):
    return {f"{d}/{f}".split("day=")[1]: os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".csv")}


def exported(spark, out):
    return sorted(map(str, files.read_csv(spark, f"{out}/data", files.SUMMARY_SCHEMA).drop("day").collect()))


def test_a_new_day_rewrites_one_day(spark, tmp_path):
    sf, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(7, "tea, \"hot\"", "Brand#11", "t", 1, 2.5)], TABLE_SCHEMAS["part"]).coalesce(1).write.parquet(f"{sf}/part.parquet")
    for first, day in ((0, 1), (100, 2)):
        add(spark, sf, first, day)

    def whole():
        fx = Fixtures(spark, sf)
        return sorted(map(str, D.order_summary(fx.order_f, fx.order_item_f, fx.product_f).collect()))

    assert refresh_summary(spark, sf, out) is None and exported(spark, out) == whole()
    first = times(out)
    assert refresh_summary(spark, sf, out) == [] and times(out) == first            # nothing new
    add(spark, sf, 200, 3)
    assert refresh_summary(spark, sf, out) == [dt.date(2024, 1, 3)]
    second = times(out)
    assert {k.split("/")[0] for k in second.keys() - first.keys()} == {"2024-01-03"}
    assert all(second[k] == first[k] for k in first) and exported(spark, out) == whole()
    late = [(1, 7, 1, 9, 1.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime(2024, 1, 1))]    # one more line of an old order
    spark.createDataFrame(late, TABLE_SCHEMAS["lineitem"]).coalesce(1).write.mode("append").parquet(f"{sf}/lineitem.parquet")
    assert refresh_summary(spark, sf, out) == [dt.date(2024, 1, 1)] and exported(spark, out) == whole()
    gone = next(f for f in os.listdir(f"{sf}/orders.parquet") if f.startswith("part-"))
    os.utime(f"{sf}/orders.parquet/{gone}", ns=(1, 1))                              # another file under its name
    assert refresh_summary(spark, sf, out) is None and exported(spark, out) == whole()
