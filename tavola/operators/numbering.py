"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.session import cut_lineage


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Add the row's number (from 0) inside its group, by the order, which must be total.

    Rows are dealt to ranges of (group, order), each range counts its rows of a group
    and numbers them, and a prefix sum over these counts, one row for each group and
    range, tells where a range begins.  A group is spread over many tasks, and no task
    sorts more than its range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_range"]]
    return (ranged.withColumn(name, inside.cast("long")).alias("a").join(begins.alias("b"), same)
            .select(*[f"a.{c}" for c in df.columns], (F.col(f"a.{name}") + F.col("b._begin")).alias(name)))
