"""Parquet table readers with declared schemas (no inference at scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared schemas of the driver tables that the engine reads.
TABLE_SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full scan of one table (S1).  Column pruning and filter pushdown are
    left to Catalyst: callers select and filter, the Parquet scan sees it."""
    reader = spark.read
    schema = TABLE_SCHEMAS.get(name)
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))
