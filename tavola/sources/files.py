"""File sources and sinks: CSV, JSON, text, with declared schemas.

Writers produce one folder of part files per dataset (the Spark way); readers
take the same folder.  Paths are always passed in: on a cluster they point at
shared storage, never at a machine-local folder.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators.numbering import numbered

SUMMARY_SCHEMA = (
    "siparis_id long, qr_masa_id string, tarih_saat string, gun string, saat int, ay int, "
    "hafta_sonu int, ozel_gun string, yas_grubu string, kisi_sayisi int, hava_durumu string, "
    "sicaklik_c double, toplam_tutar double, ikram_var int, iptal_var int, urun_sayisi long, "
    "siparis_icerigi string")

RULES_SCHEMA = ("antecedent string, consequent string, support double, confidence double, "
                "lift double, leverage double, conviction double")

DAILY_SALES_SCHEMA = "tarih string, ciro string, siparis_sayisi long"

SUGGESTION_SCHEMA = ("tetikleyici string, oneri string, confidence double, lift double, "
                     "support double, oneri_metni string")


NULL_TOKEN = "\\N"


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """S3 sink: quoted CSV with header (text with commas gets quoted).  NULL is
    written as \\N so that it stays distinct from the empty string."""
    (df.write.mode("overwrite").option("header", header).option("escape", '"')
       .option("nullValue", NULL_TOKEN).option("emptyValue", '""').csv(path))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """S3 source: CSV with header and a declared schema (no inference)."""
    return (spark.read.schema(schema).option("header", header).option("escape", '"')
                 .option("nullValue", NULL_TOKEN).option("emptyValue", "")
                 .option("multiLine", True).csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """S9 sink: JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """S4 source: JSON lines, or one JSON array per file with ``multiline``."""
    return spark.read.schema(schema).option("multiLine", multiline).option("recursiveFileLookup", multiline).json(path)


def write_json_array(df: DataFrame, path: str, order: list[str], rows: int = 10_000) -> None:
    """S4, S9 sink: files of one JSON array each, of at most ``rows`` rows, in order."""
    placed = numbered(df, [], order, "_n").withColumn("part", F.floor(F.col("_n") / rows))
    row = F.struct("_n", F.to_json(F.struct(*df.columns)).alias("v"))
    arrays = placed.groupBy("part").agg(F.sort_array(F.collect_list(row)).alias("r"))
    arrays.select("part", F.concat(F.lit("["), F.array_join("r.v", ",\n"), F.lit("]")).alias("value")
                  ).write.mode("overwrite").partitionBy("part").text(path)


def write_text_lines(df: DataFrame, col: str, path: str) -> None:
    """S6 sink: one text line per row, no header."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def daily_sales_file_rows(daily: DataFrame) -> DataFrame:
    """Rows of the daily sales report file (date, revenue, count)."""
    return daily.select(F.date_format("sale_date", "yyyy-MM-dd").alias("tarih"),
                        F.col("total_amount").cast("string").alias("ciro"),
                        F.col("order_count").alias("siparis_sayisi"))


# --------------------------------------------------------------------------- folders
def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _path(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    system, where = _path(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    system, where = _path(spark, path)
    system.delete(where, True)


def manifest(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Path -> "size time" of all data files under the paths."""
    out = {}
    for path in paths:
        system, where = _path(spark, path)
        if not system.exists(where):
            continue
        found = system.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out[f.getPath().toString()] = f"{f.getLen()} {f.getModificationTime()}"
    return out


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A name for the files under the paths as they are now."""
    return hashlib.sha256(json.dumps(sorted(manifest(spark, paths).items())).encode()).hexdigest()[:32]
