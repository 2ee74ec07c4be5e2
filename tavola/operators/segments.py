"""Order segmentation (M8-M12, A14, A21, S13): standardised features,
best-of-n K-Means, profiles and names.

All starts of the best-of-n K-Means advance together, one scan of the written feature
table a step.  A saved result belongs to the input files it was made from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tavola.functions import exprs as X
from tavola.operators.datasets import AGE_CODE, WEATHER_CODE
from tavola.operators.forecast import standardize
from tavola.session import cut_lineage
from tavola.sources import files

SEGMENT_FEATURES = ["toplam_tutar", "kisi_sayisi", "urun_sayisi", "saat", "hafta_sonu", "yas_kod", "hava_kod",
                    "sicaklik_c"]
# Segment names by rank (D9: rank 0 = highest mean spend).
SEGMENT_NAMES = ["Premium Gurme", "Hızlı Öğle", "Aile & Sosyal", "Kahve & Tatlı"]


def segment_features(summary: DataFrame) -> DataFrame:
    """M9: ordinal codes for age group and weather (unknown -> 2)."""
    return summary.select(
        "siparis_id", "toplam_tutar", F.col("kisi_sayisi").cast("double").alias("kisi_sayisi"),
        F.col("urun_sayisi").cast("double").alias("urun_sayisi"), F.col("saat").cast("double").alias("saat"),
        F.col("hafta_sonu").cast("double").alias("hafta_sonu"),
        X.lookup(F.col("yas_grubu"), list(AGE_CODE.items()), 2).cast("double").alias("yas_kod"),
        X.lookup(F.col("hava_durumu"), list(WEATHER_CODE.items()), 2).cast("double").alias("hava_kod"),
        F.col("sicaklik_c").cast("double").alias("sicaklik_c"))


def scaled(features: DataFrame) -> DataFrame:
    return standardize(features, SEGMENT_FEATURES, ["siparis_id"])


MAX_STEPS = 20
MOVED = 1e-9             # a step that moves no centre further is the last


def _square(centre: list[float]) -> Column:
    return reduce(Column.__add__, [(F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(SEGMENT_FEATURES, centre)])


def nearest(centres: list[list[float]]) -> Column:
    """(d, i): squared distance and index of the nearest centre (lowest index on ties)."""
    return F.least(*[F.struct(_square(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])


def starts(scaled_df: DataFrame, total: int, k: int, n_init: int, seed: int) -> list[list[list[float]]]:
    """k rows for each start: those with the least md5 of (id, seed of the start).

    Only rows whose md5 lies under a bound are ordered, a few hundred a start of the
    ``total`` rows; where a start finds fewer than k of them the bound is raised, at last to
    all rows.  So no task sorts its rows once for each start."""
    each = scaled_df.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))))
    each = each.withColumn("_code", F.md5(F.concat_ws("-", F.col("siparis_id").cast("string"), (F.col("_start") + seed).cast("string"))))
    order = Window.partitionBy("_start").orderBy("_code", "siparis_id")
    share = 50 * k / max(total, 1)
    while True:
        under = each if share >= 1 else each.where(F.col("_code") < f"{int(share * 16 ** 8):08x}")
        first = under.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        rows = first.orderBy("_start", "_r").collect()          # k * n_init rows
        if share >= 1 or len(rows) == k * n_init:
            return [[[r[f] for f in SEGMENT_FEATURES] for r in rows if r["_start"] == i] for i in range(n_init)]
        share *= 16


BLOCK, CHUNK = 128, 10_000         # points a packed row, points a step of numpy


def packed(scaled_df: DataFrame) -> DataFrame:
    """(n, points): the feature rows in blocks of up to BLOCK points, as 64-bit floats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], axis=1).astype("<f8")
            blocks = [x[i:i + BLOCK] for i in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([len(b) for b in blocks], pa.int64()),
                                              pa.array([b.tobytes() for b in blocks], pa.binary())], names=["n", "points"])

    return scaled_df.select(*SEGMENT_FEATURES).mapInArrow(run, "n long, points binary")


def _step(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(s, i, n, cost, sums): members, cost and sums of cluster i of start s, over packed points."""
    n_starts, k, dim = centres.shape

    def points(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        whole = batch.column(0).to_pylist()
        for i in range(0, len(whole), CHUNK // BLOCK):
            yield np.frombuffer(b"".join(whole[i:i + CHUNK // BLOCK]), "<f8").reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, sums = np.zeros((n_starts, k), np.int64), np.zeros((n_starts, k)), np.zeros((n_starts, k, dim))
        for x in (x for batch in batches for x in points(batch)):
            for s in range(n_starts):
                d = ((x[:, None, :] - centres[s]) ** 2).sum(axis=2)
                i = d.argmin(axis=1)
                n[s] += np.bincount(i, minlength=k)
                cost[s] += np.bincount(i, weights=d[np.arange(len(i)), i], minlength=k)
                for j in range(dim):
                    sums[s, :, j] += np.bincount(i, weights=x[:, j], minlength=k)
        s, i = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(i), pa.array(n[s, i]), pa.array(cost[s, i]),
                                          pa.array(list(sums[s, i]), pa.list_(pa.float64()))], names=["s", "i", "n", "cost", "sums"])

    parts = blocks.select("points").mapInArrow(run, "s long, i long, n long, cost double, sums array<double>")
    return parts.groupBy("s", "i").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                       F.array(*[F.sum(F.col("sums")[j]) for j in range(dim)]).alias("sums"))


def best_kmeans(scaled_df: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, steps: int = MAX_STEPS):
    """Lloyd's steps of all starts together.  One scan a step finds each row's
    nearest centre of every start and adds up k * n_init partial sums a task; the driver
    sees their totals only.  An empty cluster keeps its centre.  Returns the centres of
    the start of least cost (to nine digits; then the first), that cost, and the scans."""
    rows = cut_lineage(packed(scaled_df))
    first = starts(scaled_df.select("siparis_id", *SEGMENT_FEATURES), rows.agg(F.sum("n")).first()[0] or 0, k, n_init, seed)
    if not first[0]:
        return [], 0.0, 0
    centres, scans = np.array(first), 0
    while True:
        found = _step(rows, centres).collect()
        scans += 1
        new = centres.copy()
        for r in found:
            new[r["s"], r["i"]] = np.array(r["sums"]) / r["n"]
        if scans > steps or np.abs(new - centres).max() <= MOVED:
            break
        centres = new
    cost = [sum(r["cost"] for r in found if r["s"] == s) for s in range(n_init)]
    best = min(range(n_init), key=lambda s: (float(f"{cost[s]:.9g}"), s))
    return centres[best].tolist(), cost[best], scans


def assign_fixed(scaled_df: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """M11 as an expression: index of the nearest of the centroids."""
    if not centroids:
        return scaled_df.select("siparis_id", F.lit(None).cast("int").alias("segment_id")).limit(0)
    return scaled_df.select("siparis_id", nearest(centroids)["i"].alias("segment_id"))


def _r(x, digits):
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale


def profile(summary: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per segment size, share, means, revenue, weekend ratio and peak
    hour (mode, smallest on ties); sorted by revenue and named by rank of
    mean spend (D9)."""
    j = summary.join(assignment, "siparis_id")
    total = summary.select(F.count(F.lit(1))).scalar()
    prof = j.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("musteri_sayisi"),
        F.avg("toplam_tutar").alias("_spend"),
        F.avg("kisi_sayisi").alias("_group"),
        F.avg("urun_sayisi").alias("_items"),
        F.sum("toplam_tutar").alias("_rev"),
        F.avg("hafta_sonu").alias("_weekend"),
        F.mode("saat", deterministic=True).alias("en_yogun_saat"))
    # one row per segment (k rows): the global window orders k rows only
    named = prof.withColumn("_rank", F.rank().over(Window.orderBy(F.desc("_spend"), "segment_id")))
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    return named.select(
        "segment_id",
        F.coalesce(F.try_element_at(names, F.col("_rank")),
                   F.concat(F.lit("Segment "), F.col("segment_id").cast("string"))).alias("ad"),
        "musteri_sayisi",
        _r(F.col("musteri_sayisi") / total * 100, 1).alias("yuzde"),
        _r(F.col("_spend"), 2).alias("ortalama_tutar"),
        _r(F.col("_group"), 1).alias("ortalama_kisi"),
        _r(F.col("_items"), 1).alias("ortalama_urun"),
        _r(F.col("_rev"), 2).alias("toplam_ciro"),
        _r(F.col("_weekend") * 100, 1).alias("hafta_sonu_orani"),
        F.coalesce("en_yogun_saat", F.lit(12)).alias("en_yogun_saat")).orderBy(F.desc("toplam_ciro"), "segment_id")


def cached(spark: SparkSession, path: str, inputs: list[str], compute) -> DataFrame:
    """The table saved for the input files as they are now (their paths, sizes and
    times); ``compute`` makes it where it is missing, and what was saved for other
    files is deleted."""
    now = files.fingerprint(spark, inputs)
    if not files.exists(spark, f"{path}/{now}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(f"{path}/{now}")
        for old in files.children(spark, path):
            if old != now:
                files.delete(spark, f"{path}/{old}")
    return spark.read.parquet(f"{path}/{now}")


def dominant(profile_df: DataFrame) -> DataFrame:
    """The largest segment by size (smallest id on ties)."""
    return profile_df.agg(F.min_by("ad", F.struct((-F.col("musteri_sayisi")).alias("n"), "segment_id"))
                          .alias("dominant_segment"), F.max("musteri_sayisi").alias("size"))
