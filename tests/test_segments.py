"""All starts in one scan, and results that belong to their input files."""
import random

import pytest
from pyspark.sql import functions as F

from tavola.operators import segments as SG
from tavola.sources import files


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(4)
    rows = [(i, *(rnd.gauss(3 * (i % 5 == j), 1.0) for j in range(len(SG.SEGMENT_FEATURES)))) for i in range(400)]
    return spark.createDataFrame(rows, ["siparis_id", *SG.SEGMENT_FEATURES]).repartition(3)


def test_all_starts_together_equal_each_alone(points):
    centres, cost, scans = SG.best_kmeans(points, 4, 10, 7)
    alone = [SG.best_kmeans(points, 4, 1, 7 + s) for s in range(10)]
    assert cost == pytest.approx(min(c for _, c, _ in alone), rel=1e-9)
    assert scans == max(n for _, _, n in alone) and sum(n for _, _, n in alone) > 5 * scans
    own = SG.assign_fixed(points, centres).join(points, "siparis_id").groupBy("segment_id").agg(
        *[F.avg(f).alias(f) for f in SG.SEGMENT_FEATURES]).collect()
    for r in own:                       # settled: each centre is the mean of its members
        assert [r[f] for f in SG.SEGMENT_FEATURES] == pytest.approx(centres[r.segment_id], abs=1e-6)


def test_few_rows_and_none(points):
    assert SG.best_kmeans(points.limit(0)) == ([], 0.0, 0)
    assert SG.assign_fixed(points, []).count() == 0
    centres, cost, _ = SG.best_kmeans(points.limit(2), 4, 3)
    assert len(centres) == 2 and cost == pytest.approx(0)


def test_a_saved_result_is_dropped_when_its_input_changes(spark, tmp_path):
    inputs, saved, runs = f"{tmp_path}/in", f"{tmp_path}/saved", []
    spark.range(3).write.parquet(inputs)

    def compute():
        runs.append(1)
        return spark.read.parquet(inputs).agg(F.count("*").alias("n"))

    assert [SG.cached(spark, saved, [inputs], compute).first().n for _ in range(2)] == [3, 3] and len(runs) == 1
    spark.range(4).write.mode("append").parquet(inputs)
    assert SG.cached(spark, saved, [inputs], compute).first().n == 7 and len(runs) == 2
    assert len(files.children(spark, saved)) == 1
