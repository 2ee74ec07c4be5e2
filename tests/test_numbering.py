"""Distributed row numbers, and files of JSON arrays."""
import random

from pyspark.sql import functions as F

from tavola.operators.numbering import numbered
from tavola.plans import QUERIES
from tavola.sources import files


def test_numbers_of_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b", None]), i) for i in rnd.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(5)
    out = numbered(df, ["g"], ["id"])
    got = {(r.g, r.id): r.number for r in out.collect()}
    for g in {g for g, _ in rows}:
        assert [got[(g, i)] for i in sorted(i for k, i in rows if k == g)] == list(range(sum(k == g for k, _ in rows)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # small shuffles are not merged
    try:
        tasks = {r.p for r in numbered(df, ["g"], ["id"]).where("g = 'hot'").select(F.spark_partition_id().alias("p")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1           # one group, many tasks
    assert numbered(df.limit(0), ["g"], ["id"]).count() == 0


def test_files_of_json_arrays(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"t, \"{i}\"\n", i / 8) for i in range(95)]
    df = spark.createDataFrame(rows, "id long, text string, x double").repartition(4)
    files.write_json_array(df, f"{tmp_path}/a", ["id"], rows=30)
    assert sorted(map(tuple, files.read_json(spark, f"{tmp_path}/a", "id long, text string, x double", multiline=True).collect())) == rows
    texts = [r.value for r in spark.read.text(f"{tmp_path}/a/part=*", wholetext=True).collect()]
    assert len(texts) == 4 and all(t.startswith("[") and t.rstrip().endswith("]") for t in texts)


def test_wizard_plans_have_no_nested_loop(spark, small_dir):
    for key in ("wizard_mains", "wizard_drinks", "wizard_desserts", "campaign_categories", "campaign_target_ids"):
        plan = QUERIES[key](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, key
        if key.startswith("wizard"):
            assert "BroadcastNestedLoopJoin" not in plan, key


def test_campaigns_come_in_priority_order(spark, small_dir):
    rows = [(r.context_id, r.priority_rank, r.seq) for r in QUERIES["campaign_candidates"](spark, small_dir).collect()]
    assert rows == sorted(rows) and len(rows) > 100
