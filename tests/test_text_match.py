"""Containment of needles in texts, and the search of score lists, against brute force."""
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tavola.operators.score_lists import zone_lists
from tavola.operators.text_match import contained


def test_contained_equals_in(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abç ", k=rnd.randint(0, 40))) for _ in range(60)] + [None, "", "aaaaaaaaaaaaaaaa", "ab" * 2000]
    needles = ["".join(rnd.choices("abç ", k=rnd.randint(0, 9))) for _ in range(80)] + [None, "", "a" * 12, "ab" * 1500, "ba" * 2001]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in needles], "needle string").repartition(2)
    got = Counter(map(tuple, contained(t, "text", n, "needle").collect()))
    assert got == Counter({(x, y) for x in texts for y in needles if x and y and y in x})


def test_contained_rows_grow_with_length(spark):
    """A text of 20,000 letters is one of 120,000 heads, not of 200 million substrings."""
    t = spark.createDataFrame([("x" * 20_000 + "needle",)], "text string")
    n = spark.createDataFrame([("needle",), ("eedlex",)], "needle string")
    assert [r.needle for r in contained(t, "text", n, "needle").collect()] == ["needle"]


@pytest.mark.parametrize("seed", [1, 2])
def test_zone_lists_equal_sorting_all(spark, seed):
    rnd = random.Random(seed)
    products = [(i, f"n{rnd.randrange(30)}", rnd.randrange(3)) for i in rnd.sample(range(5000), 300)]
    boosts = {(s, f"n{k}"): Decimal(rnd.choice([1, 1, 2, 3])) / 4 for s in "abcd" for k in rnd.sample(range(30), {"a": 28, "b": 9, "c": 1, "d": 30}[s])}
    wanted = [(s, f"z{z}", rnd.randint(1, 7), rnd.random() < 0.5) for s in "abcde" for z in range(3)]
    catalog = spark.createDataFrame(products, "product_id long, product_name string, category_id int")
    classes = (catalog.groupBy("category_id", "product_name").agg(F.min("product_id").alias("first_id"), F.count(F.lit(1)).alias("class_size"))
               .withColumn("zone_id", F.concat(F.lit("z"), "category_id")))
    got = zone_lists(spark.createDataFrame([(*k, v) for k, v in boosts.items()], "set_id string, product_name string, boost decimal(20,10)"),
                     spark.createDataFrame(wanted, "set_id string, zone_id string, m int, every boolean"), catalog, classes)
    want = Counter()
    for s, z, m, every in wanted:
        rows = sorted((-boosts.get((s, n), Decimal(0)), i) for i, n, c in products if f"z{c}" == z and (every or (s, n) in boosts))
        want.update((s, z, i, -b) for b, i in rows[:m])
    assert Counter((r.set_id, r.zone_id, r.product_id, r.boost) for r in got.collect()) == want
