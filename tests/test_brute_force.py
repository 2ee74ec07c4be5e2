"""Queries whose exact top-k algorithm is checked against a brute-force
oracle that scores every (basket, candidate) pair, on sf0.001."""
from collections import Counter

from oracle_check import duck_con, norm
from tavola.plans import QUERIES
from tavola.plans import smart_basket as PR


def test_smart_basket_equals_brute_force(spark, small_dir):
    con = duck_con(small_dir)
    rel = con.sql(PR.SMART_BASKET_BRUTE_FORCE_SQL)
    cols, expected = rel.columns, rel.fetchall()
    df = QUERIES["smart_basket"](spark, small_dir)
    order = [cols.index(c) for c in df.columns]
    got = Counter(tuple(norm(x) for x in r) for r in df.collect())
    want = Counter(tuple(norm(r[i]) for i in order) for r in expected)
    assert got == want


def test_smart_basket_properties(spark, small_dir):
    df = QUERIES["smart_basket"](spark, small_dir).toPandas()
    assert (df.groupby("basket_id").size() <= 6).all()
    assert (df.groupby(["basket_id", "category_id"]).size() <= 2).all()
    assert df.confidence.between(0.5, 0.95).all()
    b = spark.read.parquet(f"{small_dir}/lineitem.parquet").selectExpr(
        "l_orderkey AS basket_id", "l_partkey AS product_id").distinct().toPandas()
    merged = df.merge(b, on=["basket_id", "product_id"])
    assert merged.empty
    assert 0 < df.has_campaign.sum() < len(df) and (df.campaign_title.notna() == df.has_campaign).all()


def test_dashboard_properties(spark, small_dir):
    df = QUERIES["dashboard_recommendations"](spark, small_dir).toPandas()
    assert (df.groupby("product_id").size() <= 8).all()
    assert (df.product_id != df.rec_id).all()
    assert df.confidence.between(0, 1).all()
    ranked = df.sort_values(["product_id", "rank"])
    for _, g in ranked.groupby("product_id"):
        assert list(g.confidence) == sorted(g.confidence, reverse=True)


def test_smart_basket_fills_small_catalogues(spark, tmp_path):
    """Baskets with fewer than six scored products are filled from the categories they lack; some lack every list."""
    import random
    from datetime import datetime
    rnd = random.Random(11)
    names = ["plain cube", "plain cone", "grey gear", "tall ring", "old bolt"]
    parts = [(i, names[i % 5 if i < 25 else 0], f"Brand#{i % 3}", "TYPE", s, 10.0 + i) for i, s in enumerate([7] * 12 + [6] * 3 + [0] * 4 + [1] * 9, start=1)]
    orders = [(k, k % 5, "F", 50.0, datetime(2024, 1, 1 + k % 28), "1-URGENT") for k in range(1, 61)]
    lines = [(k, p, 1, n, 2.0, 20.0, 0.0, 0.0, "R", "F", datetime(2024, 1, 2)) for k in range(1, 61)
             for n, p in enumerate(rnd.sample(range(1, 16) if k % 2 else range(1, 29), rnd.randint(1, 4)), start=1)]
    for name, rows, schema in (
            ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duck_con(str(tmp_path))
    rel = con.sql(PR.SMART_BASKET_BRUTE_FORCE_SQL)
    cols, expected = rel.columns, rel.fetchall()
    df = QUERIES["smart_basket"](spark, str(tmp_path))
    order = [cols.index(c) for c in df.columns]
    got = Counter(tuple(norm(x) for x in r) for r in df.collect())
    assert got == Counter(tuple(norm(r[i]) for i in order) for r in expected)
    filled = sum(n for r, n in got.items() if r[df.columns.index("reason")] == "popular-fill")
    assert 0 < filled < sum(got.values())
