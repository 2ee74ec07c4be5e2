"""Physical-plan checks: no Cartesian products in the token joins, filters
and column pruning reach the Parquet scan."""
from tavola.plans import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_joins_have_no_cartesian_product(spark, small_dir):
    for key in ("basket_recommendations", "smart_basket", "product_recommendations"):
        plan = _plan(QUERIES[key](spark, small_dir))
        assert "CartesianProduct" not in plan, key
        loops = [line for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line]
        assert all("kind#" in line for line in loops), key         # the fixed rules of the campaigns


def test_scan_pruning_and_pushdown(spark, small_dir):
    plan = _plan(QUERIES["daily_sales"](spark, small_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate" in plan
    plan = _plan(QUERIES["weather_decode"](spark, small_dir))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
