"""Physical plan checks: the plans scale the way the operators claim."""

from vitrine.operators import reports as R
from vitrine.plans.registry import REGISTRY, gallery
from vitrine.sources import adapter

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_take_ordered(spark, tiny):
    assert "TakeOrderedAndProject" in plan_of(R.top_customers(tiny))


def test_per_type_top1_uses_group_limit(spark, tiny):
    df = R.type_max_price(tiny)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_average_is_a_scalar_subquery(spark, tiny):
    p = plan_of(R.customers_above_avg(tiny))
    assert "Subquery" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark):
    df = REGISTRY["in_stock_artifacts"].build(spark, SF)
    # The part and the supplier branch of the artifact table each have a scan.
    pushed = [p.split("]")[0] for p in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1:]]
    assert any("EqualTo(p_type,SMALL)" in p for p in pushed), pushed
    scan = REGISTRY["low_stock"].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Only the needed part and supplier columns are read.
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in scan
    assert "ReadSchema: struct<s_suppkey:bigint,s_name:string>" in scan


def test_registered_queries_read_whole_tables(spark):
    """Canonical tables hold a row for every driver row, and no query limits its input."""
    g = gallery(spark, SF)
    n = {t: adapter.read_driver(spark, SF, t).count() for t in adapter.DRIVER_TABLES}
    assert g.purchase.count() == g.exhibition_artifact.count() == adapter.purchase_requests(spark, SF).count() == n["lineitem"]
    assert g.exhibition.count() == n["orders"]
    assert g.users.count() == n["customer"] + n["supplier"] and g.artifact.count() == n["part"] + n["supplier"]
    assert g.museum.count() == n["nation"] and g.visits.count() == n["customer"] and g.virtual_record.count() == n["part"]
    kinds = dict(adapter.read_driver(spark, SF, "events").groupBy("event_type").count().collect())
    assert adapter.attend_requests(spark, SF).count() == kinds["view"] + kinds["click"]
    assert adapter.cart_events(spark, SF).count() == kinds["view"] + kinds["click"] + kinds["purchase"]
    assert REGISTRY["assign_ids"].build(spark, SF).count() == REGISTRY["append_exhibitions"].build(spark, SF).count() == n["orders"]
    for key in REGISTRY:
        if key in ("top_customers", "best_selling", "customers_above_avg", "artist_revenue", "type_max_price", "upcoming_exhibitions") \
                or key.startswith("stream_"):
            continue
        assert "GlobalLimit" not in REGISTRY[key].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString(), key
