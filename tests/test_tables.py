"""Snapshots written and read back; the tables as SQL views with bound parameters."""

from decimal import Decimal as D

from conftest import rows

from vitrine.operators import reports as R
from vitrine.sources.tables import read_tables, write_tables


def test_snapshot_roundtrip_with_partitions(spark, tiny, tmp_path):
    path = str(tmp_path / "snap")
    write_tables(tiny, path, partition_by={"artifact": ["type"]})
    back = read_tables(spark, path)
    assert back.artifact.columns == tiny.artifact.columns
    assert sorted(rows(back.artifact)) == sorted(rows(tiny.artifact))
    assert rows(R.top_customers(back)) == rows(R.top_customers(tiny))
    # A filter on the partition column prunes folders.
    plan = back.artifact.filter("type = 'Sculpture'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan


def test_views_with_bound_parameters(spark, tiny):
    tiny.register_views(prefix="t_")
    got = spark.sql("SELECT artifact_id FROM t_artifact WHERE quantity <= :k ORDER BY artifact_id",
                    args={"k": 1}).collect()
    assert [r[0] for r in got] == [3, 4]
    total = spark.sql("SELECT sum(total_amount) FROM t_purchase WHERE customer_id = :c", args={"c": 3}).first()[0]
    assert total == D("6100.00")


def test_saved_views(spark, tiny):
    R.register_saved_views(tiny, prefix="s_")
    got = spark.sql("SELECT transaction_id FROM s_admin_transactions ORDER BY purchase_ts DESC, transaction_id").collect()
    assert [r[0] for r in got] == [1, 2, 3]
    assert spark.sql("SELECT artifact_id FROM s_artifacts_above_artist_avg ORDER BY artifact_id").collect() == [(1,), (4,)]
    for name in ("customers_above_avg_names", "multi_seller_artists", "museum_sales_ranked", "type_max_price_ties"):
        assert spark.sql(f"SELECT count(*) FROM s_{name}").first()[0] > 0
