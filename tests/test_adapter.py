"""Invariants of the driver-table adapter (smallest scale)."""

from pyspark.sql import functions as F

from vitrine.sources import adapter

SF = "/root/testdata/sf0.001"


def test_canonical_tables_from_driver(spark):
    g = adapter.load_gallery(spark, SF)
    part = adapter.read_driver(spark, SF, "part").count()
    supplier = adapter.read_driver(spark, SF, "supplier").count()
    assert g.artifact.count() == part + supplier
    # Keys are unique where the schema declares them.
    for table, key in [("users", "user_id"), ("artifact", "artifact_id"), ("purchase", "purchase_id")]:
        df = g.table(table)
        assert df.select(key).distinct().count() == df.count(), table
    # Unsold artifacts exist (the studies) and purchases only name known artifacts.
    assert g.artifact.join(g.purchase, "artifact_id", "left_anti").count() >= supplier
    assert g.purchase.join(g.artifact, "artifact_id", "left_anti").count() == 0
    # The planted rule violations are there for the audits to find.
    assert g.users.filter(F.col("email").isNull()).count() > 0
    li = adapter.read_driver(spark, SF, "lineitem")
    sevenths = li.filter(F.col("l_linenumber") == 7).count()
    assert g.purchase.filter(F.col("payment_method") == "Voucher").count() == sevenths
    assert set(r[0] for r in g.artifact.select("type").distinct().collect()) <= set(adapter.DRIVER_TYPE_DOMAIN)
