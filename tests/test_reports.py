"""Golden answers on the sample data, plus edge rows."""

import datetime as dt
from decimal import Decimal as D

from conftest import TS, fixture_rows, rows
from pyspark.sql import functions as F

from vitrine.operators import reports as R
from vitrine.sources.tables import from_rows


def test_top_customers(tiny):
    assert rows(R.top_customers(tiny)) == [(3, "Ines Okoro", D("6100.00")), (4, "Juno Vale", D("5000.00"))]


def test_best_selling_keeps_unsold(tiny):
    got = rows(R.best_selling(tiny), "artifact_id", "units_sold", "revenue")
    assert got == [(2, 2, D("3600.00")), (3, 1, D("5000.00")), (1, 1, D("2500.00")), (4, 0, D("0.00")),
                   (5, 0, D("0.00"))]


def test_above_average(tiny):
    assert rows(R.customers_above_avg(tiny), "customer_id") == [(3,)]
    assert rows(R.customers_above_avg_names(tiny)) == [("Ines Okoro",)]


def test_above_average_exact_boundary(spark):
    # Spends 1, 1, 1 (mean exactly 1): nobody is strictly above.
    data = fixture_rows()
    data["purchase"] = [(i, 3 + (i % 2), 1, TS, 1, D("1.00"), "Card") for i in range(1, 4)]
    data["purchase"][2] = (3, 5, 1, TS, 1, D("1.00"), "Card")
    g = from_rows(spark, data)
    assert R.customers_above_avg(g).count() == 0


def test_artist_revenue(tiny):
    assert rows(R.artist_revenue(tiny), "artist_id", "revenue") == [(1, D("6100.00")), (2, D("5000.00"))]


def test_multi_seller_artists(tiny):
    assert rows(R.multi_seller_artists(tiny)) == [(1, "Mara Quill", 2)]
    assert rows(R.multi_seller_artists(tiny, approx=True), "artist_id") == [(1,)]


def test_museum_sales_ranked(tiny):
    got = sorted(rows(R.museum_sales_ranked(tiny), "museum_id", "total_sales", "sales_rank"))
    assert got == [(1, D("11100.00"), 1), (2, D("0.00"), 2)]


def test_rank_has_gaps(spark):
    data = fixture_rows()
    data["museum"].append((3, "Third", "x", 10, TS))
    data["artifact"][3] = data["artifact"][3][:2] + (3,) + data["artifact"][3][3:]  # artifact 4 in museum 3
    data["purchase"].append((4, 4, 4, TS, 1, D("11100.00"), "Card"))
    g = from_rows(spark, data)
    got = sorted(rows(R.museum_sales_ranked(g), "museum_id", "sales_rank"))
    assert got == [(1, 1), (2, 3), (3, 1)]


def test_type_max_price_enum_order(tiny):
    got = rows(R.type_max_price(tiny), "type", "artifact_id")
    assert got == [("Painting", 1), ("Sculpture", 4), ("Digital", 5)]


def test_type_max_price_ties_and_nulls(spark):
    data = fixture_rows()
    d = D
    data["artifact"] += [
        # NULL artist with the top Painting price: R9 loses Painting, R8 keeps it.
        (6, None, 1, "Anon", None, "Painting", None, None, d("9000.00"), 1, None, TS),
        # Tie at the top of Digital: R9 keeps both, R8 keeps the lower id.
        (7, 2, 1, "Twin", None, "Digital", None, None, d("1200.00"), 1, None, TS),
        # NULL type: its own group in R8, dropped in R9.
        (8, 2, 1, "Untyped", None, None, None, None, d("10.00"), 1, None, TS),
    ]
    g = from_rows(spark, data)
    r8 = rows(R.type_max_price(g), "type", "artifact_id")
    assert r8 == [(None, 8), ("Painting", 6), ("Sculpture", 4), ("Digital", 5)]
    r9 = sorted(rows(R.type_max_price_ties(g), "artifact_type", "artifact_id"))
    assert r9 == [("Digital", 5), ("Digital", 7), ("Sculpture", 4)]


def test_above_artist_avg(tiny):
    assert sorted(rows(R.above_artist_avg(tiny), "artifact_id")) == [(1,), (4,)]


def test_transactions_order(tiny):
    got = rows(R.transactions(tiny), "transaction_id", "customer_name", "artist_name", "museum_name")
    assert [r[0] for r in got] == [3, 2, 1]
    assert got[0] == (3, "Juno Vale", "Teo Brandt", "North Hall")


def test_customer_totals(spark, tiny):
    keys = spark.createDataFrame([(3,), (4,), (5,)], "customer_id bigint")
    assert sorted(rows(R.customer_totals(tiny, keys))) == [(3, D("6100.00")), (4, D("5000.00")), (5, D("0.00"))]


def test_stock_lookup(spark):
    data = fixture_rows()
    data["artifact"].append((9, 1, 1, "No stock info", None, "Other", None, None, D("1.00"), None, None, TS))
    g = from_rows(spark, data)
    keys = spark.createDataFrame([(1,), (2,), (3,), (9,), (999,)], "artifact_id bigint")
    assert sorted(rows(R.stock_lookup(g, keys))) == [(1, 9), (2, 3), (3, 1), (9, 0), (999, None)]


def test_low_stock(tiny):
    assert rows(R.low_stock(tiny, 3), "title", "quantity") == [
        ("Iron Heron", 1), ("Salt Column", 1), ("Violet Hour", 3)]


def test_empty_tables(spark):
    g = from_rows(spark, {})
    assert R.top_customers(g).count() == 0
    assert R.museum_sales_ranked(g).count() == 0
    assert R.type_max_price(g).count() == 0


def test_distributed_rank_matches_window(spark):
    import random

    from pyspark.sql import Window

    from vitrine.functions.ranking import rank_desc

    rnd = random.Random(4)
    df = spark.createDataFrame([(i, rnd.choice([None, 1, 2, 2, 3, 5, 5, 5, 8])) for i in range(500)],
                               "id long, v int")
    want = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
    got = rank_desc(df, "v", "r")
    assert sorted(rows(got, "id", "r")) == sorted(rows(want, "id", "r"))


def test_ranks_of_a_tie_of_half_the_rows(spark):
    """The tied rows stay where they are: only distinct values are sorted."""
    from vitrine.functions.ranking import rank_desc

    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS v").repartition(16)
    got = rank_desc(df, "v", "r").withColumn("p", F.spark_partition_id())
    want = {r.id: r.r for r in df.selectExpr("id", "rank() OVER (ORDER BY v DESC NULLS LAST) AS r").collect()}
    assert {r.id: r.r for r in got.collect()} == want
    assert got.filter("v = 7").groupBy("p").count().agg(F.max("count")).first()[0] <= 20_000 // 8


def test_sold_sketches_merge_within_their_error(spark, tiny):
    """Months of sketches, merged, against exact counts, at sizes beyond a sketch's exact start."""
    n = 40_000
    art = spark.range(n).select(F.col("id").alias("artifact_id"), F.when(F.col("id") % 50 != 49, F.col("id") % 2).alias("artist_id"))
    art = art.select(*[F.col(c) if c in art.columns else F.lit(None).cast(tiny.artifact.schema[c].dataType).alias(c) for c in tiny.artifact.columns])
    when = F.expr("timestampadd(MONTH, cast(purchase_id % 5 as int), timestamp_ntz'2024-01-10 00:00:00')")
    sold = spark.range(3 * n).select(F.col("id").alias("purchase_id"), (F.col("id") * 7 % n).alias("artifact_id"))
    sold = sold.withColumn("purchase_ts", F.when(F.col("purchase_id") % 11 != 0, when))
    sold = sold.select(*[F.col(c) if c in sold.columns else F.lit(None).cast(tiny.purchase.schema[c].dataType).alias(c) for c in tiny.purchase.columns])
    users = tiny.users.withColumn("user_id", F.col("user_id") - 1)
    g = tiny.with_tables(artifact=art, purchase=sold, users=users)
    sketches = R.sold_sketches(g)
    assert sketches.groupBy("artist_id").count().collect() and sketches.filter("artist_id IS NULL").count() == 0
    for window in ({}, {"since": "2024-02-01", "until": "2024-03-01"}):
        kept = sold if not window else sold.filter("month(purchase_ts) IN (2, 3)")
        exact = {r.artist_id: r.artifacts_sold for r in R.multi_seller_artists(g.with_tables(purchase=kept), 1).collect()}
        near = {r.artist_id: r.artifacts_sold for r in R.multi_seller_sketches(g, sketches, 1, **window).collect()}
        assert exact and set(near) == set(exact)
        assert all(abs(near[k] - exact[k]) <= R.SKETCH_BOUND * exact[k] for k in exact), (near, exact)
    assert R.multi_seller_sketches(g, sketches.limit(0), 0).count() == 0


def test_sketch_error_over_many_artists(spark, tiny):
    """The root mean square error of 200 merged counts is the stated standard error."""
    per, artists = 5000, 200
    art = spark.range(per * artists).select(F.col("id").alias("artifact_id"), (F.col("id") % artists).alias("artist_id"))
    sold = spark.range(2 * per * artists).select(
        (F.col("id") % (per * artists)).alias("artifact_id"),
        F.expr("timestampadd(MONTH, cast(id % 3 as int), timestamp_ntz'2024-01-10 00:00:00')").alias("purchase_ts"))
    users = spark.range(artists).select(F.col("id").alias("user_id"), F.lit("A").alias("fname"), F.lit("B").alias("lname"))
    g = tiny.with_tables(artifact=art, purchase=sold, users=users)
    off = [r.artifacts_sold / per - 1 for r in R.multi_seller_sketches(g, R.sold_sketches(g), 1).collect()]
    assert len(off) == artists and max(map(abs, off)) <= R.SKETCH_BOUND
    assert (sum(e * e for e in off) / artists) ** 0.5 <= 1.2 * R.SKETCH_ERROR
