"""Sales and ranking reports.

Every fact-table aggregate is computed once per key *before* it meets a
dimension, so joins see one row per customer / artifact / artist instead of
one row per purchase, and the aggregate's map-side combine absorbs hot keys.
Top-k reports end in ``orderBy(...).limit(n)`` (planned as
``TakeOrderedAndProject``: a per-partition top-k, then one small merge) and
always break ties on the key, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.columns import enum_rank, full_name
from vitrine.functions.ranking import rank_desc
from vitrine.sources.tables import Gallery


# ----------------------------------------------------------------- shared parts

def sales_by_artifact(g: Gallery) -> DataFrame:
    """artifact_id, units_sold, revenue: one row per sold artifact."""
    return g.purchase.groupBy("artifact_id").agg(
        F.sum("quantity").alias("units_sold"),
        F.sum("total_amount").alias("revenue"),
    )


def spend_by_customer(g: Gallery) -> DataFrame:
    """customer_id, total_spent: one row per customer with purchases."""
    return g.purchase.groupBy("customer_id").agg(F.sum("total_amount").alias("total_spent"))


def _names(users: DataFrame, id_name: str, name_col: str) -> DataFrame:
    return users.select(F.col("user_id").alias(id_name), full_name().alias(name_col))


def _above_average(spend: DataFrame) -> DataFrame:
    """Customers whose spend is above the mean over customers with purchases.

    The mean's parts (sum and count) are one scalar subquery, computed once and
    handed to every task: no join at all.  The test ``total > sum / n`` is
    written ``total * n > sum``: exact decimal arithmetic, no rounding of the
    mean."""
    overall = spend.agg(F.struct(F.sum("total_spent").alias("s"), F.count(F.lit(1)).alias("n"))).scalar()
    return spend.filter(F.col("total_spent") * overall.getField("n") > overall.getField("s"))


# ----------------------------------------------------------------------- R1-R7

def top_customers(g: Gallery, n: int = 10) -> DataFrame:
    """Customers by total spend, highest first."""
    spend = spend_by_customer(g)
    return (spend.join(_names(g.users, "customer_id", "name"), "customer_id", "inner")
            .select("customer_id", "name", F.col("total_spent").cast("decimal(22,2)").alias("total_spent"))
            .orderBy(F.desc("total_spent"), F.asc("customer_id"))
            .limit(n))


def best_selling(g: Gallery, n: int = 20) -> DataFrame:
    """R2: artifacts by units sold then revenue; unsold artifacts count as 0."""
    sales = sales_by_artifact(g)
    return (g.artifact.select("artifact_id", "title")
            .join(sales, "artifact_id", "left")
            .select("artifact_id", "title",
                    F.coalesce("units_sold", F.lit(0)).cast("bigint").alias("units_sold"),
                    F.coalesce("revenue", F.lit(0)).cast("decimal(22,2)").alias("revenue"))
            .orderBy(F.desc("units_sold"), F.desc("revenue"), F.asc("artifact_id"))
            .limit(n))


def customers_above_avg(g: Gallery, n: int = 50) -> DataFrame:
    """Customers spending more than the average customer, ranked, top n."""
    above = _above_average(spend_by_customer(g))
    return (above.join(_names(g.users, "customer_id", "name"), "customer_id", "inner")
            .select("customer_id", "name", F.col("total_spent").cast("decimal(22,2)").alias("total_spent"))
            .orderBy(F.desc("total_spent"), F.asc("customer_id"))
            .limit(n))


def customers_above_avg_names(g: Gallery) -> DataFrame:
    """Set form: names of all such customers, duplicates kept, no order."""
    above = _above_average(spend_by_customer(g)).select(F.col("customer_id").alias("user_id"))
    return g.users.join(above, "user_id", "left_semi").select(full_name().alias("customer_name"))


def artist_revenue(g: Gallery, n: int = 50) -> DataFrame:
    """Revenue per artist; artists whose artifacts never sold have 0.
    Artifacts without a (known) artist drop out."""
    per_artist = (g.artifact.select("artifact_id", "artist_id")
                  .join(sales_by_artifact(g).select("artifact_id", "revenue"), "artifact_id", "left")
                  .groupBy("artist_id").agg(F.sum("revenue").alias("revenue")))
    return (per_artist.join(_names(g.users, "artist_id", "artist_name"), "artist_id", "inner")
            .select("artist_id", "artist_name",
                    F.coalesce("revenue", F.lit(0)).cast("decimal(22,2)").alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc("artist_id"))
            .limit(n))


def multi_seller_artists(g: Gallery, min_distinct: int = 1, approx: bool = False) -> DataFrame:
    """Artists with more than ``min_distinct`` distinct artifacts sold.

    Sold artifacts are first reduced to one row each (an aggregate), so the
    per-artist count is a plain count, i.e. the exact distinct count with a
    single shuffle of distinct ids.  ``approx=True`` uses a HyperLogLog sketch
    over the raw join instead."""
    if approx:
        sold = g.artifact.join(g.purchase.select("artifact_id"), "artifact_id", "inner")
        counts = sold.groupBy("artist_id").agg(F.approx_count_distinct("artifact_id").alias("artifacts_sold"))
    else:
        sold_ids = g.purchase.select("artifact_id").distinct()
        counts = (g.artifact.select("artifact_id", "artist_id").join(sold_ids, "artifact_id", "inner")
                  .groupBy("artist_id").agg(F.count(F.lit(1)).alias("artifacts_sold")))
    return (counts.filter(F.col("artifacts_sold") > min_distinct)
            .join(_names(g.users, "artist_id", "artist_name"), "artist_id", "inner")
            .select("artist_id", "artist_name", "artifacts_sold"))


# Accuracy of the sold-artifact sketches: 2^12 registers, relative standard error 1.04 / sqrt(2^12) of a merged sketch.
# One count in a few hundred lies beyond three standard errors; the bound is five.
SKETCH_LG = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG / 2)
SKETCH_BOUND = 5 * SKETCH_ERROR


def sold_sketches(g: Gallery) -> DataFrame:
    """R6, mergeable: per artist and month of purchase (NULL for purchases without
    a time) a HyperLogLog sketch of the artifacts sold.  A few KB a row at most, to
    be stored; each new month only adds its rows.  Artifacts without an artist have
    none."""
    made = g.artifact.filter(F.col("artist_id").isNotNull()).select("artifact_id", "artist_id")
    sold = g.purchase.select("artifact_id", F.trunc(F.col("purchase_ts").cast("date"), "month").alias("month")).distinct()
    return (sold.join(made, "artifact_id", "inner").groupBy("artist_id", "month")
            .agg(F.hll_sketch_agg("artifact_id", SKETCH_LG).alias("sold")))


def multi_seller_sketches(g: Gallery, sketches: DataFrame, min_distinct: int = 1, since=None, until=None) -> DataFrame:
    """R6 from stored sketches, merged over months (``since`` and ``until`` are
    inclusive month starts; without them all purchases count).  The estimate's
    relative standard error is ``SKETCH_ERROR``."""
    if since is not None:
        sketches = sketches.filter(F.col("month") >= F.lit(since).cast("date"))
    if until is not None:
        sketches = sketches.filter(F.col("month") <= F.lit(until).cast("date"))
    counts = sketches.groupBy("artist_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sold")).alias("artifacts_sold"))
    return (counts.filter(F.col("artifacts_sold") > min_distinct)
            .join(_names(g.users, "artist_id", "artist_name"), "artist_id", "inner")
            .select("artist_id", "artist_name", "artifacts_sold"))


def museum_sales_ranked(g: Gallery) -> DataFrame:
    """Every museum with its total sales and RANK (gaps after ties).

    The rank runs after the aggregate, on one row per museum, and is computed
    without a single-partition window (``rank_desc``)."""
    per_museum = (g.artifact.select("artifact_id", "museum_id")
                  .join(sales_by_artifact(g).select("artifact_id", "revenue"), "artifact_id", "inner")
                  .groupBy("museum_id").agg(F.sum("revenue").alias("total_sales")))
    totals = (g.museum.select("museum_id", "name")
              .join(per_museum, "museum_id", "left")
              .withColumn("total_sales", F.coalesce("total_sales", F.lit(0)).cast("decimal(22,2)")))
    return rank_desc(totals, "total_sales", "sales_rank")


# ---------------------------------------------------------------------- R8-R10

def type_max_price(g: Gallery, n: int = 50) -> DataFrame:
    """The dearest artifact of each type, one row per type (lowest id wins a
    tie; NULL type is a group of its own); types in ENUM order.

    ``row_number() == 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task sends at most one row per type."""
    w = Window.partitionBy("type").orderBy(F.desc("price"), F.asc("artifact_id"))
    best = g.artifact.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return (best.select("type", "artifact_id", "title", "price")
            .orderBy(enum_rank("type", g.type_domain).asc_nulls_first(), F.asc("artifact_id"))
            .limit(n))


def type_max_price_ties(g: Gallery) -> DataFrame:
    """Every artifact at its type's maximum price (ties kept), with artist name.
    The maximum is over all artifacts; a maximum held only by an artifact without
    a known artist removes the type.  NULL type never matches."""
    top = g.artifact.groupBy("type").agg(F.max("price").alias("_max"))
    # One row per type: AQE broadcasts it on its measured size (no explicit hint,
    # as values outside the ENUM domain could make it grow).
    at_max = g.artifact.join(top, (g.artifact.type == top.type) & (g.artifact.price == top._max), "left_semi")
    return (at_max.join(_names(g.users, "artist_id", "artist_name"), "artist_id", "inner")
            .select(F.col("type").alias("artifact_type"), "artifact_id",
                    F.col("title").alias("artifact_title"), "artist_name", "price"))


def above_artist_avg(g: Gallery) -> DataFrame:
    """Artifacts priced above their artist's mean price (NULL artist never
    qualifies).  ``price > sum / n`` is tested as ``price * n > sum``."""
    per_artist = (g.artifact.filter(F.col("artist_id").isNotNull())
                  .groupBy("artist_id").agg(F.sum("price").alias("_sum"), F.count("price").alias("_n")))
    return (g.artifact.join(per_artist, "artist_id", "inner")
            .filter(F.col("price") * F.col("_n") > F.col("_sum"))
            .select("artifact_id", "title", "price", "artist_id"))


# --------------------------------------------------------------------- R11-R14

def transactions(g: Gallery) -> DataFrame:
    """Purchase report with customer, artifact, artist and museum names,
    newest first.  The artifact side is enriched first (dimension joins), so
    the purchase table is shuffled once per distinct join key."""
    art = (g.artifact.select("artifact_id", "artist_id", "museum_id", F.col("title").alias("artifact_title"))
           .join(_names(g.users, "artist_id", "artist_name"), "artist_id", "left")
           .join(g.museum.select("museum_id", F.col("name").alias("museum_name")), "museum_id", "left")
           .select("artifact_id", "artifact_title", "artist_name", "museum_name"))
    return (g.purchase
            .join(_names(g.users, "customer_id", "customer_name"), "customer_id", "inner")
            .join(art, "artifact_id", "inner")
            .select(F.col("purchase_id").alias("transaction_id"), "purchase_ts", "customer_name",
                    "artifact_title", "quantity", "total_amount", "artist_name", "museum_name")
            .orderBy(F.desc("purchase_ts"), F.desc("transaction_id")))


def customer_totals(g: Gallery, keys: DataFrame) -> DataFrame:
    """Total spend for each asked customer id (0 when none), in bulk.
    ``keys`` has a ``customer_id`` column; repeated keys give repeated rows."""
    asked = keys.select("customer_id")
    spend = (g.purchase.join(asked.distinct(), "customer_id", "left_semi")
             .groupBy("customer_id").agg(F.sum("total_amount").alias("total")))
    return (asked.join(spend, "customer_id", "left")
            .select("customer_id", F.coalesce("total", F.lit(0)).cast("decimal(22,2)").alias("total")))


def stock_lookup(g: Gallery, keys: DataFrame) -> DataFrame:
    """Stock per asked artifact id: NULL quantity reads 0, unknown artifact NULL."""
    stock = g.artifact.select("artifact_id", F.coalesce("quantity", F.lit(0)).alias("_q"), F.lit(True).alias("_hit"))
    return (keys.select("artifact_id").join(stock, "artifact_id", "left")
            .select("artifact_id", F.when(F.col("_hit"), F.col("_q")).cast("int").alias("stock")))


def low_stock(g: Gallery, threshold: int = 3) -> DataFrame:
    """Artifacts with at most ``threshold`` units, fewest first."""
    return (g.artifact.filter(F.col("quantity") <= threshold)
            .select("artifact_id", "title", "quantity")
            .orderBy("quantity", "title", "artifact_id"))


def register_saved_views(g: Gallery, prefix: str = "") -> None:
    """The reports that are saved views, as temp views to be read by SQL."""
    views = {
        "admin_transactions": transactions(g),
        "customers_above_avg_names": customers_above_avg_names(g),
        "artifacts_above_artist_avg": above_artist_avg(g),
        "multi_seller_artists": multi_seller_artists(g),
        "museum_sales_ranked": museum_sales_ranked(g),
        "type_max_price_ties": type_max_price_ties(g),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
