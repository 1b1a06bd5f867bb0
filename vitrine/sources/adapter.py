"""Map the driver's star-schema tables onto the canonical gallery tables.

Every rule is closed-form (a pure function of one source row, or of a source
row plus a per-key aggregate), so an independent SQL engine can rebuild the
same rows; ``vitrine.plans.oracle`` holds that SQL twin.  The rules:

* users: customers keep ``c_custkey``; suppliers become artists with id
  ``ARTIST_BASE + s_suppkey``.  A few e-mails collide on purpose (case-blind)
  and every 211th is missing; every 101st customer is an Admin.
* museum: one per nation, located in its region.
* artifact: one per part, artist ``ARTIST_BASE + p_partkey % S`` (S = number
  of suppliers), NULL artist every 11th, NULL museum every 13th, price floored
  to whole units (makes ties), quantity ``p_size - 1`` (makes zeros); and one
  study of type Other per supplier, id ``STUDY_BASE + s_suppkey``, that nobody
  has ordered (makes unsold artifacts).
* exhibition: one per order; some have NULL end, museum or capacity, some end
  before they start, some name an unknown or non-artist organiser.
* purchase: one per line item; id ``l_orderkey * 100 + line rank within the
  order``; the seventh line of an order pays by a method outside the declared
  domain.
* attends: first sign-up per (customer, exhibition) pair from the events.
* visits, virtual_record, exhibition_artifact: from customer, part and all
  line items.

Exhibitions asked for by events are numbered up to a fraction of the number of
events, and artifacts put into carts up to the number of parts, so key ranges
grow with the data.

Request streams (purchase admission, attendance admission, cart events) are
derived here as well, so every registered query reads the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.sources.tables import Gallery

ARTIST_BASE = 10_000_000
STUDY_BASE = 20_000_000
# The driver's part types, in the order used as their ENUM order (deliberately
# not alphabetical, so ENUM ordering is observable).
DRIVER_TYPE_DOMAIN = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE", "Other"]
PAYMENT_BY_LINE = ["Card", "UPI", "Cash", "NetBanking"]  # index l_linenumber % 4

EVENTS_PER_EXHIBITION = 60  # so that some exhibitions fill up

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


# Declared schemas of the driver tables (columns this library reads); no
# inference from file footers at run time.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] as a CASE chain (stays inside codegen, no array literal)."""
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(values))):
        expr = F.when(index == i, F.lit(values[i])).otherwise(expr)
    return expr


def users(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    cust = customer.select(
        F.col("c_custkey").alias("user_id"),
        F.lit("Customer").alias("fname"),
        F.substr("c_name", F.lit(10)).alias("lname"),
        F.when(F.col("c_custkey") % 211 == 0, F.lit(None).cast("string"))
        .when(F.col("c_custkey") % 97 == 0,
              F.concat(F.lit("Dup"), (F.col("c_custkey") % 3).cast("string"), F.lit("@Gallery.Test")))
        .otherwise(F.concat(F.lit("customer"), F.col("c_custkey").cast("string"), F.lit("@gallery.test")))
        .alias("email"),
        F.when(F.col("c_custkey") % 101 == 0, F.lit("Admin")).otherwise(F.lit("Customer")).alias("role"),
        # Every 499th number is too long for its column.
        F.concat(F.lit("+"), F.col("c_custkey").cast("string"),
                 F.repeat(F.lit("0"), F.when(F.col("c_custkey") % 499 == 0, F.lit(25)).otherwise(F.lit(6)))).alias("contact_no"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
        F.lit(None).cast("string").alias("bio"),
        F.timestamp_add("MINUTE", F.col("c_custkey"), _ts_ntz("2023-01-01 00:00:00")).alias("created_at"),
    )
    art = supplier.select(
        (F.col("s_suppkey") + ARTIST_BASE).alias("user_id"),
        F.lit("Supplier").alias("fname"),
        F.substr("s_name", F.lit(10)).alias("lname"),
        F.when(F.col("s_suppkey") % 50 == 0,
               F.concat(F.lit("dup"), (F.col("s_suppkey") % 3).cast("string"), F.lit("@gallery.test")))
        .otherwise(F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit("@gallery.test")))
        .alias("email"),
        F.lit("Artist").alias("role"),
        F.lit(None).cast("string").alias("contact_no"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
        F.concat(F.lit("Works as "), F.col("s_name")).alias("bio"),
        F.timestamp_add("MINUTE", F.col("s_suppkey"), _ts_ntz("2023-01-01 00:00:00")).alias("created_at"),
    )
    return cust.unionByName(art)


def museum(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").cast("int").alias("museum_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("location"),
        (F.lit(100) + F.col("n_nationkey") * 10).cast("int").alias("capacity"),
        _ts_ntz("2023-01-01 00:00:00").alias("created_at"),
    )


def supplier_count(supplier: DataFrame) -> Column:
    """Number of suppliers as a scalar subquery (computed once, no driver round trip)."""
    return supplier.agg(F.count(F.lit(1))).scalar()


def artifact(part: DataFrame, supplier: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    n_sup = supplier_count(supplier)
    ext = _pick(k % 4, [".png", ".JPG", ".gif", ""])
    parts = part.select(
        k.alias("artifact_id"),
        F.when(k % 11 == 0, F.lit(None).cast("bigint")).otherwise(k % n_sup + ARTIST_BASE).alias("artist_id"),
        F.when(k % 13 == 0, F.lit(None).cast("int")).otherwise((k % 23).cast("int")).alias("museum_id"),
        F.col("p_name").alias("title"),
        F.repeat(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(". ")), F.col("p_size") % 8)
        .alias("description"),
        F.col("p_type").alias("type"),
        F.when(k % 3 != 0, F.concat(F.lit("Grade "), (F.col("p_size") % 5).cast("string"))).alias("quality"),
        # Every 997th owner is too long for its column.
        F.repeat(F.col("p_brand"), F.when(k % 997 == 0, F.lit(40)).otherwise(F.lit(1))).alias("owner"),
        F.floor("p_retailprice").cast("decimal(12,2)").alias("price"),
        (F.col("p_size") - 1).cast("int").alias("quantity"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("uploads/"), k.cast("string"), ext)).alias("image"),
        F.timestamp_add("HOUR", k, _ts_ntz("2024-01-01 00:00:00")).alias("created_at"),
    )
    s = F.col("s_suppkey")
    studies = supplier.select(
        (s + STUDY_BASE).alias("artifact_id"),
        (s + ARTIST_BASE).alias("artist_id"),
        F.col("s_nationkey").cast("int").alias("museum_id"),
        F.concat(F.lit("study "), F.substr("s_name", F.lit(10))).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.lit("Other").alias("type"),
        F.lit(None).cast("string").alias("quality"),
        F.col("s_name").alias("owner"),
        F.floor(F.abs("s_acctbal")).cast("decimal(12,2)").alias("price"),
        (s % 4).cast("int").alias("quantity"),
        F.lit(None).cast("string").alias("image"),
        F.timestamp_add("HOUR", s, _ts_ntz("2024-01-01 00:00:00")).alias("created_at"),
    )
    return parts.unionByName(studies)


def exhibition(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    n_sup = supplier_count(supplier)
    start = F.to_date("o_orderdate")
    return orders.select(
        k.alias("exhibition_id"),
        F.concat(F.lit("Exhibition "), k.cast("string")).alias("title"),
        F.concat(F.lit("Theme "), F.col("o_orderstatus")).alias("theme"),
        start.alias("start_date"),
        F.when(k % 7 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(start, (k % 40 - 3).cast("int"))).alias("end_date"),
        F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("description"),
        F.when(k % 11 == 0, F.lit(None).cast("int")).otherwise((k % 25).cast("int")).alias("museum_id"),
        F.when(k % 29 == 0, F.lit(None).cast("int")).otherwise((k % 30 + 10).cast("int")).alias("capacity"),
        F.when(k % 31 == 0, F.col("o_custkey")).otherwise(k % (n_sup + 1) + ARTIST_BASE).alias("artist_id"),
        F.col("o_orderdate").alias("created_at"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]


def purchase(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Sold lines as purchases.  The id is local to an order (a partitioned window
    over a handful of lines), so no global numbering pass is needed."""
    joined = lineitem.join(orders.select("o_orderkey", "o_custkey"), lineitem.l_orderkey == orders.o_orderkey, "inner")
    rank_in_order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return joined.select(
        (F.col("l_orderkey") * 100 + rank_in_order).alias("purchase_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("artifact_id"),
        F.col("l_shipdate").alias("purchase_ts"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("total_amount"),
        F.when(F.col("l_linenumber") == 7, F.lit("Voucher"))
        .otherwise(_pick(F.col("l_linenumber") % 4, PAYMENT_BY_LINE)).alias("payment_method"),
    )


def event_exhibition(events: DataFrame, per_exhibition: int) -> Column:
    """The exhibition an event is about: ids up to one per ``per_exhibition`` events."""
    n = events.agg(F.floor(F.count(F.lit(1)) / per_exhibition) + 1).scalar()
    return F.col("event_id") % n


def attends(events: DataFrame) -> DataFrame:
    """Existing attendances: the first sign-up of each (customer, exhibition) pair."""
    return (events.filter(F.col("event_type") == "signup")
            .groupBy(F.col("user_id").alias("customer_id"),
                     event_exhibition(events, EVENTS_PER_EXHIBITION).alias("exhibition_id"))
            .agg(F.min("ts").alias("attended_at")))


def visits(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_nationkey").cast("int").alias("museum_id"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 365).cast("int")).alias("visit_date"),
        F.col("c_mktsegment").alias("purpose"),
    )


def virtual_record(part: DataFrame) -> DataFrame:
    return part.select(
        (F.col("p_partkey") + 1).alias("record_id"),
        F.col("p_partkey").alias("artifact_id"),
        F.col("p_brand").alias("service"),
        F.concat(F.lit("vr/"), F.col("p_partkey").cast("string")).alias("link"),
        F.timestamp_add("HOUR", F.col("p_partkey"), _ts_ntz("2024-01-01 00:00:00")).alias("created_at"),
    )


def exhibition_artifact(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("exhibition_id"),
        F.col("l_partkey").alias("artifact_id"),
        F.col("l_linenumber").cast("int").alias("display_order"),
    )


def load_gallery(spark: SparkSession, sf_dir: str) -> Gallery:
    """Canonical tables over the driver tables; each is planned on first use."""
    sources: dict[str, DataFrame] = {}

    def src(name: str) -> DataFrame:
        if name not in sources:
            sources[name] = read_driver(spark, sf_dir, name)
        return sources[name]

    loaders = {
        "users": lambda: users(src("customer"), src("supplier")),
        "museum": lambda: museum(src("nation"), src("region")),
        "artifact": lambda: artifact(src("part"), src("supplier")),
        "exhibition": lambda: exhibition(src("orders"), src("supplier")),
        "purchase": lambda: purchase(src("lineitem"), src("orders")),
        "attends": lambda: attends(src("events")),
        "visits": lambda: visits(src("customer")),
        "virtual_record": lambda: virtual_record(src("part")),
        "exhibition_artifact": lambda: exhibition_artifact(src("lineitem")),
    }
    return Gallery(DRIVER_TYPE_DOMAIN, loaders)


# ---------------------------------------------------------------- request streams

PURCHASE_REQUEST_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
                          "l_extendedprice"]


def purchase_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a purchase request, in ship order."""
    li = read_driver(spark, sf_dir, "lineitem")
    orders = read_driver(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "inner").select(
        *PURCHASE_REQUEST_ORDER,
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("artifact_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def restocked(artifact_df: DataFrame) -> DataFrame:
    """Stock table for purchase admission: ten units per size step."""
    return artifact_df.withColumn("quantity", ((F.col("quantity") + 1) * 10).cast("int"))


ATTEND_REQUEST_ORDER = ["ts", "event_id"]


def attend_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as requests; some name no customer, some an unknown one."""
    ev = read_driver(spark, sf_dir, "events")
    customer = (F.when(F.col("event_id") % 53 == 0, F.lit(None).cast("bigint"))
                .when(F.col("event_id") % 59 == 0, F.col("user_id") + 50_000_000).otherwise(F.col("user_id")))
    return ev.filter(F.col("event_type").isin("view", "click")).select(
        "ts", "event_id", customer.alias("customer_id"),
        event_exhibition(ev, EVENTS_PER_EXHIBITION).alias("exhibition_id"),
    )


CART_EVENT_ORDER = ["ts", "event_id"]


def cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view = set quantity, click = add, purchase = checkout; the quantity from
    props.k, the artifact from it and the user, among all parts and one more."""
    ev = read_driver(spark, sf_dir, "events")
    n_part = read_driver(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    k = F.get_json_object("props", "$.k").cast("int")
    qty_text = (F.when(k % 9 == 8, F.lit("abc")).when(k == 50, F.lit("2147483647")).when(k == 51, F.lit("1_0"))
                .otherwise((k % 4 - 1).cast("string")))
    return ev.filter(F.col("event_type").isin("view", "click", "purchase")).select(
        "ts", "event_id",
        F.col("user_id"),
        ((k % 20 + F.floor(F.col("user_id") / 10) * 20) % (n_part + 1)).alias("artifact_id"),
        F.when(F.col("event_type") == "view", F.lit("set"))
        .when(F.col("event_type") == "click", F.lit("add"))
        .otherwise(F.lit("checkout")).alias("kind"),
        F.when(F.col("event_type") == "purchase", F.lit(None).cast("string")).otherwise(qty_text).alias("qty"),
    )
