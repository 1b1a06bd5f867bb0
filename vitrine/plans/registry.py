"""Registered queries: one per operator, each with its SQL oracle.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
driver's tables (through the adapter) and runs one operator over the whole
tables.  Parameters are fixed here so the result is reproducible; they are
the operator's own arguments (a search text, a date), never row caps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.plans.oracle import name, with_adapter
from vitrine.session import checkpoint_dir, configure
from vitrine.sources import adapter
from vitrine.sources.tables import Gallery


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op: str  # survey id


REGISTRY: dict[str, Query] = {}
# Lazy table definitions (plans, not data) per session and folder, so repeated
# queries do not re-plan the adapter.
_GALLERIES: dict[tuple[int, str], tuple[SparkSession, Gallery]] = {}


def gallery(spark: SparkSession, sf_dir: str) -> Gallery:
    key = (id(spark), sf_dir)
    cached = _GALLERIES.get(key)
    if cached is None or cached[0] is not spark:
        cached = (spark, adapter.load_gallery(spark, sf_dir))
        _GALLERIES[key] = cached
    return cached[1]


def register(key: str, op: str, sql: str | None):
    def wrap(fn: Callable[[Gallery, SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(gallery(spark, sf_dir), spark, sf_dir)

        REGISTRY[key] = Query(key, build, sql, op)
        return fn

    return wrap


# Fixed parameters of the registered queries.
AS_OF = "2001-01-01"
DRIVER_TYPE_CASE = "CASE type " + " ".join(
    f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(adapter.DRIVER_TYPE_DOMAIN)) + " ELSE 0 END"


from vitrine.operators import catalogue as Q  # noqa: E402
from vitrine.operators import reports as R  # noqa: E402

# ------------------------------------------------------------------ reports


SOLD_CTE = """
sold AS (SELECT artifact_id, sum(quantity) AS units, sum(total_amount) AS money FROM purchase GROUP BY artifact_id)"""
SPEND_CTES = """
spend AS (SELECT customer_id, sum(total_amount) AS amount FROM purchase GROUP BY customer_id),
weighed AS (SELECT customer_id, amount, amount * count(*) OVER () > sum(amount) OVER () AS above FROM spend)"""


@register("top_customers", "R1", with_adapter(f"""
SELECT customer_id, {name('u')} AS name, CAST(amount AS DECIMAL(22,2)) AS total_spent
FROM spend JOIN users u ON u.user_id = customer_id
QUALIFY row_number() OVER (ORDER BY amount DESC, customer_id) <= 10""", SPEND_CTES))
def _top_customers(g, spark, sf):
    return R.top_customers(g, 10)


@register("best_selling", "R2", with_adapter("""
SELECT artifact_id, title, CAST(ifnull(units, 0) AS BIGINT) AS units_sold,
       CAST(ifnull(money, 0) AS DECIMAL(22,2)) AS revenue
FROM artifact LEFT JOIN sold USING (artifact_id)
QUALIFY row_number() OVER (ORDER BY ifnull(units, 0) DESC, ifnull(money, 0) DESC, artifact_id) <= 20""", SOLD_CTE))
def _best_selling(g, spark, sf):
    return R.best_selling(g, 20)


@register("customers_above_avg", "R3", with_adapter(f"""
SELECT customer_id, {name('u')} AS name, CAST(amount AS DECIMAL(22,2)) AS total_spent
FROM (FROM weighed WHERE above) w JOIN users u ON u.user_id = w.customer_id
QUALIFY row_number() OVER (ORDER BY amount DESC, customer_id) <= 50""", SPEND_CTES))
def _customers_above_avg(g, spark, sf):
    return R.customers_above_avg(g, 50)


@register("customers_above_avg_names", "R4", with_adapter(f"""
SELECT {name('u')} AS customer_name
FROM users u SEMI JOIN (FROM weighed WHERE above) w ON w.customer_id = u.user_id""", SPEND_CTES))
def _customers_above_avg_names(g, spark, sf):
    return R.customers_above_avg_names(g)


@register("artist_revenue", "R5", with_adapter(f"""
SELECT artist_id, {name('u')} AS artist_name, CAST(earned AS DECIMAL(22,2)) AS revenue
FROM (SELECT artist_id, sum(ifnull(money, 0)) AS earned FROM artifact LEFT JOIN sold USING (artifact_id)
      GROUP BY artist_id) w JOIN users u ON u.user_id = w.artist_id
QUALIFY row_number() OVER (ORDER BY earned DESC, artist_id) <= 50""", SOLD_CTE))
def _artist_revenue(g, spark, sf):
    return R.artist_revenue(g, 50)


@register("multi_seller_artists", "R6", with_adapter(f"""
SELECT artist_id, {name('u')} AS artist_name, works AS artifacts_sold
FROM (SELECT artist_id, count(*) AS works FROM artifact SEMI JOIN purchase USING (artifact_id) GROUP BY artist_id) w
JOIN users u ON u.user_id = w.artist_id
WHERE works >= 2"""))
def _multi_seller_artists(g, spark, sf):
    return R.multi_seller_artists(g, 1)


# Counts from merged sketches next to the exact ones; five standard errors is the bound.
@register("multi_seller_sketches", "R6", with_adapter(f"""
SELECT artist_id, {name('u')} AS artist_name, works AS exact_sold, true AS within_bound
FROM (SELECT artist_id, count(*) AS works FROM artifact SEMI JOIN purchase USING (artifact_id) GROUP BY artist_id) w
JOIN users u ON u.user_id = w.artist_id"""))
def _multi_seller_sketches(g, spark, sf):
    exact = R.multi_seller_artists(g, 0).select("artist_id", "artist_name", F.col("artifacts_sold").alias("exact_sold"))
    merged = R.multi_seller_sketches(g, R.sold_sketches(g), -1).select("artist_id", "artifacts_sold")
    near = F.abs(F.col("artifacts_sold") - F.col("exact_sold")) <= F.col("exact_sold") * R.SKETCH_BOUND
    return (exact.join(merged, "artist_id", "left")
            .select("artist_id", "artist_name", "exact_sold", F.coalesce(near, F.lit(False)).alias("within_bound")))


@register("museum_sales_ranked", "R7", with_adapter("""
SELECT museum_id, name, total_sales,
       CAST(1 + (SELECT count(*) FROM takings o WHERE o.total_sales > t.total_sales) AS INTEGER) AS sales_rank
FROM takings t""", SOLD_CTE + """,
shown AS (SELECT museum_id, sum(money) AS money FROM sold JOIN artifact USING (artifact_id) GROUP BY museum_id),
takings AS (SELECT museum_id, name, CAST(ifnull(money, 0) AS DECIMAL(22,2)) AS total_sales
            FROM museum LEFT JOIN shown USING (museum_id))"""))
def _museum_sales_ranked(g, spark, sf):
    return R.museum_sales_ranked(g)


@register("type_max_price", "R8", with_adapter("""
SELECT DISTINCT ON (type) type, artifact_id, title, price FROM artifact ORDER BY type, price DESC, artifact_id"""))
def _type_max_price(g, spark, sf):
    return R.type_max_price(g, 50)


@register("type_max_price_ties", "R9", with_adapter(f"""
SELECT type AS artifact_type, artifact_id, title AS artifact_title, {name('u')} AS artist_name, price
FROM (SELECT *, rank() OVER (PARTITION BY type ORDER BY price DESC) AS place FROM artifact WHERE type IS NOT NULL) w
JOIN users u ON u.user_id = w.artist_id
WHERE place = 1"""))
def _type_max_price_ties(g, spark, sf):
    return R.type_max_price_ties(g)


@register("above_artist_avg", "R10", with_adapter("""
SELECT artifact_id, title, price, artist_id FROM artifact WHERE artist_id IS NOT NULL
QUALIFY price * count(price) OVER (PARTITION BY artist_id) > sum(price) OVER (PARTITION BY artist_id)"""))
def _above_artist_avg(g, spark, sf):
    return R.above_artist_avg(g)


@register("transactions", "R11", with_adapter("""
SELECT sale.purchase_id AS transaction_id, sale.purchase_ts, buyer.called AS customer_name,
       work.title AS artifact_title, sale.quantity, sale.total_amount, maker.called AS artist_name,
       hall.name AS museum_name
FROM purchase sale
JOIN artifact work USING (artifact_id)
JOIN called buyer ON buyer.id = sale.customer_id
LEFT JOIN called maker ON maker.id = work.artist_id
LEFT JOIN museum hall ON hall.museum_id = work.museum_id""", f"""
called AS (SELECT user_id AS id, {name('users')} AS called FROM users)"""))
def _transactions(g, spark, sf):
    return R.transactions(g)


@register("customer_totals", "R12", with_adapter("""
SELECT k.user_id AS customer_id,
       CAST(COALESCE((SELECT sum(p.total_amount) FROM purchase p WHERE p.customer_id = k.user_id), 0)
            AS DECIMAL(22,2)) AS total
FROM users k"""))
def _customer_totals(g, spark, sf):
    # Every user is asked for: artists and admins get 0.
    return R.customer_totals(g, g.users.select(F.col("user_id").alias("customer_id")))


@register("stock_lookup", "R13", with_adapter("""
SELECT k.artifact_id,
       CAST((SELECT COALESCE(a.quantity, 0) FROM artifact a WHERE a.artifact_id = k.artifact_id) AS INTEGER) AS stock
FROM (SELECT DISTINCT l_partkey + l_linenumber AS artifact_id FROM lineitem) k"""))
def _stock_lookup(g, spark, sf):
    # Asked ids come from the line items (part key shifted by line number), so
    # some ids past the last part are unknown and read NULL.
    li = adapter.read_driver(spark, sf, "lineitem")
    keys = li.select((F.col("l_partkey") + F.col("l_linenumber")).alias("artifact_id")).distinct()
    return R.stock_lookup(g, keys)


@register("low_stock", "R14", with_adapter("""
SELECT artifact_id, title, quantity FROM artifact WHERE quantity <= 3 ORDER BY quantity, title, artifact_id"""))
def _low_stock(g, spark, sf):
    return R.low_stock(g, 3)


# ---------------------------------------------------------------- catalogue

ART_COLS = ("artifact_id, artist_id, museum_id, title, description, type, quality, owner, price, quantity, image, "
            "created_at")


# Every work once, with the names that its ids stand for; a dash where an id is missing or stands for nobody.
@register("catalogue", "Q1", with_adapter("""
SELECT artifact_id, title, type, quantity, price, image,
       ifnull((SELECT who FROM makers WHERE id = artist_id), '—') AS artist_name,
       ifnull((SELECT hall FROM halls WHERE id = museum_id), '—') AS museum_name
FROM artifact""", f""",
makers AS (SELECT user_id AS id, {name('users')} AS who FROM users),
halls AS (SELECT museum_id AS id, name AS hall FROM museum)""".lstrip(",")))
def _catalogue(g, spark, sf):
    return Q.catalogue(g)


@register("artist_artifacts", "Q2", with_adapter(f"""
SELECT {ART_COLS} FROM artifact
WHERE artist_id IN (SELECT user_id FROM users WHERE role = 'Artist') AND title ILIKE '%RING%'
ORDER BY created_at DESC, artifact_id"""))
def _artist_artifacts(g, spark, sf):
    artists = g.users.filter(F.col("role") == "Artist").select(F.col("user_id").alias("artist_id"))
    return Q.artist_artifacts(g, artists, search="  RING ")


@register("in_stock_artifacts", "Q3", with_adapter(f"""
SELECT {ART_COLS} FROM artifact
WHERE quantity > 0 AND title ILIKE '%Ring%' AND type = 'SMALL'
ORDER BY created_at DESC, artifact_id"""))
def _in_stock_artifacts(g, spark, sf):
    return Q.in_stock_artifacts(g, search="Ring", type_="small")


@register("artifact_types", "Q4", with_adapter("SELECT DISTINCT type FROM artifact"))
def _artifact_types(g, spark, sf):
    return Q.artifact_types(g)


@register("museums_by_name", "Q5", with_adapter("SELECT museum_id, name FROM museum ORDER BY name, museum_id"))
def _museums_by_name(g, spark, sf):
    return Q.museums_by_name(g)


@register("upcoming_exhibitions_with_museum", "Q6", with_adapter(f"""
SELECT (SELECT name FROM museum WHERE museum.museum_id = shown.museum_id) AS museum_name, title, theme, capacity, start_date, end_date
FROM (FROM exhibition EXCEPT ALL FROM exhibition WHERE start_date < DATE '{AS_OF}' OR start_date IS NULL) shown"""))
def _upcoming_with_museum(g, spark, sf):
    return Q.upcoming_exhibitions_with_museum(g, AS_OF)


@register("upcoming_exhibitions", "Q7", with_adapter(f"""
SELECT exhibition_id, title, start_date, end_date FROM exhibition
WHERE start_date >= DATE '{AS_OF}'
ORDER BY start_date, exhibition_id
LIMIT 100"""))
def _upcoming(g, spark, sf):
    return Q.upcoming_exhibitions(g, AS_OF, 100)


def _faceted_sql(where):
    return with_adapter(f"""
SELECT a.artifact_id, a.title, a.type, a.price, a.quantity, a.image, {name('u')} AS artist_name, m.name AS museum_name
FROM artifact a LEFT JOIN users u ON a.artist_id = u.user_id LEFT JOIN museum m ON a.museum_id = m.museum_id
WHERE {where}
ORDER BY a.price DESC, a.artifact_id""")


@register("faceted_search", "Q8", _faceted_sql("a.title ILIKE '%blue%' AND a.price BETWEEN 920 AND 980"))
def _faceted_search(g, spark, sf):
    return Q.faceted_search(g, text="blue", min_price=920, max_price=980)


@register("faceted_search_museum", "Q8", _faceted_sql("a.type = 'SMALL' AND a.museum_id = 5"))
def _faceted_search_museum(g, spark, sf):
    return Q.faceted_search(g, type_="small", museum_id=5)


@register("faceted_search_artist", "Q8", _faceted_sql("a.artist_id = 10000004 AND a.price >= 900"))
def _faceted_search_artist(g, spark, sf):
    return Q.faceted_search(g, artist_id=adapter.ARTIST_BASE + 4, min_price=900)


@register("artifacts_by_ids", "Q9", with_adapter("""
SELECT artifact_id, title, price, image FROM artifact
WHERE artifact_id IN (SELECT artifact_id FROM exhibition_artifact)"""))
def _artifacts_by_ids(g, spark, sf):
    return Q.artifacts_by_ids(g, g.exhibition_artifact.select("artifact_id"))


# ---------------------------------------------------------------- admission

from vitrine.operators import admission as A  # noqa: E402

A1_ORDER = ", ".join(adapter.PURCHASE_REQUEST_ORDER)
A1_CTES = f"""
req AS (
  SELECT {A1_ORDER}, o_custkey AS customer_id, l_partkey AS artifact_id, CAST(l_quantity AS INTEGER) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
stock AS (SELECT artifact_id, CAST((quantity + 1) * 10 AS INTEGER) AS quantity FROM artifact),
r AS (
  SELECT req.*, s.quantity AS stock0, s.artifact_id IS NOT NULL AS found, u.user_id IS NOT NULL AS cust_ok
  FROM req LEFT JOIN stock s ON s.artifact_id = req.artifact_id
           LEFT JOIN (SELECT DISTINCT user_id FROM users) u ON u.user_id = req.customer_id
),
cand AS (
  SELECT r.*, row_number() OVER (PARTITION BY artifact_id ORDER BY {A1_ORDER}) AS rn
  FROM r WHERE found AND stock0 IS NOT NULL AND quantity IS NOT NULL AND quantity > 0 AND quantity <= stock0
),
fold(artifact_id, rn, stock_before, accepted, remaining) AS (
  SELECT artifact_id, rn, stock0, quantity <= stock0 AND cust_ok,
         stock0 - CASE WHEN quantity <= stock0 AND cust_ok THEN quantity ELSE 0 END
  FROM cand WHERE rn = 1
  UNION ALL
  SELECT c.artifact_id, c.rn, f.remaining, c.quantity <= f.remaining AND c.cust_ok,
         f.remaining - CASE WHEN c.quantity <= f.remaining AND c.cust_ok THEN c.quantity ELSE 0 END
  FROM fold f JOIN cand c ON c.artifact_id = f.artifact_id AND c.rn = f.rn + 1
)"""
A1_COLS = f"{A1_ORDER}, customer_id, artifact_id, quantity"


@register("admit_purchases", "A1", with_adapter(f"""
SELECT {', '.join('c.' + x for x in A1_COLS.split(', '))}, CAST(f.stock_before AS INTEGER) AS stock_before,
       f.accepted,
       CASE WHEN f.accepted THEN NULL WHEN c.quantity > f.stock_before THEN 'Insufficient stock'
            ELSE 'Customer not found' END AS reason
FROM cand c JOIN fold f ON f.artifact_id = c.artifact_id AND f.rn = c.rn
UNION ALL
SELECT {A1_COLS}, CAST(NULL AS INTEGER) AS stock_before, false AS accepted,
       CASE WHEN NOT found OR stock0 IS NULL THEN 'Artifact not found'
            WHEN quantity IS NULL THEN 'null_quantity'
            WHEN quantity <= 0 THEN 'quantity_not_positive'
            ELSE 'Insufficient stock' END AS reason
FROM r WHERE NOT (found AND stock0 IS NOT NULL AND quantity IS NOT NULL AND quantity > 0 AND quantity <= stock0)
""", A1_CTES, recursive=True))
def _admit_purchases(g, spark, sf):
    return A.admit_purchases(adapter.purchase_requests(spark, sf), adapter.restocked(g.artifact),
                             adapter.PURCHASE_REQUEST_ORDER, users=g.users)


A2_CTES = """
req AS (
  SELECT ts, event_id, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN user_id + 50000000
                            ELSE user_id END AS customer_id, event_id % (SELECT n FROM ex_count) AS exhibition_id
  FROM events WHERE event_type IN ('view', 'click')
),
flag AS (
  SELECT req.*, req.customer_id IN (SELECT user_id FROM users) AS known,
         coalesce(req.customer_id IN (SELECT user_id FROM users), false) AND a.customer_id IS NULL
           AND row_number() OVER (PARTITION BY req.exhibition_id, req.customer_id ORDER BY req.ts, req.event_id) = 1
           AS first_time
  FROM req LEFT JOIN attends a ON a.customer_id = req.customer_id AND a.exhibition_id = req.exhibition_id
),
run AS (
  SELECT flag.*,
         COALESCE(sum(CASE WHEN first_time THEN 1 ELSE 0 END) OVER (
           PARTITION BY exhibition_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS ft_before
  FROM flag
),
ex AS (
  SELECT e.exhibition_id, e.capacity,
         (SELECT count(*) FROM attends a WHERE a.exhibition_id = e.exhibition_id) AS existing
  FROM exhibition e
),
decided AS (
  SELECT run.ts, run.event_id, run.customer_id, run.exhibition_id,
         CASE WHEN ex.exhibition_id IS NULL OR ex.capacity IS NULL THEN 'Exhibition not found'
              WHEN ex.existing + least(run.ft_before, greatest(ex.capacity - ex.existing, 0)) >= ex.capacity
                THEN 'Exhibition capacity full'
              WHEN run.known IS NOT TRUE THEN 'Customer not found'
              WHEN NOT run.first_time THEN 'duplicate'
         END AS reason
  FROM run LEFT JOIN ex ON ex.exhibition_id = run.exhibition_id
)"""


@register("admit_attends", "A2", with_adapter("""
SELECT ts, event_id, customer_id, exhibition_id, reason IS NULL AS accepted, reason FROM decided""", A2_CTES))
def _admit_attends(g, spark, sf):
    return A.admit_attends(adapter.attend_requests(spark, sf), g.attends, g.exhibition,
                           adapter.ATTEND_REQUEST_ORDER, users=g.users)


@register("validate_exhibitions", "A3", with_adapter("""
SELECT e.exhibition_id, e.title, e.theme, e.start_date, e.end_date, e.description, e.museum_id, e.capacity,
       e.artist_id, e.created_at, reason IS NULL AS accepted, reason
FROM (
  SELECT e.*, CASE WHEN u.role IS NULL THEN 'Artist_ID not found'
                   WHEN u.role <> 'Artist' THEN 'Only artists can organize exhibitions' END AS reason
  FROM exhibition e LEFT JOIN users u ON u.user_id = e.artist_id
) e"""))
def _validate_exhibitions(g, spark, sf):
    return A.validate_exhibitions(g.exhibition, g.users)


# --------------------------------------------------------------------- cart

from vitrine.operators import cart as K  # noqa: E402

CART_CTES = """
ev AS (
  SELECT user_id, (k % 20 + (user_id // 10) * 20) % ((SELECT count(*) FROM part) + 1) AS artifact_id,
         CASE event_type WHEN 'view' THEN 'set' WHEN 'click' THEN 'add' ELSE 'checkout' END AS kind,
         CASE WHEN event_type = 'purchase' OR k % 9 = 8 OR k = 51 THEN NULL  -- 'abc' and '1_0' are no numbers
              WHEN k = 50 THEN 2147483647 ELSE k % 4 - 1 END AS q,
         row_number() OVER (ORDER BY ts, event_id) AS ord
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
        WHERE event_type IN ('view', 'click', 'purchase')) e
),
chk AS (SELECT user_id, max(ord) AS c FROM ev WHERE kind = 'checkout' GROUP BY user_id),
lastset AS (
  SELECT user_id, artifact_id, arg_max(q, ord) AS sq, max(ord) AS so
  FROM ev WHERE kind = 'set' AND q IS NOT NULL GROUP BY user_id, artifact_id
),
pairs AS (SELECT DISTINCT user_id, artifact_id FROM ev WHERE kind IN ('add', 'set') AND q IS NOT NULL),
cart AS (
  SELECT user_id, artifact_id, qty FROM (
    SELECT p.user_id, p.artifact_id,
           CAST(CASE WHEN ls.so IS NOT NULL AND (chk.c IS NULL OR ls.so > chk.c) THEN greatest(ls.sq, 0) ELSE 0 END
                + COALESCE((SELECT sum(greatest(1, e.q)) FROM ev e
                            WHERE e.kind = 'add' AND e.q IS NOT NULL AND e.user_id = p.user_id
                              AND e.artifact_id = p.artifact_id
                              AND e.ord > greatest(COALESCE(chk.c, 0), COALESCE(ls.so, 0))), 0) AS BIGINT) AS qty
    FROM pairs p
    LEFT JOIN chk ON chk.user_id = p.user_id
    LEFT JOIN lastset ls ON ls.user_id = p.user_id AND ls.artifact_id = p.artifact_id
  ) x WHERE qty > 0
)"""

PROBLEMS_SQL = """
  SELECT c.user_id, c.artifact_id, c.qty,
         CAST(CASE WHEN a.artifact_id IS NULL THEN NULL ELSE COALESCE(a.quantity, 0) END AS INTEGER) AS stock,
         CASE WHEN a.artifact_id IS NULL THEN 'missing' ELSE 'insufficient_stock' END AS problem,
         CASE WHEN a.artifact_id IS NULL THEN printf('Artifact ID %d no longer exists.', c.artifact_id)
              ELSE printf('“%s” has only %d left (you requested %d).', a.title, COALESCE(a.quantity, 0), c.qty)
         END AS message
  FROM cart c LEFT JOIN day_artifact a ON a.artifact_id = c.artifact_id
  WHERE c.qty > 0 AND (a.artifact_id IS NULL OR c.qty > COALESCE(a.quantity, 0))
"""
# Stock left after the day's purchase requests (A1), the stock open carts are checked against.
DAY_STOCK_CTES = A1_CTES + """,
day_artifact AS (
  SELECT a.artifact_id, a.title, a.price, a.image,
         CAST(s.quantity - COALESCE(t.taken, 0) AS INTEGER) AS quantity
  FROM artifact a JOIN stock s ON s.artifact_id = a.artifact_id
  LEFT JOIN (SELECT c.artifact_id, sum(c.quantity) AS taken FROM cand c
             JOIN fold f ON f.artifact_id = c.artifact_id AND f.rn = c.rn
             WHERE f.accepted GROUP BY c.artifact_id) t ON t.artifact_id = a.artifact_id
)"""
CHECKOUT_CTES = DAY_STOCK_CTES + "," + CART_CTES + ",\nproblems AS (" + PROBLEMS_SQL + ")"


def _cart(g, spark, sf):
    return K.cart_state(adapter.cart_events(spark, sf), adapter.CART_EVENT_ORDER)


def _day_artifact(g, spark, sf):
    """Artifacts with the stock left after the day's purchase requests."""
    stock = adapter.restocked(g.artifact)
    admitted = A.admit_purchases(adapter.purchase_requests(spark, sf), stock, adapter.PURCHASE_REQUEST_ORDER,
                                 users=g.users)
    return A.stock_after(admitted, stock)


@register("cart_state", "K1", with_adapter("SELECT user_id, artifact_id, qty FROM cart", CART_CTES))
def _cart_state(g, spark, sf):
    return _cart(g, spark, sf)


@register("price_cart", "K2", with_adapter("""
SELECT c.user_id, c.artifact_id, a.title, a.price, a.image, c.qty,
       CAST(CAST(a.price AS DECIMAL(33,2)) * c.qty AS DECIMAL(33,2)) AS subtotal,
       CAST(sum(CAST(CAST(a.price AS DECIMAL(33,2)) * c.qty AS DECIMAL(33,2))) OVER (PARTITION BY c.user_id) AS DECIMAL(38,2)) AS cart_total
FROM cart c JOIN artifact a ON a.artifact_id = c.artifact_id""", CART_CTES))
def _price_cart(g, spark, sf):
    return K.price_cart(_cart(g, spark, sf), g.artifact)


@register("validate_checkout", "K3", with_adapter(
    "SELECT user_id, artifact_id, qty, stock, problem, message FROM problems", CHECKOUT_CTES, recursive=True))
def _validate_checkout(g, spark, sf):
    return K.validate_checkout(_cart(g, spark, sf), _day_artifact(g, spark, sf))


CHECKOUT_AT = "2024-02-01 00:00:00"
K4_CTES = CHECKOUT_CTES + """,
baskets AS (
  SELECT user_id, row_number() OVER (ORDER BY user_id) AS n,
         list({'a': c.artifact_id, 'q': c.qty, 's': a.quantity}) AS wants
  FROM cart c JOIN day_artifact a USING (artifact_id)
  WHERE user_id NOT IN (SELECT user_id FROM problems) AND user_id IN (SELECT user_id FROM users)
  GROUP BY user_id
),
settled(n, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(u BIGINT, a BIGINT, q BIGINT)[])
  UNION ALL
  SELECT b.n, CASE WHEN len(list_filter(b.wants, lambda w: w.q > w.s - coalesce(list_sum(list_transform(
                       list_filter(s.taken, lambda t: t.a = w.a), lambda t: t.q)), 0))) = 0
                   THEN list_concat(s.taken, list_transform(b.wants, lambda w: {'u': b.user_id, 'a': w.a, 'q': w.q}))
                   ELSE s.taken END
  FROM settled s JOIN baskets b ON b.n = s.n + 1
),
bought AS (SELECT unnest(taken, recursive := true) FROM settled WHERE n = (SELECT max(n) FROM settled))"""


@register("post_checkout", "K4", with_adapter(f"""
SELECT u AS customer_id, a AS artifact_id, TIMESTAMP '{CHECKOUT_AT}' AS purchase_ts, CAST(q AS INTEGER) AS quantity,
       CAST(round(d.price * q, 2) AS DECIMAL(12,2)) AS total_amount, 'Card' AS payment_method
FROM bought JOIN day_artifact d ON d.artifact_id = a""", K4_CTES, recursive=True))
def _post_checkout(g, spark, sf):
    # Each is used several times below: worked out once.
    posted, _ = K.post_checkout(_cart(g, spark, sf).checkpoint(), _day_artifact(g, spark, sf).checkpoint(), users=g.users,
                                at=F.to_timestamp_ntz(F.lit(CHECKOUT_AT)))
    return posted


# The whole log of cart events: at each checkout the user's cart since the last one that passed is weighed
# against what earlier checkouts took.
PLAY_CTES = CART_CTES + """,
log AS (
  SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS ord
  FROM events WHERE event_type IN ('view', 'click', 'purchase')
),
marks AS (
  SELECT user_id, ord FROM ev WHERE kind = 'checkout'
  UNION ALL SELECT DISTINCT user_id, 0 FROM ev
  UNION ALL SELECT DISTINCT user_id, (SELECT count(*) + 1 FROM ev) FROM ev
),
inside AS (
  SELECT f.user_id, f.ord AS since, t.ord AS upto, e.artifact_id, e.kind, e.q, e.ord,
         max(CASE WHEN e.kind = 'set' THEN e.ord END) OVER (PARTITION BY f.user_id, f.ord, t.ord, e.artifact_id) AS reset
  FROM marks f JOIN marks t ON t.user_id = f.user_id AND t.ord > f.ord
  JOIN ev e ON e.user_id = f.user_id AND e.ord > f.ord AND e.ord < t.ord
  WHERE e.kind <> 'checkout' AND e.q IS NOT NULL
),
basket AS (
  SELECT user_id, since, upto, artifact_id,
         CAST(sum(CASE WHEN ord = reset THEN greatest(q, 0) WHEN kind = 'add' AND (reset IS NULL OR ord > reset) THEN greatest(q, 1) ELSE 0 END) AS BIGINT) AS qty
  FROM inside GROUP BY 1, 2, 3, 4
),
wants AS (
  SELECT user_id, since, upto, list({'a': b.artifact_id, 'q': b.qty, 's': CASE WHEN a.artifact_id IS NOT NULL THEN ifnull(a.quantity, 0) END}) AS w
  FROM basket b LEFT JOIN artifact a USING (artifact_id) WHERE b.qty > 0 GROUP BY 1, 2, 3
),
-- Users who share artifacts, however indirectly, meet the same stock; one step is a checkout in each such circle.
circles(u, v) AS (
  SELECT DISTINCT user_id, user_id FROM ev
  UNION
  SELECT c.u, y.user_id FROM circles c JOIN pairs x ON x.user_id = c.v JOIN pairs y ON y.artifact_id = x.artifact_id
),
circle AS (SELECT u AS user_id, min(v) AS c FROM circles GROUP BY u),
steps AS (
  SELECT user_id, ord, c, row_number() OVER (PARTITION BY c ORDER BY ord) AS k, user_id IN (SELECT user_id FROM users) AS known
  FROM ev JOIN circle USING (user_id) WHERE kind = 'checkout'
),
play(c, k, u, ord, bad, posted, taken) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(a BIGINT, q BIGINT, l BIGINT)[]),
         CAST([] AS STRUCT(u BIGINT, o BIGINT)[]), CAST([] AS STRUCT(u BIGINT, o BIGINT, a BIGINT, q BIGINT)[])
  FROM circle
  UNION ALL
  SELECT c, k, u, ord, bad,
         CASE WHEN known AND len(bad) = 0 THEN list_append(posted, {'u': u, 'o': ord}) ELSE posted END,
         CASE WHEN known AND len(bad) = 0 THEN list_concat(taken, list_transform(w, lambda x: {'u': u, 'o': ord, 'a': x.a, 'q': x.q})) ELSE taken END
  FROM (
    SELECT s.c, s.k, s.user_id AS u, s.ord, s.known, p.posted, p.taken, ifnull(w.w, []) AS w,
           list_filter(list_transform(ifnull(w.w, []), lambda x: {'a': x.a, 'q': x.q, 'l': x.s - coalesce(list_sum(list_transform(
             list_filter(p.taken, lambda t: t.a = x.a), lambda t: t.q)), 0)}), lambda y: y.l IS NULL OR y.q > y.l) AS bad
    FROM (SELECT p.*, s.user_id AS next, coalesce(list_max(list_transform(list_filter(p.posted, lambda d: d.u = s.user_id), lambda d: d.o)), 0) AS since
          FROM play p JOIN steps s ON s.c = p.c AND s.k = p.k + 1) p
    JOIN steps s ON s.c = p.c AND s.k = p.k + 1
    LEFT JOIN wants w ON w.user_id = s.user_id AND w.upto = s.ord AND w.since = p.since) step
),
outcome AS (SELECT * FROM play QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC) = 1)"""


def _checkouts(g, spark, sf):
    return K.play_checkouts(adapter.cart_events(spark, sf), g.artifact, adapter.CART_EVENT_ORDER, users=g.users)


@register("checkout_purchases", "K4 in K1", with_adapter("""
SELECT l.ts, l.event_id, x.u AS customer_id, x.a AS artifact_id, CAST(x.q AS INTEGER) AS quantity,
       CAST(round(d.price * x.q, 2) AS DECIMAL(12,2)) AS total_amount, 'Card' AS payment_method
FROM (SELECT unnest(taken, recursive := true) FROM outcome) x JOIN log l ON l.ord = x.o JOIN artifact d ON d.artifact_id = x.a""",
          PLAY_CTES, recursive=True))
def _checkout_purchases(g, spark, sf):
    return _checkouts(g, spark, sf).purchases


@register("checkout_refusals", "K3 in K1", with_adapter("""
SELECT l.ts, l.event_id, x.u AS user_id, x.a AS artifact_id, x.q AS qty, CAST(x.l AS INTEGER) AS stock,
       CASE WHEN x.l IS NULL THEN 'missing' ELSE 'insufficient_stock' END AS problem,
       CASE WHEN x.l IS NULL THEN printf('Artifact ID %d no longer exists.', x.a)
            ELSE printf('“%s” has only %d left (you requested %d).', d.title, x.l, x.q) END AS message
FROM (SELECT u, ord, unnest(bad, recursive := true) FROM play) x JOIN log l ON l.ord = x.ord LEFT JOIN artifact d ON d.artifact_id = x.a
UNION ALL
SELECT l.ts, l.event_id, s.user_id, NULL, NULL, NULL, 'unknown_customer', 'Customer not found'
FROM play p JOIN steps s ON s.c = p.c AND s.k = p.k JOIN log l ON l.ord = s.ord
JOIN wants w ON w.user_id = s.user_id AND w.upto = s.ord AND w.since = 0
WHERE NOT s.known AND len(p.bad) = 0""", PLAY_CTES, recursive=True))
def _checkout_refusals(g, spark, sf):
    return _checkouts(g, spark, sf).refusals


@register("checkout_carts", "K1 after K4", with_adapter("""
SELECT b.user_id, b.artifact_id, b.qty
FROM basket b JOIN (SELECT user_id, coalesce(max(d.o), 0) AS since
                    FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN (SELECT unnest(posted, recursive := true) FROM outcome) d ON d.u = user_id
                    GROUP BY user_id) z ON z.user_id = b.user_id AND z.since = b.since
WHERE b.qty > 0 AND b.upto = (SELECT count(*) + 1 FROM ev)""", PLAY_CTES, recursive=True))
def _checkout_carts(g, spark, sf):
    return _checkouts(g, spark, sf).carts


# -------------------------------------------------------------------- audit

from vitrine.operators import audit as C  # noqa: E402
from vitrine.sources import schema as SC  # noqa: E402


def _key_sql(cols, alias=""):
    p = f"{alias}." if alias else ""
    return " || '|' || ".join(f"COALESCE(CAST({p}{c} AS VARCHAR), 'NULL')" for c in cols)


def _sql_union(parts):
    return "\nUNION ALL\n".join(parts) if parts else (
        "SELECT CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS rule, "
        "CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail WHERE FALSE")


def _keys_sql():
    parts = []
    for t, cols in SC.PRIMARY_KEYS.items():
        any_null = " OR ".join(f"{c} IS NULL" for c in cols)
        parts.append(f"SELECT '{t}' AS table_name, 'pk_null' AS rule, {_key_sql(cols)} AS key, '' AS detail "
                     f"FROM {t} WHERE {any_null}")
        parts.append(f"SELECT '{t}', 'pk_duplicate', {_key_sql(cols)}, CAST(count(*) AS VARCHAR) FROM {t} "
                     f"WHERE NOT ({any_null}) GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    return _sql_union(parts)


def _unique_sql():
    parts = []
    for t, c in SC.UNIQUE_COLUMNS:
        text = SC.SCHEMAS[t][c].dataType.typeName() == "string"
        grp = f"lower(strip_accents({c}))" if text else c
        parts.append(f"SELECT '{t}' AS table_name, 'unique_{c}' AS rule, min(CAST({c} AS VARCHAR)) AS key, "
                     f"CAST(count(*) AS VARCHAR) AS detail FROM {t} WHERE {c} IS NOT NULL "
                     f"GROUP BY {grp} HAVING count(*) > 1")
    return _sql_union(parts)


def _fk_sql():
    parts = []
    for child, col, parent, pcol, _ in SC.FOREIGN_KEYS:
        parts.append(f"SELECT '{child}' AS table_name, 'fk_{col}' AS rule, {_key_sql(SC.PRIMARY_KEYS[child], 'x')} "
                     f"AS key, '{col}=' || CAST(x.{col} AS VARCHAR) AS detail FROM {child} x "
                     f"WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{pcol} = x.{col})")
    return _sql_union(parts)


def _row_sql(family):
    parts = []
    for t in SC.SCHEMAS:
        key = _key_sql(SC.PRIMARY_KEYS[t])
        rules = []
        if family == "not_null":
            rules = [("not_null", f"{c} IS NULL", f"'{c}'") for c in SC.NOT_NULL_COLUMNS.get(t, [])]
        elif family == "checks":
            rules = [(name, f"NOT ({cond})", "''") for tt, name, cond in SC.CHECKS if tt == t]
        elif family == "domains":
            domains = {("users", "role"): SC.ROLE_DOMAIN, ("artifact", "type"): adapter.DRIVER_TYPE_DOMAIN,
                       ("purchase", "payment_method"): SC.PAYMENT_DOMAIN}
            for (tt, c), values in domains.items():
                if tt == t:
                    vals = ", ".join(f"'{v}'" for v in values)
                    rules.append(("domain", f"{c} IS NOT NULL AND {c} NOT IN ({vals})", f"'{c}=' || {c}"))
            for (tt, c), limit in SC.VARCHAR_LIMITS.items():
                if tt == t:
                    rules.append(("length", f"length({c}) > {limit}", f"'{c}'"))
        elif family == "images" and t == "artifact":
            exts = ", ".join(f"'{e}'" for e in SC.IMAGE_EXTENSIONS)
            rules = [("image_extension",
                      f"image IS NOT NULL AND NOT (instr(image, '.') > 0 "
                      f"AND lower(regexp_extract(image, '[^.]*$')) IN ({exts}))", "image")]
        for rule, cond, detail in rules:
            parts.append(f"SELECT '{t}' AS table_name, '{rule}' AS rule, {key} AS key, {detail} AS detail "
                         f"FROM {t} WHERE {cond}")
    return _sql_union(parts)


@register("audit_keys", "C1", with_adapter(_keys_sql()))
def _audit_keys(g, spark, sf):
    return C.audit_keys(g)


@register("audit_unique", "C2", with_adapter(_unique_sql()))
def _audit_unique(g, spark, sf):
    return C.audit_unique(g)


@register("audit_foreign_keys", "C3", with_adapter(_fk_sql()))
def _audit_foreign_keys(g, spark, sf):
    return C.audit_foreign_keys(g)


@register("audit_not_null", "C4", with_adapter(_row_sql("not_null")))
def _audit_not_null(g, spark, sf):
    return C.audit_not_null(g)


@register("audit_checks", "C5", with_adapter(_row_sql("checks").replace("char_length(", "length(")))
def _audit_checks(g, spark, sf):
    return C.audit_checks(g)


@register("audit_domains", "C6", with_adapter(_row_sql("domains")))
def _audit_domains(g, spark, sf):
    return C.audit_domains(g)


@register("audit_images", "C7", with_adapter(_row_sql("images")))
def _audit_images(g, spark, sf):
    return C.audit_images(g)


# ------------------------------------------------------------------ changes

from vitrine.operators import changes as W  # noqa: E402
from vitrine.operators import display as P  # noqa: E402

NOW = "2024-02-01 00:00:00"
IMG_OK_SQL = ("{c} IS NOT NULL AND instr({c}, '.') > 0 AND lower(regexp_extract({c}, '[^.]*$')) IN ("
              + ", ".join(f"'{e}'" for e in SC.IMAGE_EXTENSIONS) + ")")
TYPE_LIST_SQL = ", ".join(f"'{v}'" for v in adapter.DRIVER_TYPE_DOMAIN)


def _upload_forms(g):
    """Upload form rows derived from the catalogue: padded titles, blank and
    malformed numbers, blank / malformed / unknown museums, missing types."""
    k = F.col("artifact_id")
    return g.artifact.select(
        k.alias("source_id"),
        F.when(k % 43 == 0, F.lit(99_999_999)).otherwise(F.col("artist_id")).alias("artist_id"),
        F.when(k % 37 != 0, F.concat(F.lit("  "), F.repeat(F.col("title"), F.when(k % 41 == 0, F.lit(30)).otherwise(
            F.lit(1))), F.lit(" "))).alias("title"),
        "description",
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("type")).alias("type"),
        F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.lit("n/a"))
        .otherwise(F.col("price").cast("string")).alias("price"),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("-2"))
        .otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(k % 13 == 0, F.lit("")).when(k % 17 == 0, F.lit("x"))
        .otherwise((k % 27).cast("string")).alias("museum"),
        "image")


@register("append_artifacts", "W1", with_adapter(f"""
SELECT source_id, artist_id, museum_id, title, description, type, price, quantity, image, reason,
       CASE WHEN reason IS NULL THEN (SELECT max(artifact_id) FROM artifact)
            + row_number() OVER (PARTITION BY reason IS NULL ORDER BY source_id) END AS artifact_id
FROM (
  SELECT c.*, CASE WHEN price IS NULL THEN 'bad_price'
                   WHEN quantity IS NULL THEN 'bad_quantity'
                   WHEN bad_museum THEN 'bad_museum'
                   WHEN title IS NULL THEN 'title_missing'
                   WHEN length(title) > 150 THEN 'title_too_long'
                   WHEN type NOT IN ({TYPE_LIST_SQL}) THEN 'bad_type'
                   WHEN price < 0 THEN 'price_negative'
                   WHEN quantity < 0 THEN 'quantity_negative'
                   WHEN artist_id IS NOT NULL AND artist_id NOT IN (SELECT user_id FROM users) THEN 'artist_not_found'
                   WHEN c.museum_id IS NOT NULL AND m.museum_id IS NULL THEN 'museum_not_found' END AS reason
  FROM (
    SELECT source_id, artist_id, trim(title) AS title, trim(description) AS description,
           COALESCE(type, 'Other') AS type,
           CASE WHEN NULLIF(trim(price), '') IS NULL THEN CAST(0 AS DECIMAL(12,2))
                ELSE TRY_CAST(trim(price) AS DECIMAL(12,2)) END AS price,
           CASE WHEN NULLIF(trim(quantity), '') IS NULL THEN 0 ELSE TRY_CAST(trim(quantity) AS INTEGER) END AS quantity,
           TRY_CAST(trim(museum) AS INTEGER) AS museum_id,
           NULLIF(trim(museum), '') IS NOT NULL AND TRY_CAST(trim(museum) AS INTEGER) IS NULL AS bad_museum,
           CASE WHEN {IMG_OK_SQL.format(c='image')} THEN image END AS image
    FROM raw
  ) c LEFT JOIN museum m ON m.museum_id = c.museum_id
) j""", """
raw AS (
  SELECT artifact_id AS source_id, CASE WHEN artifact_id % 43 = 0 THEN 99999999 ELSE artist_id END AS artist_id,
         CASE WHEN artifact_id % 37 <> 0 THEN
           '  ' || repeat(title, CASE WHEN artifact_id % 41 = 0 THEN 30 ELSE 1 END) || ' ' END AS title, description,
         CASE WHEN artifact_id % 10 = 0 THEN NULL ELSE type END AS type,
         CASE WHEN artifact_id % 6 = 0 THEN '' WHEN artifact_id % 6 = 1 THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS price,
         CASE WHEN artifact_id % 4 = 0 THEN '' WHEN artifact_id % 4 = 1 THEN '-2' ELSE CAST(quantity AS VARCHAR) END
           AS quantity,
         CASE WHEN artifact_id % 13 = 0 THEN '' WHEN artifact_id % 17 = 0 THEN 'x'
              ELSE CAST(artifact_id % 27 AS VARCHAR) END AS museum,
         image
  FROM artifact
)"""))
def _append_artifacts(g, spark, sf):
    _, outcome = W.append_artifacts(g, _upload_forms(g), ["source_id"], now=F.to_timestamp_ntz(F.lit(NOW)))
    return outcome.select("source_id", "artist_id", "museum_id", "title", "description", "type", "price",
                          "quantity", "image", "reason", "artifact_id")


def _exhibition_forms(spark, sf):
    """Exhibition form rows from the orders."""
    orders = adapter.read_driver(spark, sf, "orders")
    n_sup = adapter.supplier_count(adapter.read_driver(spark, sf, "supplier"))
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return orders.select(
        k.alias("source_id"),
        F.when(k % 37 != 0, F.concat(F.repeat(F.lit("Exhibition "), F.when(k % 41 == 0, F.lit(20)).otherwise(F.lit(1))),
                                     k.cast("string"))).alias("title"),
        F.concat(F.lit(" Theme "), F.col("o_orderstatus"), F.lit(" ")).alias("theme"),
        start.cast("string").alias("start"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.date_add(start, (k % 40 - 3).cast("int")).cast("string"))
        .alias("end"),
        F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.lit("many"))
        .otherwise((k % 30 + 10).cast("string")).alias("capacity"),
        F.when(k % 23 == 0, F.lit("")).otherwise((k % 27).cast("string")).alias("museum"),
        F.when(k % 31 == 0, F.col("o_custkey")).otherwise(k % (n_sup + 1) + adapter.ARTIST_BASE).alias("artist_id"))


EXHIBITION_FORMS_CTE = """
raw AS (
  SELECT o_orderkey AS source_id,
         CASE WHEN o_orderkey % 37 <> 0 THEN repeat('Exhibition ', CASE WHEN o_orderkey % 41 = 0 THEN 20 ELSE 1 END)
              || CAST(o_orderkey AS VARCHAR) END AS title,
         ' Theme ' || o_orderstatus || ' ' AS theme,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start,
         CASE WHEN o_orderkey % 7 = 0 THEN ''
              ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 3 AS INTEGER) AS VARCHAR) END AS "end",
         CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'many'
              ELSE CAST(o_orderkey % 30 + 10 AS VARCHAR) END AS capacity,
         CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(o_orderkey % 27 AS VARCHAR) END AS museum,
         CASE WHEN o_orderkey % 31 = 0 THEN o_custkey
              ELSE o_orderkey % ((SELECT n FROM s_count) + 1) + 10000000 END AS artist_id
  FROM orders
)"""


@register("append_exhibitions", "W2", with_adapter("""
SELECT source_id, title, theme, start_date, end_date, museum_id, capacity, artist_id, reason,
       CASE WHEN reason IS NULL THEN (SELECT max(exhibition_id) FROM exhibition)
            + row_number() OVER (PARTITION BY reason IS NULL ORDER BY source_id) END AS exhibition_id
FROM (
  SELECT p.*, CASE WHEN p.capacity IS NULL THEN 'bad_capacity'
                   WHEN p.museum_id IS NULL THEN 'bad_museum'
                   WHEN p.bad_date THEN 'bad_date'
                   WHEN p.title IS NULL THEN 'title_missing'
                   WHEN length(p.title) > 150 THEN 'title_too_long'
                   WHEN u.role IS NULL THEN 'Artist_ID not found'
                   WHEN u.role <> 'Artist' THEN 'Only artists can organize exhibitions'
                   WHEN p.end_date < p.start_date THEN 'end_before_start'
                   WHEN m.museum_id IS NULL THEN 'museum_not_found' END AS reason
  FROM (
    SELECT source_id, trim(title) AS title, trim(theme) AS theme,
           TRY_CAST(NULLIF(trim(start), '') AS DATE) AS start_date,
           TRY_CAST(NULLIF(trim("end"), '') AS DATE) AS end_date,
           (NULLIF(trim(start), '') IS NOT NULL AND TRY_CAST(NULLIF(trim(start), '') AS DATE) IS NULL)
             OR (NULLIF(trim("end"), '') IS NOT NULL AND TRY_CAST(NULLIF(trim("end"), '') AS DATE) IS NULL) AS bad_date,
           TRY_CAST(trim(museum) AS INTEGER) AS museum_id,
           CASE WHEN NULLIF(trim(capacity), '') IS NULL THEN 0 ELSE TRY_CAST(trim(capacity) AS INTEGER) END AS capacity,
           artist_id
    FROM raw
  ) p
  LEFT JOIN users u ON u.user_id = p.artist_id
  LEFT JOIN museum m ON m.museum_id = p.museum_id
) j""", EXHIBITION_FORMS_CTE))
def _append_exhibitions(g, spark, sf):
    _, outcome = W.append_exhibitions(g, _exhibition_forms(spark, sf), ["source_id"])
    return outcome.select("source_id", "title", "theme", "start_date", "end_date", "museum_id", "capacity",
                          "artist_id", "reason", "exhibition_id")


@register("delete_artifacts", "W3", with_adapter("""
SELECT i.artifact_id,
       CASE WHEN a.artifact_id IS NULL THEN 'not_found' WHEN s.artifact_id IS NOT NULL THEN 'archived'
            ELSE 'deleted' END AS action,
       CASE WHEN a.artifact_id IS NOT NULL AND s.artifact_id IS NOT NULL THEN 0 END AS quantity
FROM (SELECT DISTINCT artifact_id FROM artifact WHERE quantity = 0) i
LEFT JOIN artifact a ON a.artifact_id = i.artifact_id
LEFT JOIN (SELECT DISTINCT artifact_id FROM purchase) s ON s.artifact_id = i.artifact_id"""))
def _delete_artifacts(g, spark, sf):
    # Sold-out artifacts are taken off the catalogue.
    after, report = W.delete_artifacts(g, g.artifact.filter(F.col("quantity") == 0).select("artifact_id"))
    return report.join(after.artifact.select("artifact_id", "quantity"), "artifact_id", "left")


@register("owner_delete_artifacts", "W3b", with_adapter("""
SELECT r.artifact_id, r.requester_id, r.role,
       CASE WHEN a.artifact_id IS NULL THEN 'not_found'
            WHEN NOT COALESCE(r.role = 'Admin' OR (r.role = 'Artist' AND a.artist_id = r.requester_id), false)
              THEN 'unauthorized'
            WHEN EXISTS (SELECT 1 FROM purchase p WHERE p.artifact_id = r.artifact_id) THEN 'has_purchases'
            ELSE 'deleted' END AS outcome
FROM (SELECT DISTINCT ea.artifact_id, e.artist_id AS requester_id, u.role
      FROM exhibition_artifact ea JOIN exhibition e ON e.exhibition_id = ea.exhibition_id
      LEFT JOIN users u ON u.user_id = e.artist_id) r
LEFT JOIN artifact a ON a.artifact_id = r.artifact_id"""))
def _owner_delete_artifacts(g, spark, sf):
    # Each exhibition's organiser asks to remove the pieces it shows.
    requests = (g.exhibition_artifact.join(
        g.exhibition.select("exhibition_id", F.col("artist_id").alias("requester_id")), "exhibition_id")
        .join(g.users.select(F.col("user_id").alias("requester_id"), "role"), "requester_id", "left")
        .select("artifact_id", "requester_id", "role").distinct())
    _, outcome = W.owner_delete_artifacts(g, requests)
    return outcome


def _cascade_sql():
    du = "(SELECT user_id FROM users WHERE role = 'Admin')"
    dm = "(SELECT museum_id FROM museum WHERE location = 'AFRICA')"
    de = "(SELECT exhibition_id FROM exhibition WHERE start_date < DATE '1995-02-01')"
    parts = [
        f"SELECT 'users' AS table_name, {_key_sql(['user_id'])} AS key, 'deleted' AS action FROM users "
        f"WHERE user_id IN {du}",
        f"SELECT 'museum', {_key_sql(['museum_id'])}, 'deleted' FROM museum WHERE museum_id IN {dm}",
        f"SELECT 'exhibition', {_key_sql(['exhibition_id'])}, 'deleted' FROM exhibition WHERE exhibition_id IN {de}",
        f"SELECT 'exhibition', {_key_sql(['exhibition_id'])}, 'set_null:artist_id' FROM exhibition "
        f"WHERE exhibition_id NOT IN {de} AND artist_id IN {du}",
        f"SELECT 'exhibition', {_key_sql(['exhibition_id'])}, 'set_null:museum_id' FROM exhibition "
        f"WHERE exhibition_id NOT IN {de} AND museum_id IN {dm}",
        f"SELECT 'artifact', {_key_sql(['artifact_id'])}, 'set_null:artist_id' FROM artifact WHERE artist_id IN {du}",
        f"SELECT 'artifact', {_key_sql(['artifact_id'])}, 'set_null:museum_id' FROM artifact WHERE museum_id IN {dm}",
        f"SELECT 'attends', {_key_sql(SC.PRIMARY_KEYS['attends'])}, 'deleted' FROM attends "
        f"WHERE customer_id IN {du} OR exhibition_id IN {de}",
        f"SELECT 'visits', {_key_sql(SC.PRIMARY_KEYS['visits'])}, 'deleted' FROM visits "
        f"WHERE customer_id IN {du} OR museum_id IN {dm}",
        f"SELECT 'purchase', {_key_sql(['purchase_id'])}, 'deleted' FROM purchase WHERE customer_id IN {du}",
        f"SELECT 'exhibition_artifact', {_key_sql(SC.PRIMARY_KEYS['exhibition_artifact'])}, 'deleted' "
        f"FROM exhibition_artifact WHERE exhibition_id IN {de}",
    ]
    return "\nUNION ALL\n".join(parts)


@register("cascade_delete", "W4", with_adapter(_cascade_sql()))
def _cascade_delete(g, spark, sf):
    # Admin accounts, the museums of one region and the oldest exhibitions are removed.
    _, log = W.cascade_delete(
        g,
        users=g.users.filter(F.col("role") == "Admin").select("user_id"),
        museums=g.museum.filter(F.col("location") == "AFRICA").select("museum_id"),
        exhibitions=g.exhibition.filter(F.col("start_date") < F.lit("1995-02-01").cast("date"))
        .select("exhibition_id"))
    return log


def _rekey_sql():
    um = "(SELECT user_id AS old_id, user_id + 10000000 AS new_id FROM users WHERE role = 'Artist')"
    parts = [f"SELECT 'users' AS table_name, {_key_sql(['user_id'], 'x')} AS key, 'user_id' AS column_name, "
             f"CAST(x.user_id AS BIGINT) AS old_value, CAST(m.new_id AS BIGINT) AS new_value "
             f"FROM users x JOIN {um} m ON m.old_id = x.user_id"]
    for child, col, parent, _, _ in SC.FOREIGN_KEYS:
        if parent == "users":
            parts.append(f"SELECT '{child}', {_key_sql(SC.PRIMARY_KEYS[child], 'x')}, '{col}', "
                         f"CAST(x.{col} AS BIGINT), CAST(m.new_id AS BIGINT) FROM {child} x "
                         f"JOIN {um} m ON m.old_id = x.{col}")
    return "\nUNION ALL\n".join(parts)


@register("rekey", "W5", with_adapter(_rekey_sql()))
def _rekey(g, spark, sf):
    # Artist accounts move to a new id range; every reference follows.
    mapping = g.users.filter(F.col("role") == "Artist").select(
        F.col("user_id").alias("old_id"), (F.col("user_id") + 10_000_000).alias("new_id"))
    _, log = W.rekey(g, user_map=mapping)
    return log


@register("assign_ids", "W6", with_adapter("""
SELECT o_orderkey AS source_id,
       (SELECT max(exhibition_id) FROM exhibition) + row_number() OVER (ORDER BY o_orderdate, o_orderkey)
         AS exhibition_id
FROM orders"""))
def _assign_ids(g, spark, sf):
    new = adapter.read_driver(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), "o_orderdate")
    return W.assign_ids(new, ["o_orderdate", "source_id"], W.max_id(g.exhibition, "exhibition_id"),
                        "exhibition_id").select("source_id", "exhibition_id")


@register("column_defaults", "W7", with_adapter(f"""
SELECT artifact_id, artist_id, CAST(NULL AS INTEGER) AS museum_id, title, CAST(NULL AS VARCHAR) AS description,
       'Other' AS type, CAST(NULL AS VARCHAR) AS quality, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS DECIMAL(12,2)) AS price, 0 AS quantity, image,
       TIMESTAMP '{NOW}' AS created_at
FROM artifact"""))
def _column_defaults(g, spark, sf):
    # Catalogue rows re-ingested with only id, artist, title and image.
    raw = g.artifact.select("artifact_id", "artist_id", "title", "image")
    return W.column_defaults(raw, "artifact", now=F.to_timestamp_ntz(F.lit(NOW)))


@register("display_columns", "P1", with_adapter(f"""
SELECT a.artifact_id, a.title, printf('%.2f', CAST(a.price AS DOUBLE)) AS price,
       CASE WHEN length(COALESCE(a.description, '')) <= 105 THEN COALESCE(a.description, '')
            ELSE substr(a.description, 1, 99) || '…' END AS description,
       COALESCE(NULLIF(a.image, ''), 'placeholder.png') AS image,
       COALESCE(NULLIF({name('u')}, ''), '-') AS artist_name,
       COALESCE(NULLIF(m.name, ''), '-') AS museum_name
FROM artifact a LEFT JOIN users u ON a.artist_id = u.user_id LEFT JOIN museum m ON a.museum_id = m.museum_id"""))
def _display_columns(g, spark, sf):
    from vitrine.functions.columns import full_name

    base = (g.artifact.join(g.users.select(F.col("user_id").alias("artist_id"), full_name().alias("artist_name")),
                            "artist_id", "left")
            .join(g.museum.select("museum_id", F.col("name").alias("museum_name")), "museum_id", "left")
            .select("artifact_id", "title", "price", "description", "image", "artist_name", "museum_name"))
    return P.display_columns(base, money=["price"], short=["description"],
                             fills={"image": P.PLACEHOLDER_IMAGE, "artist_name": "-", "museum_name": "-"})


# ---------------------------------------------------------------- stored galleries

from vitrine.operators import deltas as D  # noqa: E402
from vitrine.operators import search as T  # noqa: E402
from vitrine.sources import snapshots as N  # noqa: E402


def _stored(g, spark, label, tables, read, **layout):
    """What ``read`` gives from a stored copy of ``tables``; the copy's folder goes."""
    store = N.create(g, f"{checkpoint_dir(spark).rstrip('/')}/stores/{label}-{uuid.uuid4().hex}", tables, **layout)
    df = read(store).checkpoint()
    store.remove()
    return df


@register("commit_delete_artifacts", "W3", with_adapter("""
SELECT artifact_id, title, CASE WHEN sold THEN least(quantity, 0) ELSE quantity END AS quantity,
       (SELECT count(*) FROM virtual_record v WHERE v.artifact_id = k.artifact_id) AS records,
       (SELECT count(*) FROM exhibition_artifact x WHERE x.artifact_id = k.artifact_id) AS links
FROM (SELECT artifact_id, title, quantity, artifact_id IN (SELECT artifact_id FROM purchase) AND quantity = 0 AS sold FROM artifact) k
WHERE quantity <> 0 OR quantity IS NULL OR sold"""))
def _commit_delete_artifacts(g, spark, sf):
    # The catalogue's sold-out artifacts go, written folder by folder; what the new version holds.
    def read(store):
        whole = store.gallery().with_tables(purchase=g.purchase)
        _, report = W.delete_artifacts(whole, whole.artifact.filter(F.col("quantity") == 0).select("artifact_id"))
        after = store.commit(D.delete_delta(whole, report))

        def per(table, alias):
            return after.table(table).groupBy("artifact_id").agg(F.count(F.lit(1)).alias(alias))

        return (after.table("artifact").select("artifact_id", "title", "quantity")
                .join(per("virtual_record", "records"), "artifact_id", "left")
                .join(per("exhibition_artifact", "links"), "artifact_id", "left").fillna(0, ["records", "links"]))

    return _stored(g, spark, "delete", ["artifact", "virtual_record", "exhibition_artifact"], read)


STORED_COLS = "artifact_id, artist_id, museum_id, title, description, type, price, quantity, image"


@register("commit_append_artifacts", "W1", with_adapter(f"""
SELECT {STORED_COLS} FROM artifact
UNION ALL SELECT {STORED_COLS} FROM ({REGISTRY["append_artifacts"].sql}) uploads WHERE reason IS NULL"""))
def _commit_append_artifacts(g, spark, sf):
    # The uploads of append_artifacts, committed; what the new version holds.
    def read(store):
        whole = g.with_tables(artifact=store.table("artifact"))
        rows, _ = W.append_artifacts(whole, _upload_forms(whole), ["source_id"], now=F.to_timestamp_ntz(F.lit(NOW)))
        return store.commit(D.append_delta(whole, "artifact", rows)).table("artifact").select(*STORED_COLS.split(", "))

    return _stored(g, spark, "append", ["artifact"], read)


def _indexed(g, spark, label, text, query):
    """``query`` over the artifacts that a stored title index finds."""
    return _stored(g, spark, label, ["artifact"], lambda store: query(g.with_tables(artifact=T.find_titles(store, text))),
                   index_titles=True)


@register("artist_artifacts_indexed", "Q2", REGISTRY["artist_artifacts"].sql)
def _artist_artifacts_indexed(g, spark, sf):
    artists = g.users.filter(F.col("role") == "Artist").select(F.col("user_id").alias("artist_id"))
    return _indexed(g, spark, "artist", "  RING ", lambda found: Q.artist_artifacts(found, artists))


@register("in_stock_artifacts_indexed", "Q3", REGISTRY["in_stock_artifacts"].sql)
def _in_stock_artifacts_indexed(g, spark, sf):
    return _indexed(g, spark, "stock", "Ring", lambda found: Q.in_stock_artifacts(found, type_="small"))


@register("faceted_search_indexed", "Q8", REGISTRY["faceted_search"].sql)
def _faceted_search_indexed(g, spark, sf):
    return _indexed(g, spark, "search", "blue", lambda found: Q.faceted_search(found, min_price=920, max_price=980))


@register("artifacts_by_ids_stored", "Q9", REGISTRY["artifacts_by_ids"].sql)
def _artifacts_by_ids_stored(g, spark, sf):
    return _stored(g, spark, "lookup", ["artifact"], lambda store: store.lookup(
        "artifact", g.exhibition_artifact.select("artifact_id")).select("artifact_id", "title", "price", "image"))


# ---------------------------------------------------------------- streaming

from vitrine.streaming import admission_stream as ST  # noqa: E402


def _kept(played: ST.Played, df):
    """``df`` without the folders of the stream."""
    df = df.checkpoint()
    played.remove()
    return df


def _play_purchases(g, spark, sf):
    """The line items, in whatever files they lie, as one stream judged by ship date."""
    return ST.play(
        adapter.purchase_requests(spark, sf), "l_shipdate", "admit_purchases",
        lambda requests, delay: ST.admit_purchases_stream(requests, adapter.restocked(g.artifact), adapter.PURCHASE_REQUEST_ORDER,
                                                          users=g.users, time_col="l_shipdate", delay=delay))


def _play_attends(g, spark, sf):
    return ST.play(
        adapter.attend_requests(spark, sf), "ts", "admit_attends",
        lambda requests, delay: ST.admit_attends_stream(requests, g.attends, g.exhibition, adapter.ATTEND_REQUEST_ORDER,
                                                        users=g.users, time_col="ts", delay=delay))


@register("stream_admit_purchases", "A4", REGISTRY["admit_purchases"].sql)
def _stream_admit_purchases(g, spark, sf):
    played = _play_purchases(g, spark, sf)
    return _kept(played, played.out)


@register("stream_stock_left", "A4 state", with_adapter("SELECT artifact_id, quantity FROM day_artifact", DAY_STOCK_CTES, recursive=True))
def _stream_stock_left(g, spark, sf):
    played = _play_purchases(g, spark, sf)
    return _kept(played, ST.stock_left(played, adapter.restocked(g.artifact)).select("artifact_id", "quantity"))


@register("stream_admit_attends", "A5", REGISTRY["admit_attends"].sql)
def _stream_admit_attends(g, spark, sf):
    played = _play_attends(g, spark, sf)
    return _kept(played, played.out)


@register("stream_seats_taken", "A5 state", with_adapter(f"""
SELECT e.exhibition_id, e.capacity, CAST(ifnull(x.n, 0) + ifnull(y.n, 0) AS BIGINT) AS seats_taken
FROM exhibition e
LEFT JOIN (SELECT exhibition_id, count(*) AS n FROM attends GROUP BY 1) x ON x.exhibition_id = e.exhibition_id
LEFT JOIN (SELECT exhibition_id, count(*) AS n FROM ({REGISTRY["admit_attends"].sql}) WHERE accepted GROUP BY 1) y
       ON y.exhibition_id = e.exhibition_id"""))
def _stream_seats_taken(g, spark, sf):
    played = _play_attends(g, spark, sf)
    return _kept(played, ST.seats_taken(played, g.attends, g.exhibition))


from vitrine.streaming import cart_stream as KS  # noqa: E402


@register("stream_cart_state", "K1s", REGISTRY["cart_state"].sql)
def _stream_cart_state(g, spark, sf):
    events = adapter.cart_events(spark, sf)
    played = ST.play(events, "ts", "cart_state",
                     lambda ev, delay: KS.cart_state_stream(ev, adapter.CART_EVENT_ORDER, time_col="ts", delay=delay))
    return _kept(played, KS.current_carts(played.out, adapter.CART_EVENT_ORDER, dict(events.dtypes)["artifact_id"]))
