"""Cart and checkout as bulk data jobs (K1-K4).

K1 folds a cart event log into cart contents without a sequential pass: a
cart line's quantity is fixed by its last *reset* (a ``set`` of that line or
a ``checkout`` of the user's whole cart) plus the ``add`` events after it.
Resets are found with aggregates (map-side combined, skew-tolerant) and the
adds are summed after a join, so no group is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.columns import try_int
from vitrine.functions.grouping import connected
from vitrine.operators.admission import CUSTOMER_NOT_FOUND, stock_after

# Problem codes; the message texts below follow the source application's checkout messages.
MISSING = "missing"
SHORT = "insufficient_stock"
UNKNOWN_USER = "unknown_customer"


def cart_state(events: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """K1: current cart lines (user_id, artifact_id, qty > 0) from events
    (user_id, artifact_id, kind in add/set/checkout, qty text, order columns).

    add: quantity at least 1, accumulates; set: overwrites, <= 0 removes;
    checkout: empties the user's cart; a quantity that is not a 32-bit integer
    in plain digits makes the add or set a no-op.  Quantities are long, so adds
    cannot overflow a cart."""
    ev = events.select("user_id", "artifact_id", "kind", try_int("qty").alias("_q"),
                       F.struct(*order_cols).alias("_ord"))
    checkouts = (ev.filter(F.col("kind") == "checkout").groupBy("user_id")
                 .agg(F.max("_ord").alias("_checkout")))
    sets = (ev.filter((F.col("kind") == "set") & F.col("_q").isNotNull())
            .groupBy("user_id", "artifact_id")
            .agg(F.max(F.struct(F.col("_ord").alias("o"), F.col("_q").alias("q"))).alias("_set")))
    adds = ev.filter((F.col("kind") == "add") & F.col("_q").isNotNull())

    def after(o: Column, reset: Column) -> Column:
        return reset.isNull() | (o > reset)

    # Adds that follow both the line's last set and the user's last checkout.
    counted = (adds.join(sets, ["user_id", "artifact_id"], "left").join(checkouts, "user_id", "left")
               .filter(after(F.col("_ord"), F.col("_set.o")) & after(F.col("_ord"), F.col("_checkout")))
               .groupBy("user_id", "artifact_id")
               .agg(F.sum(F.greatest(F.lit(1), F.col("_q"))).alias("_added")))
    base = (sets.join(checkouts, "user_id", "left")
            .select("user_id", "artifact_id",
                    F.when(after(F.col("_set.o"), F.col("_checkout")), F.greatest(F.col("_set.q"), F.lit(0)))
                    .otherwise(F.lit(0)).alias("_base")))
    lines = base.join(counted, ["user_id", "artifact_id"], "full")
    qty = F.coalesce("_base", F.lit(0)) + F.coalesce("_added", F.lit(0))
    return lines.select("user_id", "artifact_id", qty.cast("bigint").alias("qty")).filter(F.col("qty") > 0)


def price_cart(cart: DataFrame, artifact: DataFrame) -> DataFrame:
    """K2: priced cart lines; unknown artifacts are dropped; ``cart_total`` per user."""
    lines = (cart.join(artifact.select("artifact_id", "title", "price", "image"), "artifact_id", "inner")
             .withColumn("subtotal", (F.col("price") * F.col("qty").cast("bigint")).cast("decimal(33,2)")))
    # Cart totals as an aggregate joined back (map-side combined), not a window:
    # a user with a huge cart never lands whole in one task.
    totals = lines.groupBy("user_id").agg(F.sum("subtotal").cast("decimal(38,2)").alias("cart_total"))
    return (lines.join(totals, "user_id", "inner")
            .select("user_id", "artifact_id", "title", "price", "image", "qty", "subtotal", "cart_total"))


def validate_checkout(cart: DataFrame, artifact: DataFrame) -> DataFrame:
    """K3: one row per bad line (missing artifact, or more than the stock);
    lines with qty <= 0 are ignored.  A NULL stock counts as 0."""
    lines = cart.filter(F.col("qty") > 0)
    stock = artifact.select("artifact_id", "title", F.coalesce("quantity", F.lit(0)).alias("stock"),
                            F.lit(True).alias("_found"))
    j = lines.join(stock, "artifact_id", "left")
    problem = F.when(F.col("_found").isNull(), F.lit(MISSING)).when(F.col("qty") > F.col("stock"), F.lit(SHORT))
    return (j.withColumn("problem", problem).filter(F.col("problem").isNotNull())
            .select("user_id", "artifact_id", "qty", F.col("stock").cast("int").alias("stock"), "problem",
                    _message().alias("message")))


def _message() -> Column:
    """What the customer reads, from problem, artifact_id, title, stock and qty."""
    return (F.when(F.col("problem") == MISSING, F.format_string("Artifact ID %d no longer exists.", F.col("artifact_id")))
            .otherwise(F.format_string("“%s” has only %d left (you requested %d).", F.col("title"), F.col("stock"), F.col("qty"))))


def checkout_status(cart: DataFrame, artifact: DataFrame) -> DataFrame:
    """Per cart: number of lines, number of problems, ok (no problem at all)."""
    lines = cart.filter(F.col("qty") > 0).groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"))
    problems = validate_checkout(cart, artifact).groupBy("user_id").agg(F.count(F.lit(1)).alias("problems"))
    return (lines.join(problems, "user_id", "left")
            .select("user_id", "lines", F.coalesce("problems", F.lit(0)).alias("problems"))
            .withColumn("ok", F.col("problems") == 0))


def _node(kind: str, *columns: str) -> Column:
    """A link's end as a long.  Should two ends share one, their groups are folded
    together, which changes no result."""
    return F.xxhash64(F.lit(kind), *columns)


def _settle(n_cart: int):
    """Carts one after the other: rows (group, artifact, quantity, stock, then the
    ``n_cart`` columns that name a cart), a group's rows in cart order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cart, named, lines, left = None, None, [], [], {}
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or batch.schema
            done, verdicts = [], []

            def close() -> None:
                if cart is not None:
                    ok = all(q <= left[a] for a, q in lines)
                    if ok:
                        for a, q in lines:
                            left[a] -= q
                    done.append(named)
                    verdicts.append(ok)

            carts = list(zip(*(batch.column(4 + i).to_pylist() for i in range(n_cart))))
            for i, (g, a, q, stock) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                if g != group or carts[i] != cart:
                    close()
                    if g != group:
                        group, left = g, {}
                    cart, lines, named = carts[i], [], carts[i]
                left.setdefault(a, stock or 0)
                lines.append((a, q))
            if done:
                yield _verdicts(schema, n_cart, done, verdicts)
        if cart is not None:
            yield _verdicts(schema, n_cart, [named], [all(q <= left[a] for a, q in lines)])

    return run


def _verdicts(schema: pa.Schema, n_cart: int, carts: list[tuple], accepted: list[bool]) -> pa.RecordBatch:
    fields = [schema.field(4 + i) for i in range(n_cart)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*carts), fields)), pa.array(accepted, pa.bool_())],
                                      [*(f.name for f in fields), "accepted"])


def settle_carts(lines: DataFrame, cart: Sequence[str] = ("user_id",)) -> DataFrame:
    """Which carts pass when they are checked out one after the other, each as a
    whole: (cart columns, accepted) from lines (cart columns, artifact_id, qty,
    stock), one line per cart and artifact.

    A cart passes if the carts accepted before it leave enough for each of its
    lines.  An artifact of which all carts together want no more than its stock
    decides nothing, and a cart of only such lines passes.  The other carts are
    grouped by the contended artifacts that they share, however indirectly; a
    group goes through the rule once, in order, and groups side by side.  The
    number of jobs does not grow with the carts, but for a logarithm in joining
    up more than 200,000 links.  A group's rows stream through one task, which
    keeps the stock of its contended artifacts."""
    cart = list(cart)
    contended = lines.groupBy("artifact_id").agg(F.sum("qty").alias("_asked"), F.max(F.coalesce("stock", F.lit(0))).alias("_stock")).filter(
        F.col("_asked") > F.col("_stock")).select("artifact_id")
    tight = lines.select(*cart, "artifact_id", F.col("qty").cast("bigint").alias("qty"), F.col("stock").cast("bigint").alias("stock")).join(
        contended, "artifact_id", "left_semi").withColumn("_cart", _node("cart", *cart)).checkpoint()
    places = connected(tight.select(F.col("_cart").alias("u"), _node("artifact", "artifact_id").alias("v")))
    grouped = tight.join(places.select(F.col("id").alias("_cart"), "place"), "_cart")
    kinds = dict(lines.dtypes)
    order = [f"_c{i}" for i in range(len(cart))]
    settled = (grouped.select("place", "artifact_id", "qty", "stock", *[F.col(c).alias(o) for c, o in zip(cart, order)])
               .repartition("place").sortWithinPartitions("place", *order)
               .mapInArrow(_settle(len(cart)), ", ".join(f"{o} {kinds[c]}" for c, o in zip(cart, order)) + ", accepted boolean"))
    same = F.lit(True)
    carts = lines.select(*cart).distinct()
    for c, o in zip(cart, order):
        same = same & carts[c].eqNullSafe(F.col(o))
    return carts.join(settled, same, "left").select(*[carts[c] for c in cart], F.coalesce("accepted", F.lit(True)).alias("accepted"))


def post_checkout(cart: DataFrame, artifact: DataFrame, order_cols: Sequence[str] = ("user_id",),
                  users: DataFrame | None = None, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """K4: check out every cart that passes K3, one after the other in the order of
    ``order_cols`` (which name a cart), each as a whole.

    A cart that an earlier one leaves short posts nothing and takes nothing; so
    does a cart of an unknown user.  Stock is decremented once.  Returns (posted
    purchase lines with amount ``round(price * qty, 2)`` and payment method Card,
    new artifact snapshot)."""
    key = list(dict.fromkeys([*order_cols, "user_id"]))
    ok = checkout_status(cart, artifact).filter(F.col("ok")).select("user_id")
    if users is not None:
        ok = ok.join(users.select("user_id").distinct(), "user_id", "left_semi")
    lines = (cart.filter(F.col("qty") > 0).join(ok, "user_id", "left_semi")
             .join(artifact.select("artifact_id", F.col("quantity").alias("stock")), "artifact_id"))
    passed = settle_carts(lines, key).filter("accepted").select(*key)
    taken = lines.join(passed, key, "left_semi").select(
        F.col("user_id").alias("customer_id"), "artifact_id", F.col("qty").cast("int").alias("quantity")).checkpoint()
    posted = taken.join(artifact.select("artifact_id", "price"), "artifact_id").select(
        "customer_id", "artifact_id",
        (at if at is not None else F.localtimestamp().cast("timestamp_ntz")).alias("purchase_ts"),
        "quantity",
        F.round(F.col("price") * F.col("quantity"), 2).cast("decimal(12,2)").alias("total_amount"),
        F.lit("Card").alias("payment_method"))
    return posted, stock_after(taken.withColumn("accepted", F.lit(True)), artifact)


# -------------------------------------------------------- checkouts in a log

SALE, PROBLEM, LINE = "sale", "problem", "line"


class Checkouts(NamedTuple):
    """What a log of cart events comes to."""

    purchases: DataFrame    # order columns of the checkout, customer_id, artifact_id, quantity, total_amount, payment_method
    refusals: DataFrame     # order columns of the checkout, user_id, artifact_id, qty, stock, problem, message
    carts: DataFrame        # user_id, artifact_id, qty left in the carts
    artifact: DataFrame     # the new snapshot


def _play(n_order: int):
    """The log of a group in order: rows (group, user, artifact, kind, quantity, stock,
    found, known user, then the order columns).  Gives (what, user, artifact, qty,
    stock, problem, order columns): sales, problems and the lines left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carts, left, schema = None, {}, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or batch.schema
            out, at = [], []
            open_lines = []
            columns = (batch.column(i).to_pylist() for i in range(8))
            for i, (g, user, art, kind, q, stock, found, known) in enumerate(zip(*columns)):
                if g != group:
                    open_lines += _lines(carts)
                    group, carts, left = g, {}, {}
                cart = carts.setdefault(user, {})
                if kind == "checkout":
                    bad = [(PROBLEM, user, a, n, left[a], MISSING if left[a] is None else SHORT)
                           for a, n in cart.items() if left[a] is None or n > left[a]]
                    if cart and not bad and not known:
                        bad = [(PROBLEM, user, None, None, None, UNKNOWN_USER)]
                    if not bad:
                        for a, n in cart.items():
                            left[a] -= n
                            out.append((SALE, user, a, n, None, None))
                        carts[user] = {}
                    out += bad
                    at += [i] * (len(out) - len(at))
                    continue
                if art not in left:
                    left[art] = (stock or 0) if found else None
                if kind == "add":
                    cart[art] = cart.get(art, 0) + max(1, q)
                elif q > 0:
                    cart[art] = q
                else:
                    cart.pop(art, None)
            if out:
                order = batch.select(batch.schema.names[8:]).take(pa.array(at, pa.int64()))
                yield _played(schema, n_order, out, order.columns)
            if open_lines:
                yield _played(schema, n_order, open_lines, None)
        if open_lines := _lines(carts):
            yield _played(schema, n_order, open_lines, None)

    return run


def _lines(carts: dict) -> list[tuple]:
    return [(LINE, user, a, n, None, None) for user, cart in carts.items() for a, n in cart.items()]


def _played(schema: pa.Schema, n_order: int, rows: list[tuple], order: list[pa.Array] | None) -> pa.RecordBatch:
    what, user, art, qty, stock, problem = zip(*rows)
    fields = [schema.field(8 + i) for i in range(n_order)]
    order = order or [pa.nulls(len(rows), f.type) for f in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(what, pa.string()), pa.array(user, schema.field(1).type), pa.array(art, schema.field(2).type), pa.array(qty, pa.int64()),
         pa.array(stock, pa.int64()), pa.array(problem, pa.string()), *order],
        ["what", "user_id", "artifact_id", "qty", "stock", "problem", *(f.name for f in fields)])


def play_checkouts(events: DataFrame, artifact: DataFrame, order_cols: Sequence[str], users: DataFrame | None = None) -> Checkouts:
    """K1, K3 and K4 together: a log of cart events (user_id, artifact_id, kind in
    add/set/checkout, qty text, order columns) in which a checkout is validated
    against the stock that all earlier ones left.

    A checkout of an empty cart does nothing.  One with a bad line (missing
    artifact, or more than the stock) posts nothing and keeps its cart, and so does
    one of a user that is not among ``users``; any other posts every line, takes
    the stock once and empties the cart.  Adds and sets are those of K1.

    What a user asks for in the whole log bounds what they can buy; an artifact
    of which that is no more than the stock refuses nobody.  Users are grouped by
    the contended artifacts that they share, however indirectly, and a group's
    events go through the rule once, in order, in one task that keeps its carts
    and stocks; groups go side by side.  Users who never check out are left to
    :func:`cart_state`."""
    order = list(order_cols)
    names = [f"_o{i}" for i in range(len(order))]
    ev = events.select("user_id", "artifact_id", "kind", try_int("qty").alias("q"), "qty", *order)
    buyers = ev.filter("kind = 'checkout'").select("user_id").distinct()
    ops = ev.filter("kind = 'checkout' OR kind IN ('add', 'set') AND q IS NOT NULL").drop("qty").join(buyers, "user_id", "left_semi")
    stock = artifact.select("artifact_id", F.coalesce("quantity", F.lit(0)).cast("bigint").alias("stock"), F.lit(True).alias("found"))
    asked = (ops.filter("kind <> 'checkout'").groupBy("artifact_id", "user_id").agg(
        F.sum(F.when(F.col("kind") == "add", F.greatest(F.lit(1), "q")).otherwise(F.greatest(F.lit(0), "q")).cast("bigint")).alias("n")).checkpoint())
    contended = asked.groupBy("artifact_id").agg(F.sum("n").alias("n")).join(stock, "artifact_id").filter("n > stock").select("artifact_id")
    places = connected(asked.join(contended, "artifact_id", "left_semi").select(
        _node("user", "user_id").alias("u"), _node("artifact", "artifact_id").alias("v")))
    rows = (ops.withColumn("_user", _node("user", "user_id")).join(places.select(F.col("id").alias("_user"), "place"), "_user", "left")
            .join(stock, "artifact_id", "left"))
    known = F.lit(True)
    if users is not None:
        rows = rows.join(users.select("user_id", F.lit(True).alias("known")).distinct(), "user_id", "left")
        known = F.coalesce("known", F.lit(False))
    kinds = dict(ev.dtypes)
    played = (rows.select(F.coalesce("place", "_user").alias("place"), "user_id", "artifact_id", "kind", F.col("q").cast("bigint").alias("q"), "stock",
                          F.coalesce("found", F.lit(False)).alias("found"), known.alias("known"), *[F.col(c).alias(n) for c, n in zip(order, names)])
              .repartition("place").sortWithinPartitions("place", *names)
              .mapInArrow(_play(len(order)), f"what string, user_id {kinds['user_id']}, artifact_id {kinds['artifact_id']}, qty bigint, "
                          "stock bigint, problem string, " + ", ".join(f"{n} {kinds[c]}" for c, n in zip(order, names))).checkpoint())
    back = [F.col(n).alias(c) for c, n in zip(order, names)]
    sales = played.filter(F.col("what") == SALE)
    purchases = sales.join(artifact.select("artifact_id", "price"), "artifact_id").select(
        *back, F.col("user_id").alias("customer_id"), "artifact_id", F.col("qty").cast("int").alias("quantity"),
        F.round(F.col("price") * F.col("qty"), 2).cast("decimal(12,2)").alias("total_amount"), F.lit("Card").alias("payment_method"))
    refusals = (played.filter(F.col("what") == PROBLEM).join(artifact.select("artifact_id", "title"), "artifact_id", "left")
                .select(*back, "user_id", "artifact_id", "qty", F.col("stock").cast("int").alias("stock"), "problem",
                        F.when(F.col("problem") == UNKNOWN_USER, F.lit(CUSTOMER_NOT_FOUND)).otherwise(_message()).alias("message")))
    lines = played.filter(F.col("what") == LINE).select("user_id", "artifact_id", "qty")
    others = cart_state(ev.join(buyers, "user_id", "left_anti"), order)
    after = stock_after(sales.select("artifact_id", F.col("qty").alias("quantity"), F.lit(True).alias("accepted")), artifact)
    return Checkouts(purchases, refusals, lines.unionByName(others), after)
