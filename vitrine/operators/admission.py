"""Order-dependent admission (A1-A3): the source application's insert triggers
re-expressed as bulk jobs over a table of requests.

A1 (purchases against stock) is greedy: a refused request uses no stock, so a
later, smaller request may still pass.  One plan serves artifacts of any size:

1. Requests decidable from their own row (unknown artifact, bad quantity, more
   than the whole initial stock - stock only falls) are told apart.  All are
   range-partitioned and sorted once by artifact and order; what follows
   happens in those partitions.  An artifact that lies in one partition goes
   through the rule in order, and so do those that span a partition border, at
   most one per border, if they have a million requests in all at most.  Steps
   2-4 are for such artifacts of any size.
2. Until an artifact's first refusal every request of a known customer is
   accepted, so that stretch is a running sum, taken in place.
3. The first refusal leaves a stock below the refused quantity.  Stock only
   falls, so once a quantity is refused it is refused for good: the accepted
   requests of each quantity q are the first ones, at most stock / q.  Only
   those, about s log s a partition for a left stock s however many requests
   there are, move to go through the sequential rule.
4. What the few accepted ones use, as a running sum again, gives every other
   request the stock it saw and its reason.

A2 (attendances against capacity) needs no fold, because every accepted
request takes exactly one seat: the request that fills the last seat is the
``seats``-th first-time (customer, exhibition) pair in arrival order, found
with a running count over chunks.  Each request then compares its own position
with that cut-off.

A3 (exhibition organiser) is a lookup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.running import CHUNK, in_chunks, running_sum

# Refusal messages that must equal the source application's (its
# trigger messages), plus our own codes for the rules it enforces by constraints.
NOT_FOUND = "Artifact not found"
INSUFFICIENT = "Insufficient stock"
NULL_QUANTITY = "null_quantity"
NOT_POSITIVE = "quantity_not_positive"
CUSTOMER_NOT_FOUND = "Customer not found"
EXHIBITION_NOT_FOUND = "Exhibition not found"
CAPACITY_FULL = "Exhibition capacity full"
DUPLICATE = "duplicate"
ARTIST_NOT_FOUND = "Artist_ID not found"
NOT_AN_ARTIST = "Only artists can organize exhibitions"


# Accepted requests of artifacts that span partitions which are broadcast; more are joined.
MAX_ACCEPTED = 1_000_000
# Requests of all such artifacts together that are few enough to go through the rule artifact by artifact.
FEW_ACROSS = 1_000_000


# ------------------------------------------------------------------------- A1

# A function run by mapInPandas: pandas batches in, pandas batches out.
BatchFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _greedy(key: str, qty: str) -> BatchFn:
    """Ids of the accepted rows among rows sorted by (key, arrival order), from
    the stock ``_left``; the stock is carried across Arrow batches."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for pdf in batches:
            accepted = []
            for k, want, start, rid in zip(pdf[key].tolist(), pdf[qty].tolist(), pdf["_left"].tolist(), pdf["_rid"].tolist()):
                if k != current:
                    current, left = k, start
                if want <= left:
                    left -= want
                    accepted.append(rid)
            yield pd.DataFrame({"_rid": accepted}, dtype="int64")

    return fold


def _decide(n_out: int):
    """The rule in order, over whole artifacts: columns key, quantity, stock, known
    customer, then the ``n_out`` to give back with the stock seen and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0
        for batch in batches:
            before, taken = [], []
            for k, want, start, known in zip(*(batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(4))):
                if k != current:
                    current, left = k, start
                before.append(left)
                ok = known and want <= left
                taken.append(ok)
                if ok:
                    left -= want
            yield pa.RecordBatch.from_arrays([*batch.columns[4:4 + n_out], pa.array(before, pa.int64()), pa.array(taken, pa.bool_())],
                                             [*batch.schema.names[4:4 + n_out], "_before", "_in"])

    return run


def _first_of_each(key: str, qty: str) -> BatchFn:
    """Of each artifact and quantity the first _left / quantity rows of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen = None, {}
        for pdf in batches:
            keep = []
            for k, want, left in zip(pdf[key].tolist(), pdf[qty].tolist(), pdf["_left"].tolist()):
                if k != current:
                    current, seen = k, {}
                n = seen.get(want, 0)
                keep.append(n < left // want)
                seen[want] = n + 1
            yield pdf[keep]

    return run


def _fold(rows: DataFrame, key: str, qty: str, out: Sequence[str]) -> DataFrame:
    """The verdicts on requests with 0 < quantity <= initial stock ``_stock0``, in chunks."""
    ends = rows.groupBy(CHUNK).agg(F.array(F.min_by(key, "_rid"), F.max_by(key, "_rid")).alias("ends"))
    wide = (ends.select(F.explode(F.array_distinct("ends")).alias(key)).groupBy(key).count().filter("count > 1")
            .select(key, F.lit(True).alias("_wide")).checkpoint())
    # At most one row per partition border.
    rows = rows.join(F.broadcast(wide), key, "left")
    kinds = dict(rows.dtypes)
    named = [F.col(c).alias(f"_out{i}") for i, c in enumerate(out)]

    def whole(some: DataFrame) -> DataFrame:
        decided = some.select(key, qty, "_stock0", "_customer_ok", *named).mapInArrow(
            _decide(len(named)), ", ".join(f"_out{i} {kinds[c]}" for i, c in enumerate(out)) + ", _before bigint, _in boolean")
        return decided.select(*[F.col(f"_out{i}").alias(c) for i, c in enumerate(out)], "_before", "_in")

    inside = whole(rows.filter("_wide IS NULL"))
    # These are read apart, still in order.
    across = rows.filter("_wide").drop("_wide").checkpoint()
    n = across.count()
    if n > FEW_ACROSS:
        inside = inside.unionByName(_fold_wide(across, key, qty).select(*out, "_before", "_in"))
    elif n:
        inside = inside.unionByName(whole(across.repartition(key).sortWithinPartitions(key, "_rid")))
    return inside.select(*out, F.col("_before").cast("int").alias("stock_before"), F.col("_in").alias("accepted"),
                       F.when(~F.col("_in"), F.when(F.col(qty) > F.col("_before"), F.lit(INSUFFICIENT))
                              .otherwise(F.lit(CUSTOMER_NOT_FOUND))).alias("reason"))


def _fold_wide(rows: DataFrame, key: str, qty: str) -> DataFrame:
    """The artifacts that span partitions, one per border at most."""
    q = F.col(qty).cast("bigint")
    wanted = F.when(F.col("_customer_ok"), q).otherwise(F.lit(0))
    rows = running_sum(rows, [key], ["_rid"], wanted, "_upto").withColumn("_wanted", wanted)
    fits = F.col("_upto") <= F.col("_stock0")
    # The stock that the first refusal leaves.
    left = rows.groupBy(key).agg((F.first("_stock0") - F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)))
                                 .cast("bigint").alias("_left")).checkpoint()
    rest = rows.filter(~fits).drop("_upto").join(F.broadcast(left), key)
    # A partition gives its first _left / quantity known requests of each quantity: all that can pass are among them.
    able = rest.filter(F.col("_customer_ok") & (q <= F.col("_left"))).select(key, q.alias(qty), "_left", "_rid")
    few = able.mapInPandas(_first_of_each(key, qty), able.schema)
    accepted = (few.repartition(key).sortWithinPartitions(key, "_rid").mapInPandas(_greedy(key, qty), "_rid bigint")
                .withColumn("_in", F.lit(True)).checkpoint())
    if accepted.count() <= MAX_ACCEPTED:
        rest = rest.join(F.broadcast(accepted), "_rid", "left")
    else:
        rest = in_chunks(rest.drop(CHUNK).withColumnRenamed("_rid", "_at_first").join(
            accepted.withColumnRenamed("_rid", "_at_first"), "_at_first", "left"), [key], ["_at_first"])
    used = F.when(F.col("_in"), q).otherwise(F.lit(0))
    rest = running_sum(rest, [key], ["_rid"], used, "_used").withColumn("_before", F.col("_left") - (F.col("_used") - used))
    first = rows.filter(fits).withColumn("_before", F.col("_stock0") - (F.col("_upto") - F.col("_wanted"))).withColumn(
        "_in", F.col("_customer_ok"))
    columns = [c for c in first.columns if c in rest.columns]
    return first.select(*columns).unionByName(rest.select(*columns)).withColumn("_in", F.coalesce("_in", F.lit(False)))


def admit_purchases(requests: DataFrame, stock: DataFrame, order_cols: Sequence[str],
                    users: DataFrame | None = None, key: str = "artifact_id",
                    qty: str = "quantity", customer: str = "customer_id") -> DataFrame:
    """A1: admit purchase requests against stock in arrival order, per artifact.

    ``stock`` has (artifact_id, quantity).  Adds ``stock_before`` (stock seen by
    a request that got as far as the stock; NULL for requests decided on their
    own row), ``accepted`` and ``reason`` (NULL when accepted)."""
    cols = requests.columns
    s = stock.select(F.col("artifact_id").alias(key), F.col("quantity").alias("_stock0"),
                     F.lit(True).alias("_found"))
    r = requests.join(s, key, "left")
    if users is not None and customer in cols:
        known = users.select(F.col("user_id").alias(customer), F.lit(True).alias("_customer_ok")).distinct()
        r = r.join(known, customer, "left")
        r = r.withColumn("_customer_ok", F.coalesce("_customer_ok", F.lit(False)))
    else:
        r = r.withColumn("_customer_ok", F.lit(True))

    q, s0 = F.col(qty), F.col("_stock0")
    own_reason = (F.when(F.col("_found").isNull() | s0.isNull(), F.lit(NOT_FOUND))
                  .when(q.isNull(), F.lit(NULL_QUANTITY))
                  .when(q <= 0, F.lit(NOT_POSITIVE))
                  .when(q > s0, F.lit(INSUFFICIENT)))
    rows = in_chunks(r.withColumn("_own", own_reason).drop("_found"), [key], list(order_cols))
    decided = rows.filter(F.col("_own").isNotNull()).select(
        *cols, F.lit(None).cast("int").alias("stock_before"), F.lit(False).alias("accepted"),
        F.col("_own").alias("reason"))
    return decided.unionByName(_fold(rows.filter(F.col("_own").isNull()).drop("_own"), key, qty, cols))


def stock_after(admitted: DataFrame, stock: DataFrame, key: str = "artifact_id",
                qty: str = "quantity") -> DataFrame:
    """New stock snapshot: initial stock minus accepted quantities."""
    taken = (admitted.filter(F.col("accepted")).groupBy(key)
             .agg(F.sum(qty).alias("_taken")).withColumnRenamed(key, "artifact_id"))
    return (stock.join(taken, "artifact_id", "left")
            .withColumn("quantity", (F.col("quantity") - F.coalesce("_taken", F.lit(0))).cast("int"))
            .drop("_taken"))


# ------------------------------------------------------------------------- A2

def admit_attends(requests: DataFrame, attends: DataFrame, exhibition: DataFrame,
                  order_cols: Sequence[str], users: DataFrame | None = None) -> DataFrame:
    """A2: admit attendance requests (customer_id, exhibition_id, order columns)
    against capacity, given the existing attendances.

    Reasons in the order the source checks them: unknown exhibition or NULL
    capacity; full (existing attendees plus earlier admitted requests reach
    capacity); a customer that is NULL or, given ``users``, not among them; a
    repeated (customer, exhibition) pair; else accepted.  Only an accepted
    request takes a seat."""
    e, c = "exhibition_id", "customer_id"
    req = requests.withColumn("_ord", F.struct(*order_cols))
    if users is not None:
        known = users.select(F.col("user_id").alias(c), F.lit(True).alias("_customer_ok")).distinct()
        req = req.join(known, c, "left").withColumn("_customer_ok", F.coalesce("_customer_ok", F.lit(False)))
    else:
        req = req.withColumn("_customer_ok", F.col(c).isNotNull())

    existing_pairs = attends.select(e, c).distinct().withColumn("_already", F.lit(True))
    existing = attends.groupBy(e).agg(F.count(F.lit(1)).alias("_existing"))
    ex = (exhibition.select(e, "capacity").join(existing, e, "left")
          .withColumn("_seats", F.col("capacity") - F.coalesce("_existing", F.lit(0))))

    # First request of every pair (map-side combined), minus pairs already attending.
    first = req.filter("_customer_ok").groupBy(e, c).agg(F.min("_ord").alias("_first"))
    pair_info = first.join(existing_pairs, [e, c], "left")
    first_time = (pair_info.filter(F.col("_already").isNull())
                  .join(ex.filter(F.col("_seats") > 0).select(e, "_seats"), e, "inner"))
    # The first-time pair that takes the last seat: none if seats remain.
    taken = running_sum(in_chunks(first_time.select(e, "_first", "_seats"), [e], ["_first"]), [e], ["_first"], F.lit(1), "_nth")
    cutoff = taken.filter(F.col("_nth") == F.col("_seats")).select(e, F.col("_first").alias("_cutoff"))

    per_exhibition = ex.select(e, "capacity", "_seats", F.lit(True).alias("_found")).join(cutoff, e, "left")
    r = req.join(per_exhibition, e, "left").join(pair_info, [e, c], "left")
    reason = (F.when(F.col("_found").isNull() | F.col("capacity").isNull(), F.lit(EXHIBITION_NOT_FOUND))
              .when((F.col("_seats") <= 0) | (F.col("_cutoff").isNotNull() & (F.col("_ord") > F.col("_cutoff"))),
                    F.lit(CAPACITY_FULL))
              .when(~F.col("_customer_ok"), F.lit(CUSTOMER_NOT_FOUND))
              .when(F.col("_already").isNotNull() | (F.col("_ord") > F.col("_first")), F.lit(DUPLICATE)))
    return r.select(*requests.columns, reason.isNull().alias("accepted"), reason.alias("reason"))


def attends_after(admitted: DataFrame, attends: DataFrame, at=None) -> DataFrame:
    """New attends snapshot: existing rows plus accepted requests."""
    new = admitted.filter(F.col("accepted")).select(
        "customer_id", "exhibition_id",
        (at if at is not None else F.localtimestamp().cast("timestamp_ntz")).alias("attended_at"))
    return attends.unionByName(new)


# ------------------------------------------------------------------------- A3

def validate_exhibitions(requests: DataFrame, users: DataFrame) -> DataFrame:
    """A3: the organiser must be a known user with role Artist."""
    roles = users.select(F.col("user_id").alias("_uid"), F.col("role").alias("_role"))
    r = requests.join(roles, requests.artist_id == roles._uid, "left")
    reason = (F.when(F.col("_role").isNull(), F.lit(ARTIST_NOT_FOUND))
              .when(F.col("_role") != "Artist", F.lit(NOT_AN_ARTIST)))
    return r.select(*requests.columns, reason.isNull().alias("accepted"), reason.alias("reason"))
