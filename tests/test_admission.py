"""Order-dependent admission (A1-A3) against plain sequential loops."""

import random

from conftest import rows
from pyspark.sql import functions as F

from vitrine.operators import admission as A


def loop_purchases(reqs, stock, known=None):
    """Reference semantics, one request at a time.  reqs: (seq, artifact, qty, customer)."""
    left = dict(stock)
    out = {}
    for seq, art, q, cust in sorted(reqs):
        s0 = stock.get(art)
        if art not in stock or s0 is None:
            out[seq] = (None, False, A.NOT_FOUND)
        elif q is None:
            out[seq] = (None, False, A.NULL_QUANTITY)
        elif q <= 0:
            out[seq] = (None, False, A.NOT_POSITIVE)
        elif q > s0:
            out[seq] = (None, False, A.INSUFFICIENT)
        elif q > left[art]:
            out[seq] = (left[art], False, A.INSUFFICIENT)
        elif known is not None and cust not in known:
            out[seq] = (left[art], False, A.CUSTOMER_NOT_FOUND)
        else:
            out[seq] = (left[art], True, None)
            left[art] -= q
    return out, left


def test_fixture_sequence(spark):
    # Stock 5, requests 3, 4, 2, 1 in order: accept, refuse, accept, refuse.
    req = spark.createDataFrame([(i, 1, q, 3) for i, q in enumerate([3, 4, 2, 1])],
                                "seq long, artifact_id long, quantity int, customer_id long")
    stock = spark.createDataFrame([(1, 5)], "artifact_id long, quantity int")
    got = sorted(rows(A.admit_purchases(req, stock, ["seq"]), "seq", "accepted", "reason", "stock_before"))
    assert got == [(0, True, None, 5), (1, False, A.INSUFFICIENT, 2), (2, True, None, 2), (3, False, A.INSUFFICIENT, 0)]
    left = rows(A.stock_after(A.admit_purchases(req, stock, ["seq"]), stock))
    assert left == [(1, 0)]


def test_random_against_loop(spark):
    rnd = random.Random(7)
    stock = {a: rnd.choice([0, 1, 5, 20, 100, None]) for a in range(30)}
    # One hot artifact holding a third of the requests, plus unknown artifacts.
    reqs = []
    for seq in range(3000):
        art = 7 if rnd.random() < 0.33 else rnd.randrange(35)
        q = rnd.choice([None, -1, 0, 1, 1, 2, 3, 5, 8, 30])
        reqs.append((seq, art, q, rnd.randrange(12)))
    known = set(range(10))
    req_df = spark.createDataFrame(reqs, "seq long, artifact_id long, quantity int, customer_id long")
    stock_df = spark.createDataFrame(list(stock.items()), "artifact_id long, quantity int")
    users = spark.createDataFrame([(u,) for u in known], "user_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # state must cross batches
    try:
        got = A.admit_purchases(req_df, stock_df, ["seq"], users=users)
        got_rows = {r["seq"]: (r["stock_before"], r["accepted"], r["reason"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, left = loop_purchases(reqs, stock, known)
    assert got_rows == want
    after = dict(rows(A.stock_after(got, stock_df)))
    assert after == {a: (v if v is not None else None) for a, v in left.items()}


def loop_attends(reqs, existing, capacity, known=None):
    """reqs: (seq, customer, exhibition) -> reason (None when accepted)."""
    count = {}
    pairs = set(existing)
    for c, e in existing:
        count[e] = count.get(e, 0) + 1
    out = {}
    for seq, c, e in sorted(reqs):
        cap = capacity.get(e)
        if e not in capacity or cap is None:
            out[seq] = A.EXHIBITION_NOT_FOUND
        elif count.get(e, 0) >= cap:
            out[seq] = A.CAPACITY_FULL
        elif c is None or known is not None and c not in known:
            out[seq] = A.CUSTOMER_NOT_FOUND
        elif (c, e) in pairs:
            out[seq] = A.DUPLICATE
        else:
            out[seq] = None
            pairs.add((c, e))
            count[e] = count.get(e, 0) + 1
    return out


def test_attends_fixture(spark):
    # Capacity 2, one existing attendee, three new customers: accept, full, full.
    req = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (3, 12, 1)], "seq long, customer_id long, exhibition_id long")
    att = spark.createDataFrame([(9, 1, None)], "customer_id long, exhibition_id long, attended_at timestamp_ntz")
    ex = spark.createDataFrame([(1, 2)], "exhibition_id long, capacity int")
    got = sorted(rows(A.admit_attends(req, att, ex, ["seq"]), "seq", "reason"))
    assert got == [(1, None), (2, A.CAPACITY_FULL), (3, A.CAPACITY_FULL)]


def test_attends_random_against_loop(spark):
    rnd = random.Random(11)
    capacity = {e: rnd.choice([None, 0, 1, 3, 10, 50]) for e in range(12)}
    existing = list({(rnd.randrange(40), rnd.randrange(14)) for _ in range(30)})
    reqs = []
    for seq in range(2500):
        e = 4 if rnd.random() < 0.33 else rnd.randrange(14)  # one hot exhibition
        reqs.append((seq, None if rnd.random() < 0.1 else rnd.randrange(60), e))
    req_df = spark.createDataFrame(reqs, "seq long, customer_id long, exhibition_id long")
    att = spark.createDataFrame([(c, e, None) for c, e in existing],
                                "customer_id long, exhibition_id long, attended_at timestamp_ntz")
    ex = spark.createDataFrame(list(capacity.items()), "exhibition_id long, capacity int")
    got = {r["seq"]: r["reason"] for r in A.admit_attends(req_df, att, ex, ["seq"]).collect()}
    assert got == loop_attends(reqs, existing, capacity)
    known = set(range(45))
    users = spark.createDataFrame([(u,) for u in known], "user_id long")
    got = {r["seq"]: r["reason"] for r in A.admit_attends(req_df, att, ex, ["seq"], users=users).collect()}
    assert got == loop_attends(reqs, existing, capacity, known)


def test_unknown_customers_take_no_seat(spark):
    req = spark.createDataFrame([(1, None, 1), (2, 77, 1), (3, 11, 1), (4, None, 1), (5, 12, 1)],
                                "seq long, customer_id long, exhibition_id long")
    att = spark.createDataFrame([], "customer_id long, exhibition_id long, attended_at timestamp_ntz")
    ex = spark.createDataFrame([(1, 2)], "exhibition_id long, capacity int")
    users = spark.createDataFrame([(11,), (12,)], "user_id long")
    got = sorted(rows(A.admit_attends(req, att, ex, ["seq"], users=users), "seq", "reason"))
    assert got == [(1, A.CUSTOMER_NOT_FOUND), (2, A.CUSTOMER_NOT_FOUND), (3, None), (4, A.CUSTOMER_NOT_FOUND), (5, None)]


def test_validate_exhibitions(spark, tiny):
    req = spark.createDataFrame([(1, 1), (2, 3), (3, 99), (4, None)], "exhibition_id long, artist_id long")
    got = sorted(rows(A.validate_exhibitions(req, tiny.users), "exhibition_id", "accepted", "reason"))
    assert got == [(1, True, None), (2, False, A.NOT_AN_ARTIST), (3, False, A.ARTIST_NOT_FOUND),
                   (4, False, A.ARTIST_NOT_FOUND)]


def test_hot_artifact_with_large_quantities(spark, monkeypatch):
    """One artifact holds a third of all requests; some quantities are large, so
    the first refusal leaves much stock; others keep large or tiny stocks."""
    monkeypatch.setattr(A, "FEW_ACROSS", 0)
    rnd = random.Random(33)
    stock = {0: 5000, 1: 100_000, 2: 7, 3: 3000, 4: 0, 5: 40}
    reqs = []
    for seq in range(5000):
        art = 0 if rnd.random() < 0.34 else rnd.randrange(6)
        q = rnd.choice([2500, 900, 60]) if rnd.random() < 0.02 else rnd.choice([1, 2, 3, 5, 8, 13])
        reqs.append((seq, art, q, rnd.randrange(12)))
    known = set(range(11))
    req_df = spark.createDataFrame(reqs, "seq long, artifact_id long, quantity int, customer_id long").repartition(13)
    stock_df = spark.createDataFrame(list(stock.items()), "artifact_id long, quantity int")
    users = spark.createDataFrame([(u,) for u in known], "user_id long")
    got = A.admit_purchases(req_df, stock_df, ["seq"], users=users)
    want, _ = loop_purchases(reqs, stock, known)
    assert {r["seq"]: (r["stock_before"], r["accepted"], r["reason"]) for r in got.collect()} == want


def test_one_chunk_per_partition_of_a_hot_artifact(spark):
    from vitrine.functions.running import in_chunks, running_sum

    df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else 20,000 rows make one partition
    try:
        chunks = in_chunks(df, ["g"], ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert chunks.filter("g = 0").select("_chunk").distinct().count() > 2
    got = running_sum(chunks, ["g"], ["id"], F.col("id") % 7, "total").filter("g = 0").orderBy("id").collect()
    total = 0
    for r in got:
        total += r.id % 7
        assert r.total == total


def test_many_accepted_requests_are_joined(spark, monkeypatch):
    """Beyond the broadcast's limit the accepted requests are joined; the result is the same."""
    rnd = random.Random(31)
    reqs = [(seq, 0 if rnd.random() < 0.7 else rnd.randrange(6), rnd.choice([1, 2, 5, 30]), rnd.randrange(9)) for seq in range(4000)]
    req = spark.createDataFrame(reqs, "seq long, artifact_id long, quantity int, customer_id long")
    stock = spark.createDataFrame([(a, 700) for a in range(6)], "artifact_id long, quantity int")
    users = spark.createDataFrame([(u,) for u in range(8)], "user_id long")
    plain = sorted(rows(A.admit_purchases(req, stock, ["seq"], users=users)))
    monkeypatch.setattr(A, "FEW_ACROSS", 0)
    assert sorted(rows(A.admit_purchases(req, stock, ["seq"], users=users))) == plain
    monkeypatch.setattr(A, "MAX_ACCEPTED", 0)
    assert sorted(rows(A.admit_purchases(req, stock, ["seq"], users=users))) == plain


def test_requests_are_exchanged_once(spark, monkeypatch):
    """One range partitioning of the requests; later steps exchange totals, or the few candidates of an artifact."""
    import re

    seen = []
    monkeypatch.setattr(A, "FEW_ACROSS", 0)
    real = A.in_chunks
    monkeypatch.setattr(A, "in_chunks", lambda *a: seen.append(1) or real(*a))
    req = spark.range(200_000).selectExpr("id AS seq", "id % 5 AS artifact_id", "CAST(id % 3 + 1 AS INT) AS quantity", "id % 50 AS customer_id")
    stock = spark.createDataFrame([(a, 900) for a in range(5)], "artifact_id long, quantity int")
    out = A.admit_purchases(req, stock, ["seq"])
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(seen) == 1 and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    # What the rest of the plan exchanges is two rows a partition, by artifact.
    assert all(e.startswith("artifact_id") for e in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan))
    assert out.filter("accepted").groupBy("artifact_id").count().count() == 5
