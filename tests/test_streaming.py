"""Streaming admission (A4, A5) equals the batch operators."""

import random
import time

from pyspark.sql import functions as F

from conftest import rows

from vitrine.operators import admission as A
from vitrine.streaming import admission_stream as ST


def test_stream_purchases_equal_batch(spark, tmp_path):
    rnd = random.Random(5)
    reqs = [(seq, rnd.randrange(10), rnd.choice([1, 2, 3, 7, 0]), rnd.randrange(5)) for seq in range(600)]
    req = spark.createDataFrame(reqs, "seq long, artifact_id long, quantity int, customer_id long")
    stock = spark.createDataFrame([(a, rnd.choice([3, 10, 40])) for a in range(8)], "artifact_id long, quantity int")
    users = spark.createDataFrame([(u,) for u in range(4)], "user_id long")
    # Several files, one per micro-batch: state must carry across batches.  Arrival
    # order across batches is file order (modification time), so each file holds
    # a contiguous range and is written after the previous one.
    path = str(tmp_path / "req")
    for lo in (0, 200, 400):
        req.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 200)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(path)
    streamed = ST.run_to_table(ST.admit_purchases_stream(stream, stock, ["seq"], users=users), "t_purchases")
    batch = A.admit_purchases(req, stock, ["seq"], users=users)
    cols = ["seq", "stock_before", "accepted", "reason"]
    assert sorted(rows(streamed, *cols)) == sorted(rows(batch, *cols))


def test_stream_attends_equal_batch(spark, tmp_path):
    rnd = random.Random(9)
    reqs = [(seq, rnd.choice([None, *range(15)]), rnd.randrange(6)) for seq in range(500)]
    users = spark.createDataFrame([(u,) for u in range(13)], "user_id long")
    req = spark.createDataFrame(reqs, "seq long, customer_id long, exhibition_id long")
    att = spark.createDataFrame([(1, 1, None), (2, 2, None)],
                                "customer_id long, exhibition_id long, attended_at timestamp_ntz")
    ex = spark.createDataFrame([(0, 3), (1, 5), (2, None), (3, 1), (4, 20)], "exhibition_id long, capacity int")
    req.coalesce(1).write.parquet(str(tmp_path / "att"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "att"))
    streamed = ST.run_to_table(ST.admit_attends_stream(stream, att, ex, ["seq"], users=users), "t_attends")
    batch = A.admit_attends(req, att, ex, ["seq"], users=users)
    assert sorted(rows(streamed, "seq", "reason")) == sorted(rows(batch, "seq", "reason"))


def test_stream_cart_equals_batch(spark, tmp_path):
    from vitrine.operators import cart as K
    from vitrine.streaming import cart_stream as KS

    rnd = random.Random(13)
    events = [(seq, 0 if rnd.random() < 0.3 else rnd.randrange(10), rnd.randrange(6),
               rnd.choice(["add", "add", "set", "checkout"]), rnd.choice(["1", "2", "0", "-1", "x", " 4 ", "1_0", "+3", "99999999999"]))
              for seq in range(900)]
    df = spark.createDataFrame(events, "seq long, user_id long, artifact_id long, kind string, qty string")
    path = str(tmp_path / "cart")
    for lo in (0, 300, 600):
        df.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 300)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    versions = ST.run_to_table(KS.cart_state_stream(stream, ["seq"]), "t_cart")
    got = sorted(rows(KS.current_carts(versions, ["seq"])))
    assert got == sorted(rows(K.cart_state(df, ["seq"])))


def timed_requests(spark, rnd, n, nulls=0.05):
    """Times in no order, some null, some equal."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    data = [(seq, None if rnd.random() < nulls else start + dt.timedelta(seconds=rnd.randrange(n)), rnd.randrange(10), rnd.choice([1, 2, 3, 7, 0]),
             rnd.choice([None, *range(12)])) for seq in range(n)]
    return spark.createDataFrame(data, "seq long, ts timestamp_ntz, artifact_id long, quantity int, customer_id long").repartition(6)


def test_one_query_over_shuffled_files_equals_batch(spark):
    """Null times included; the stock left is the state's after the last batch."""
    rnd = random.Random(15)
    req = timed_requests(spark, rnd, 500)
    stock = spark.createDataFrame([(a, rnd.choice([3, 10, 40])) for a in range(8)], "artifact_id long, quantity int")
    users = spark.createDataFrame([(u,) for u in range(10)], "user_id long")
    played = ST.play(req, "ts", "t_play", lambda s, delay: ST.admit_purchases_stream(s, stock, ["ts", "seq"], users=users, time_col="ts", delay=delay))
    batch = A.admit_purchases(req, stock, ["ts", "seq"], users=users)
    cols = ["seq", "stock_before", "accepted", "reason"]
    assert sorted(rows(played.out, *cols)) == sorted(rows(batch, *cols)) and played.out.filter("ts IS NULL").count() > 0
    assert sorted(rows(ST.stock_left(played, stock))) == sorted(rows(A.stock_after(batch, stock)))
    played.remove()


def test_seats_after_a_stream_equal_batch(spark):
    rnd = random.Random(16)
    req = timed_requests(spark, rnd, 400).withColumnRenamed("artifact_id", "exhibition_id").drop("quantity")
    ex = spark.createDataFrame([(e, rnd.choice([2, 5, 50, None])) for e in range(8)], "exhibition_id long, capacity int")
    att = spark.createDataFrame([(1, 1, None), (2, 2, None)], "customer_id long, exhibition_id long, attended_at timestamp_ntz")
    played = ST.play(req, "ts", "t_seats", lambda s, delay: ST.admit_attends_stream(s, att, ex, ["ts", "seq"], time_col="ts", delay=delay))
    batch = A.admit_attends(req, att, ex, ["ts", "seq"])
    assert sorted(rows(played.out, "seq", "reason"), key=str) == sorted(rows(batch, "seq", "reason"), key=str)
    taken = {e: 0 for e in range(8)} | {1: 1, 2: 1}
    for r in batch.filter("accepted").collect():
        taken[r.exhibition_id] += 1
    assert dict(rows(ST.seats_taken(played, att, ex), "exhibition_id", "seats_taken")) == taken
    played.remove()


def test_requests_wait_for_the_watermark_and_late_ones_are_dropped(spark, tmp_path):
    """Four files, 10 seconds of delay: what is out of order within it is judged in
    order, what comes after its time was passed is dropped."""
    import datetime as dt

    def land(name, times):
        data = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 1, 1) for s in times]
        spark.createDataFrame(data, "seq long, ts timestamp_ntz, artifact_id long, quantity int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)

    land("a", [105, 101, 103])
    land("b", [100, 104, 200])       # 100 and 104 are in time: the watermark is at 95
    land("c", [150, 210])            # 150 is still judged before 200: the watermark was at 95 when it came
    land("d", [120])                 # late: the watermark was at 190
    stock = spark.createDataFrame([(1, 4)], "artifact_id long, quantity int")
    stream = spark.readStream.schema("seq long, ts timestamp_ntz, artifact_id long, quantity int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ST.run_to_table(ST.admit_purchases_stream(stream, stock, ["ts", "seq"], time_col="ts", delay="10 seconds"), "t_late", base=f"{tmp_path}/run")
    # 200 and 210 still wait: the watermark, at 200 now, has not passed them.
    assert sorted(rows(out, "seq", "stock_before", "accepted")) == [(100, 4, True), (101, 3, True), (103, 2, True), (104, 1, True), (105, 0, False), (150, 0, False)]


def land(df, path, ranges):
    """Files of contiguous ranges of seq, one after another."""
    for lo, hi in ranges:
        df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def state_of(spark, base, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{base}/checkpoint")


def test_seats_are_kept_by_bucket_and_in_chunks(spark, tmp_path, monkeypatch):
    """Sixty exhibitions make four groups; admitted customers are known over batches
    and chunks; a null exhibition is refused."""
    monkeypatch.setattr(ST.SeatFold, "CHUNK", 3)
    rnd = random.Random(21)
    reqs = [(seq, rnd.choice([None, *range(25)]), rnd.choice([None, 0, 0, *range(60)])) for seq in range(900)]
    req = spark.createDataFrame(reqs, "seq long, customer_id long, exhibition_id long")
    ex = spark.createDataFrame([(e, 20 if e % 2 == 0 else 3) for e in range(58)], "exhibition_id long, capacity int")
    att = spark.createDataFrame([(1, 1, None)], "customer_id long, exhibition_id long, attended_at timestamp_ntz")
    land(req, str(tmp_path / "in"), [(0, 300), (300, 600), (600, 900)])
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ST.run_to_table(ST.admit_attends_stream(stream, att, ex, ["seq"], buckets=3), "t_chunks", base=f"{tmp_path}/run")
    batch = A.admit_attends(req, att, ex, ["seq"])
    assert sorted(rows(out, "seq", "reason"), key=str) == sorted(rows(batch, "seq", "reason"), key=str)
    taken = state_of(spark, f"{tmp_path}/run", "taken")
    assert taken.count() > 40 and taken.select("key.st_bucket").distinct().count() <= 3
    chunks = [tuple(r) for r in state_of(spark, f"{tmp_path}/run", "admitted").select(
        "user_map_key.k", "user_map_key.chunk", F.size("user_map_value.customers").alias("n")).collect()]
    full = {e: sum(n for x, _, n in chunks if x == e) for e, _, _ in chunks}
    assert full[0] > 9 and all(n == min(3, full[e] - 3 * i) for e, i, n in chunks)


def test_carts_are_kept_by_bucket(spark, tmp_path):
    """Fifty users, and events without one, make four groups; carts go on over batches."""
    from vitrine.operators import cart as K
    from vitrine.streaming import cart_stream as KS

    rnd = random.Random(22)
    events = [(seq, u := rnd.choice([None, *range(50)]), rnd.randrange(4),
               "add" if u is None else rnd.choice(["add", "add", "set", "checkout"]), rnd.choice(["1", "2", "0", "-1", "x"])) for seq in range(900)]
    df = spark.createDataFrame(events, "seq long, user_id long, artifact_id long, kind string, qty string")
    land(df, str(tmp_path / "in"), [(0, 300), (300, 600), (600, 900)])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    blank = df.filter("seq = 0").select((F.col("seq") + 250).alias("seq"), F.explode(F.array(F.lit(None).cast("long"), F.lit(7))).alias("user_id"),
                                        F.lit(None).cast("long").alias("artifact_id"), F.lit("set").alias("kind"), F.lit("2").alias("qty"))
    blank.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))      # lines of no artifact
    versions = ST.run_to_table(KS.cart_state_stream(stream, ["seq"], buckets=3), "t_carts", base=f"{tmp_path}/run")
    want = sorted(rows(K.cart_state(df, ["seq"])), key=str)
    assert any(u is None for u, _, _ in want) and sorted(rows(KS.current_carts(versions, ["seq"])), key=str) == want
    carts = state_of(spark, f"{tmp_path}/run", "carts").select("key.st_bucket", "user_map_key.user_id", "user_map_value.*")
    kept = [(r.user_id, a, q) for r in carts.collect() for a, q in zip(r.artifacts, r.quantities)]
    assert sorted(kept) == sorted(r for r in want if r[0] is not None)
    assert carts.select("st_bucket").distinct().count() <= 3
