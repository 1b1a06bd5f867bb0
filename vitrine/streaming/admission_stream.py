"""Structured Streaming forms of the admission rules (A4, A5).

Requests arrive as an unbounded stream.  Static dimension data (initial
stock, capacity, existing attendances) is attached by stream-static joins;
the running part (stock left, seats taken, customers already admitted) is
kept per key in the state store by ``transformWithStateInPandas``.  Within a
micro-batch a key's requests are sorted by the order columns; across
micro-batches arrival order rules, unless the stream names its event time.  Then
a key's rows wait in state until the watermark has passed them (event-time
timers), and are judged in the order of their times whatever order they arrive
in; rows later than the watermark's delay are dropped and counted by Spark.  A
closing mark, a row far in the future, releases what still waits.  ``play`` runs
one such query over a stored table.  Run on the RocksDB state store provider so
state lives off the JVM heap and is checkpointed with the query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.operators.admission import (CAPACITY_FULL, CUSTOMER_NOT_FOUND, DUPLICATE, EXHIBITION_NOT_FOUND,
                                         INSUFFICIENT, NOT_FOUND, NOT_POSITIVE, NULL_QUANTITY)
from vitrine.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(rows: Iterator[pd.DataFrame], order_cols: Sequence[str]) -> pd.DataFrame:
    """One key's rows of this micro-batch in the order of the columns, nulls first."""
    chunks = list(rows)
    batch = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
    if len(batch) > 1:
        order = np.lexsort([pd.factorize(batch[c], sort=True)[0] for c in reversed(list(order_cols))])
        batch = batch.take(order)
    return batch


def bucket_of(key: str, spark: SparkSession, buckets: int | None) -> Column:
    """The bucket of a key, of 16 a state partition by default; null keys have one of
    their own, so that no other key's column of ids holds a null."""
    return F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(
        F.pmod(F.xxhash64(key), F.lit(buckets or 16 * state_partitions(spark))))


def key_ranges(batch: pd.DataFrame, key: str) -> Iterator[tuple[int | None, int, int]]:
    """(key, first row, row after the last) of each key in a bucket's sorted rows;
    null keys are one, None."""
    ids = batch[key].to_numpy()
    if pd.isna(ids[0]):
        yield None, 0, len(ids)
        return
    borders = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    for lo, hi in zip(borders, borders[1:]):
        yield int(ids[lo]), lo, hi


# -------------------------------------------------------------- event time

EVENT_TIME = "st_time"
CLOSING = "9999-01-01"      # the time of a closing mark; no request has it


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them and hands them,
    in time order, to another processor.  Each micro-batch adds one element to the
    waiting list: the rows as Arrow bytes.  Rows without a time go with the first
    release after them, before all others."""

    def __init__(self, inner: StatefulProcessor):
        self.inner = inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        times = batch[EVENT_TIME].dropna()
        now = timerValues.getCurrentWatermarkInMs()
        due = int(times.max().value // 1_000_000) + 1 if len(times) else 0
        self.waiting.appendValue((self._packed(batch),))
        self.handle.registerTimer(max(due, now + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [self._unpacked(value[0]) for value in self.waiting.get()]
        if not parts:
            return
        batch = pd.concat(parts, ignore_index=True)
        passed = batch[EVENT_TIME].isna() | (batch[EVENT_TIME] <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"))
        self.waiting.clear()
        if not passed.all():
            self.waiting.appendValue((self._packed(batch[~passed]),))
        if passed.any():
            yield from self.inner.handleInputRows(key, iter([batch[passed].reset_index(drop=True)]), timerValues)

    @staticmethod
    def _packed(batch: pd.DataFrame) -> bytes:
        table = pa.Table.from_pandas(batch, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def _unpacked(data: bytes) -> pd.DataFrame:
        return pa.ipc.open_stream(pa.BufferReader(bytes(data))).read_all().to_pandas()

    def close(self) -> None:
        self.inner.close()


def with_event_time(requests: DataFrame, time_col: str | None, delay: str | None) -> DataFrame:
    """``requests`` with a watermark ``delay`` behind their times, if they name one;
    closing marks move the watermark and go."""
    if time_col is None:
        return requests
    timed = requests.withColumn(EVENT_TIME, F.col(time_col).cast("timestamp")).withWatermark(EVENT_TIME, delay or "0 seconds")
    # This must see the time: a filter that does not would be pushed below the watermark.
    return timed.filter(F.col(EVENT_TIME).isNull() | (F.col(EVENT_TIME) < F.to_timestamp(F.lit(CLOSING))))


def stateful(grouped, processor: StatefulProcessor, schema: T.StructType, time_col: str | None) -> DataFrame:
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor if time_col is None else InOrder(processor), outputStructType=schema,
        outputMode="Append", timeMode="None" if time_col is None else "EventTime")


# ------------------------------------------------------------------------- A4

class StockFold(StatefulProcessor):
    """Per bucket of artifacts: the stock left of each artifact (``MapState``),
    initialised from the request's ``st_stock0``.  Grouping by a fixed hash
    bucket instead of the artifact keeps the Python state API's fixed cost per
    group off the hot path; state reads and writes stay per artifact touched.
    (Helper columns avoid a leading underscore: the state API renames those.)"""

    def __init__(self, columns: Sequence[str], order_cols: Sequence[str], key: str, qty: str = "quantity"):
        self.columns, self.order_cols, self.key, self.qty = list(columns), list(order_cols), key, qty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getMapState("left", "k long", "v long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, [self.key] + self.order_cols)
        before, accepted, reason = [], [], []
        current, remaining, dirty = None, None, False
        for art, q, s0, found, known in zip(batch[self.key].tolist(), batch[self.qty].tolist(),
                                            batch["st_stock0"].tolist(), batch["st_found"].tolist(),
                                            batch["st_customer_ok"].tolist()):
            if art != current:
                if dirty:
                    self.left.updateValue((int(current),), (remaining,))
                current, dirty = art, False
                stored = self.left.getValue((int(art),)) if art is not None else None
                remaining = stored[0] if stored is not None else None
            if not found or s0 is None or pd.isna(s0):
                before.append(None), accepted.append(False), reason.append(NOT_FOUND)
                continue
            if q is None or pd.isna(q):
                before.append(None), accepted.append(False), reason.append(NULL_QUANTITY)
                continue
            if q <= 0:
                before.append(None), accepted.append(False), reason.append(NOT_POSITIVE)
                continue
            if q > s0:
                before.append(None), accepted.append(False), reason.append(INSUFFICIENT)
                continue
            if remaining is None:
                remaining, dirty = int(s0), True
            before.append(remaining)
            if q > remaining:
                accepted.append(False), reason.append(INSUFFICIENT)
            elif not known:
                accepted.append(False), reason.append(CUSTOMER_NOT_FOUND)
            else:
                accepted.append(True), reason.append(None)
                remaining, dirty = remaining - int(q), True
        if dirty:
            self.left.updateValue((int(current),), (remaining,))
        out = {c: batch[c].to_numpy() for c in self.columns}
        out["stock_before"] = pd.array(before, dtype="Int32")
        out["accepted"] = np.array(accepted, dtype=bool)
        out["reason"] = np.array(reason, dtype=object)
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def admit_purchases_stream(requests: DataFrame, stock: DataFrame, order_cols: Sequence[str],
                           users: DataFrame | None = None, key: str = "artifact_id",
                           customer: str = "customer_id", buckets: int | None = None,
                           time_col: str | None = None, delay: str | None = None) -> DataFrame:
    """A4: streaming A1.  ``requests`` is a streaming DataFrame; ``stock`` and
    ``users`` are static.  With ``time_col`` requests are judged by event time, with
    ``delay`` for those out of order; else as they arrive.  Output (append mode): request columns plus
    ``stock_before``, ``accepted``, ``reason``, as in the batch operator.
    ``buckets`` is part of the state layout: keep it fixed for a checkpoint.  By
    default there are 16 per state partition."""
    use_rocksdb(requests.sparkSession)
    buckets = buckets or 16 * state_partitions(requests.sparkSession)
    columns = requests.columns
    requests = with_event_time(requests, time_col, delay)
    s = stock.select(F.col("artifact_id").alias(key), F.col("quantity").cast("long").alias("st_stock0"),
                     F.lit(True).alias("st_found"))
    r = requests.join(s, key, "left").withColumn("st_found", F.coalesce("st_found", F.lit(False)))
    if users is not None:
        known = users.select(F.col("user_id").alias(customer), F.lit(True).alias("st_customer_ok")).distinct()
        r = r.join(known, customer, "left")
    else:
        r = r.withColumn("st_customer_ok", F.lit(True))
    r = (r.withColumn("st_customer_ok", F.coalesce("st_customer_ok", F.lit(False)))
         .withColumn("st_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))))
    out_schema = T.StructType(
        [requests.schema[c] for c in columns]
        + [T.StructField("stock_before", T.IntegerType()), T.StructField("accepted", T.BooleanType()),
           T.StructField("reason", T.StringType())])
    return stateful(r.groupBy("st_bucket"), StockFold(columns, order_cols, key), out_schema, time_col)


# ------------------------------------------------------------------------- A5

class SeatFold(StatefulProcessor):
    """Per bucket of exhibitions: the seats that this stream has taken of each
    exhibition, and the customers admitted, in chunks of at most ``CHUNK``.  An
    exhibition's state is read and written once a batch, not once a request."""

    CHUNK = 1024

    def __init__(self, columns: Sequence[str], order_cols: Sequence[str], key: str = "exhibition_id"):
        self.columns, self.order_cols, self.key = list(columns), list(order_cols), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "k long", "v long")
        self.admitted = handle.getMapState("admitted", "k long, chunk long", "customers array<long>")

    def _chunks(self, ex: int, first: int, last: int) -> list[int]:
        """The customers in an exhibition's chunks first .. last - 1."""
        return [c for i in range(first, last) for c in self.admitted.getValue((ex, i))[0]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, [self.key] + self.order_cols)
        accepted, reason = [], []
        requests = list(zip(batch["customer_id"].tolist(), batch["capacity"].tolist(), batch["st_found"].tolist(),
                            batch["st_existing"].tolist(), batch["st_already"].tolist(), batch["st_customer_ok"].tolist()))
        for ex, lo, hi in key_ranges(batch, self.key):
            stored = self.taken.getValue((ex,)) if ex is not None else None
            before = stored[0] if stored is not None else 0
            taken, fresh, seen = before, [], None
            for c, cap, found, existing, already, known in requests[lo:hi]:
                if not found or cap is None or pd.isna(cap):
                    accepted.append(False), reason.append(EXHIBITION_NOT_FOUND)
                elif existing + taken >= cap:
                    accepted.append(False), reason.append(CAPACITY_FULL)
                elif not known:
                    accepted.append(False), reason.append(CUSTOMER_NOT_FOUND)
                else:
                    if seen is None:
                        seen = set(self._chunks(ex, 0, -(-before // self.CHUNK)))
                    if already or int(c) in seen:
                        accepted.append(False), reason.append(DUPLICATE)
                    else:
                        accepted.append(True), reason.append(None)
                        taken += 1
                        fresh.append(int(c))
                        seen.add(int(c))
            if fresh:
                self.taken.updateValue((ex,), (taken,))
                # The last chunk is filled up, the ones before it stay.
                at = before // self.CHUNK
                tail = self._chunks(ex, at, -(-before // self.CHUNK)) + fresh
                for i in range(0, len(tail), self.CHUNK):
                    self.admitted.updateValue((ex, at + i // self.CHUNK), (tail[i:i + self.CHUNK],))
        out = {c: batch[c].to_numpy() for c in self.columns}
        out["accepted"] = np.array(accepted, dtype=bool)
        out["reason"] = np.array(reason, dtype=object)
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def admit_attends_stream(requests: DataFrame, attends: DataFrame, exhibition: DataFrame,
                         order_cols: Sequence[str], users: DataFrame | None = None,
                         time_col: str | None = None, delay: str | None = None, buckets: int | None = None) -> DataFrame:
    """A5: streaming A2 (requests streaming; attends, exhibition and users static);
    ``time_col``, ``delay`` and ``buckets`` as in A4."""
    use_rocksdb(requests.sparkSession)
    columns = requests.columns
    requests = with_event_time(requests, time_col, delay)
    e, c = "exhibition_id", "customer_id"
    existing = attends.groupBy(e).agg(F.count(F.lit(1)).alias("st_existing"))
    ex = (exhibition.select(e, "capacity", F.lit(True).alias("st_found")).join(existing, e, "left")
          .withColumn("st_existing", F.coalesce("st_existing", F.lit(0)).cast("long")))
    pairs = attends.select(e, c).distinct().withColumn("st_already", F.lit(True))
    r = (requests.join(ex, e, "left").join(pairs, [e, c], "left")
         .withColumn("st_found", F.coalesce("st_found", F.lit(False)))
         .withColumn("st_existing", F.coalesce("st_existing", F.lit(0)).cast("long"))
         .withColumn("st_already", F.coalesce("st_already", F.lit(False))))
    if users is not None:
        known = users.select(F.col("user_id").alias(c), F.lit(True).alias("st_customer_ok")).distinct()
        r = r.join(known, c, "left").withColumn("st_customer_ok", F.coalesce("st_customer_ok", F.lit(False)))
    else:
        r = r.withColumn("st_customer_ok", F.col(c).isNotNull())
    out_schema = T.StructType(
        [requests.schema[x] for x in columns]
        + [T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType())])
    r = r.withColumn("st_bucket", bucket_of(e, requests.sparkSession, buckets))
    return stateful(r.groupBy("st_bucket"), SeatFold(columns, order_cols), out_schema, time_col)


# ------------------------------------------------------------------ running

def state_partitions(spark: SparkSession) -> int:
    """Partitions for a new stateful query.  State operators pay a fixed cost per
    key and partition, so use at least four per core; the number is fixed in
    the checkpoint at the first run."""
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(current, 4 * spark.sparkContext.defaultParallelism)


TIMEOUT_S = 3600


def run_to_table(stream: DataFrame, name: str, partitions: int | None = None, base: str | None = None,
                 timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Run a streaming query until its source is drained (``availableNow``),
    writing parquet and its checkpoint below the shared checkpoint folder (or
    ``base``), and return the written table.  The sink is exactly-once: a
    restarted query resumes from its checkpoint."""
    spark = stream.sparkSession
    base = base or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    # The query clones the session settings when it starts.
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or state_partitions(spark)))
    try:
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
                 .trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {name} did not drain in {timeout_s} s")
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


BATCHES = 3                 # micro-batches of a played table, at least
FILES_PER_BATCH = 256       # files that one micro-batch reads, at most


class Played:
    """A stored table that one streaming query has read, with what it wrote and the
    state that it left."""

    def __init__(self, spark: SparkSession, base: str, out: DataFrame):
        self.spark, self.base, self.out = spark, base, out

    def state(self, variable: str) -> DataFrame:
        """A state variable of the stream after its last batch, through Spark's state data source."""
        return self.spark.read.format("statestore").option("stateVarName", variable).load(f"{self.base}/checkpoint")

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def play(requests: DataFrame, time_col: str, name: str, process: Callable[[DataFrame, str], DataFrame]) -> Played:
    """Run ``process`` (streaming frame and watermark delay in, streaming frame out)
    as one query over a stored table, in whatever order its files arrive, with a
    closing mark at the end.  The delay covers the table's whole range of times, so
    no row is late.  The caller removes the folders when done."""
    spark = requests.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    requests.write.parquet(f"{base}/in")
    stored = spark.read.schema(requests.schema).parquet(f"{base}/in")
    time = F.unix_micros(F.col(time_col).cast("timestamp"))
    span = stored.agg(((F.max(time) - F.min(time)) / 1_000_000).cast("bigint")).first()[0] or 0
    files = max(1, len(stored.inputFiles()))
    mark = spark.range(1).select(*[F.lit(CLOSING if f.name == time_col else None).cast(f.dataType).alias(f.name) for f in requests.schema])
    mark.write.mode("append").parquet(f"{base}/in")
    stream = (spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", min(FILES_PER_BATCH, -(-files // BATCHES)))
              .parquet(f"{base}/in"))
    return Played(spark, base, run_to_table(process(stream, f"{span + 1} seconds"), name, base=base))


def stock_left(played: Played, stock: DataFrame, key: str = "artifact_id") -> DataFrame:
    """The stock snapshot after a stream of A4: the state's stock where a request
    came as far as that, the initial one else."""
    left = played.state("left").select(F.col("user_map_key.k").alias(key), F.col("user_map_value.v").alias("st_left"))
    return stock.join(left, key, "left").withColumn("quantity", F.coalesce("st_left", "quantity").cast("int")).drop("st_left")


def seats_taken(played: Played, attends: DataFrame, exhibition: DataFrame) -> DataFrame:
    """(exhibition_id, capacity, seats_taken) after a stream of A5: earlier
    attendances and those that the stream admitted."""
    e = "exhibition_id"
    taken = played.state("taken").select(F.col("user_map_key.k").alias(e), F.col("user_map_value.v").alias("st_taken"))
    before = attends.groupBy(e).agg(F.count(F.lit(1)).alias("st_before"))
    return exhibition.select(e, "capacity").join(before, e, "left").join(taken, e, "left").select(
        e, "capacity", (F.coalesce("st_before", F.lit(0)) + F.coalesce("st_taken", F.lit(0))).alias("seats_taken"))
