"""Streaming form of the cart fold (K1): cart lines per user kept in state.

Users are grouped in hash buckets, as artifacts are in A4.  Each micro-batch folds a
user's events in order into the user's cart (``MapState`` user -> lines) and emits the lines it changed, 0 for one
that went, versioned by the user's last event.  The current carts are the latest
version of every line, read back from the append-only sink."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.streaming.admission_stream import _sorted, bucket_of, key_ranges, stateful, use_rocksdb, with_event_time


def _as_int(text) -> int | None:
    """As ``try_int``: 32-bit integers in plain digits with an optional sign."""
    digits = re.fullmatch(r" *([+-]?[0-9]+) *", text) if isinstance(text, str) else None
    value = int(digits[1]) if digits else None
    return value if value is not None and -2 ** 31 <= value < 2 ** 31 else None


class CartFold(StatefulProcessor):
    """Per bucket of users: each user's cart, read and written once a batch."""

    def __init__(self, order_cols: Sequence[str]):
        self.order_cols = list(order_cols)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carts = handle.getMapState("carts", "user_id long", "artifacts array<long>, quantities array<long>")
        self.nobody = handle.getValueState("nobody", "artifacts array<long>, quantities array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, ["user_id"] + self.order_cols)
        events = list(zip(batch["artifact_id"].tolist(), batch["kind"].tolist(), batch["qty"].tolist()))
        users, artifacts, quantities, last = [], [], [], []
        for user, lo, hi in key_ranges(batch, "user_id"):
            stored = self.nobody.get() if user is None else self.carts.getValue((user,))
            old = dict(zip(*stored)) if stored is not None else {}
            cart = dict(old)
            for art, kind, qty in events[lo:hi]:
                if kind == "checkout":
                    cart.clear()
                    continue
                q = _as_int(qty)
                if q is None or pd.isna(art):   # a line without an artifact is none
                    continue
                if kind == "add":
                    cart[art] = cart.get(art, 0) + max(1, q)
                elif q <= 0:
                    cart.pop(art, None)
                else:
                    cart[art] = q
            items = [(int(a), cart.get(a, 0)) for a in sorted(old.keys() | cart.keys()) if old.get(a) != cart.get(a)]
            if not items:
                continue
            lines = ([int(a) for a in cart], list(cart.values()))
            if user is None:
                self.nobody.update(lines)
            elif cart:
                self.carts.updateValue((user,), lines)
            else:
                self.carts.removeKey((user,))
            users += [user] * len(items)
            artifacts += [a for a, _ in items]
            quantities += [q for _, q in items]
            last += [hi - 1] * len(items)
        if not users:
            return
        out = {"user_id": pd.array(users, dtype="Int64"), "artifact_id": pd.array(artifacts, dtype="Int64"),
               "qty": np.array(quantities, dtype=np.int64)}
        for c in self.order_cols:
            out[c] = batch[c].take(last).to_numpy()
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def cart_state_stream(events: DataFrame, order_cols: Sequence[str], time_col: str | None = None,
                      delay: str | None = None, buckets: int | None = None) -> DataFrame:
    """K1 on a stream of cart events (user_id, artifact_id, kind, qty text, order
    columns); ``time_col``, ``delay`` and ``buckets`` as in A4.  Output (append): versions of the
    changed lines."""
    use_rocksdb(events.sparkSession)
    events = with_event_time(events, time_col, delay)
    schema = T.StructType(
        [T.StructField("user_id", T.LongType()), T.StructField("artifact_id", T.LongType()),
         T.StructField("qty", T.LongType())] + [events.schema[c] for c in order_cols])
    events = events.withColumn("st_bucket", bucket_of("user_id", events.sparkSession, buckets))
    return stateful(events.groupBy("st_bucket"), CartFold(order_cols), schema, time_col)


def current_carts(versions: DataFrame, order_cols: Sequence[str], artifact_type: str = "bigint") -> DataFrame:
    """Latest version per line as cart lines (user_id, artifact_id, qty > 0)."""
    latest = versions.groupBy("user_id", "artifact_id").agg(F.max_by("qty", F.struct(*order_cols)).alias("qty"))
    return latest.filter(F.col("qty") > 0).select(
        "user_id", F.col("artifact_id").cast(artifact_type).alias("artifact_id"), "qty")
