"""Running sums over ordered groups of any size, without gathering a group.

Rows are range-partitioned on (group, order), sorted and checkpointed once, so a
hot group spans many partitions and a chunk (the rows of one group in one
partition) holds no more than a partition does.  A running sum then moves no row:
the sum within the chunk is taken in place, batch by batch, and only a
partition's first group can have rows in earlier ones, so its offset is one row
per partition, which is broadcast."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def in_chunks(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted on (group, order), with ``_chunk`` (the
    partition) and a row id ``_rid`` that ascends in that order, all fixed by a
    reliable checkpoint.  Filters, column expressions and joins with a broadcast
    side keep the order; any other join loses it."""
    return (df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
            .withColumn(CHUNK, F.spark_partition_id())
            .withColumn("_rid", F.monotonically_increasing_id())
            .checkpoint(eager=True))


def group_starts(columns: list[pa.Array], last: list[pa.Scalar] | None) -> np.ndarray:
    """Whether each row begins another group than the row before (``last``: the
    values of the row before the batch)."""
    n = len(columns[0])
    starts = np.zeros(n, bool)
    starts[0] = last is None or any(a[0] != b for a, b in zip(columns, last))
    for column in columns:
        a, b = column.slice(1), column.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        starts[1:] |= differ.to_numpy(zero_copy_only=False)
    return starts


def sums_in_groups(starts: np.ndarray, values: np.ndarray, before: int) -> np.ndarray:
    """Running sums that begin anew at ``starts``; the rows up to the first start
    go on from ``before``."""
    total = np.cumsum(values)
    base = np.where(starts, total - values, 0)
    base[0] = base[0] if starts[0] else -before
    index = np.where(starts, np.arange(len(values)), 0)
    return total - base[np.maximum.accumulate(index)]


def _local(n_group: int, name: str):
    """In-place running sums: the first ``n_group`` columns name the group, the last is the value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = [batch.column(i) for i in range(n_group)]
            sums = sums_in_groups(group_starts(groups, last), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), total)
            last, total = [g[-1] for g in groups], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*batch.schema.names[:-1], name])

    return run


def _tails(n_group: int):
    """One row per partition: its first and last group, and the sum of the last one's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, total, chunk = None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = [batch.column(i) for i in range(n_group)]
            sums = sums_in_groups(group_starts(groups, last), batch.column(n_group + 1).to_numpy(zero_copy_only=False), total)
            if first is None:
                first, chunk = [g.slice(0, 1) for g in groups], batch.column(n_group).slice(0, 1)
            last, total = [g[-1] for g in groups], int(sums[-1])
            tail = [g.slice(len(g) - 1, 1) for g in groups]
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [*first, *tail, chunk, pa.array([total], pa.int64())],
                [*[f"f{i}" for i in range(n_group)], *[f"l{i}" for i in range(n_group)], CHUNK, "total"])

    return run


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df``, in the order of :func:`in_chunks`, with the sum of ``value`` (null
    counts as 0) over the group's rows up to and including this one."""
    n = len(group)
    amount = F.coalesce(value.cast("bigint"), F.lit(0))
    kinds = dict(df.dtypes)
    first, tail = [f"f{i}" for i in range(n)], [f"l{i}" for i in range(n)]
    schema = ", ".join([*(f"{c} {kinds[g]}" for c, g in zip(first, group)), *(f"{c} {kinds[g]}" for c, g in zip(tail, group)),
                        f"{CHUNK} int", "total bigint"])
    ends = df.select(*group, CHUNK, amount.alias("_value")).mapInArrow(_tails(n), schema)
    # A partition's first group goes on from the last groups of earlier ones.  Two rows a partition.
    heads = ends.select(*[F.col(c).alias(g) for c, g in zip(first, group)], CHUNK, F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("total"))
    tails = ends.select(*[F.col(c).alias(g) for c, g in zip(tail, group)], CHUNK, F.lit(1).alias("kind"), "total")
    before = Window.partitionBy(*group).orderBy(CHUNK, "kind").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.unionByName(tails).withColumn("_offset", F.sum("total").over(before)).filter("kind = 0 AND _offset <> 0").select(
        *[F.col(g).alias(f"_first{i}") for i, g in enumerate(group)], F.col(CHUNK).alias("_at"), "_offset")
    rest = [c for c in df.columns if c not in group]
    columns = [*group, *rest]
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` bigint"])
    summed = df.select(*columns, amount.alias("_value")).mapInArrow(_local(n, name), out)
    same = F.col(CHUNK) == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_first{i}"))
    return summed.join(F.broadcast(offsets), same, "left").select(
        *df.columns, (F.col(name) + F.coalesce("_offset", F.lit(0))).alias(name))
