"""Ranking over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.running import in_chunks, running_sum

HOT_SHARE = 1000    # a value with more than 1/1000 of the rows is hot: at most 1000 such values


def rank_desc(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``RANK() OVER (ORDER BY value DESC NULLS LAST)``, distributed.

    A value's rank is one more than the rows of all greater values, so only the
    distinct values and their counts are sorted, and summed in order.  Ranks go
    back to the rows by a join, those of hot values by a broadcast: however many
    rows are tied, no task holds a tie."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    values = in_chunks(counts, ["_all"], [F.col("_v").desc_nulls_last()])
    ranks = running_sum(values, ["_all"], [], F.col("_n"), "_upto").select(
        "_v", "_n", (F.col("_upto") - F.col("_n") + 1).cast("int").alias(name))
    total = values.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") > total // HOT_SHARE
    hot = F.broadcast(ranks.filter(is_hot))
    found = df.join(hot, df[value].eqNullSafe(F.col("_v")), "left")
    cold = ranks.filter(~is_hot).drop("_n")
    rest = found.filter(F.col("_n").isNull()).select(*df.columns)
    return found.filter(F.col("_n").isNotNull()).select(*df.columns, name).unionByName(
        rest.join(cold, rest[value].eqNullSafe(cold["_v"])).select(*[rest[c] for c in df.columns], name))
