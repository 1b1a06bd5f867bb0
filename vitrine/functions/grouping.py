"""Groups of things that links connect, without gathering a group.

Each round every node moves to the neighbour of least random priority, or stays,
and the links are redrawn between the places: any graph, a long path or a star
alike, shrinks by a constant factor on average.  As soon as few links are left,
one task joins them up."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_LINKS = 200_000     # links that one task joins up, at 16 bytes each


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["id", "place"])


def connected(links: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """(id, place) for every id in ``links`` (u, v: long): ids that links connect,
    however far, have one place, which is one of them."""
    links = links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().checkpoint()
    found, turn = None, 0
    while (n := links.count()) > few_links:
        ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")),
                                 F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
        seed = F.lit(turn)
        ranked = F.struct(F.xxhash64("other", seed).alias("rank"), "other")
        own = F.struct(F.xxhash64("id", seed).alias("rank"), F.col("id").alias("other"))
        step = (links.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.min(ranked).alias("best"))
                .select("id", F.least(own, F.col("best"))["other"].alias("place")).checkpoint())
        for side in ("u", "v"):
            links = links.join(step.select(F.col("id").alias(side), F.col("place").alias(f"new_{side}")), side)
        links = links.filter("new_u <> new_v").select(
            F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).distinct().checkpoint()
        found = step if found is None else _onward(found, step).checkpoint()
        turn += 1
    rest = links.coalesce(1).mapInArrow(_join_up, "id long, place long") if n else None
    if found is None:
        return rest if rest is not None else links.select(F.col("u").alias("id"), F.col("v").alias("place"))
    return _onward(found, rest) if rest is not None else found


def _onward(found: DataFrame, step: DataFrame) -> DataFrame:
    """Where the places of ``found`` have moved to."""
    return found.join(step.select(F.col("id").alias("place"), F.col("place").alias("next")), "place", "left").select(
        "id", F.coalesce("next", "place").alias("place"))
