"""Connected components by contraction with random priorities.

Each round every node joins the one of least priority among itself and its
neighbours, and the links are redrawn between the merged nodes.  Fresh random
priorities each round but the first shrink any graph, long paths and stars alike, by a constant
factor on average, so the rounds number about the logarithm of the largest
component.  Links never reach the driver, and no node's links one task: the
neighbours' minimum is pre-aggregated and hot nodes are joined by broadcast of
1000 rows at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import Scratch, join_hot


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in ``links`` (u, v): the smallest id that
    links reach.  Links may repeat, point either way, or lead to themselves."""
    links = scratch.table(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    found, turn = None, 0
    while (n := links.count()) > 0:
        ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")),
                                 F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
        # The first round goes by the ids themselves: a star around its least id, as
        # comparisons with the least member make, is merged at once.
        rank = F.xxhash64("other", F.lit(turn)) if turn else F.lit(0).cast("long")
        near = links.select(ends.alias("e")).select("e.*").groupBy("id").agg(
            F.min(F.struct(rank.alias("rank"), "other")).alias("best"), F.count("*").alias("degree"))
        own = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.lit(0).cast("long")).alias("rank"), F.col("id").alias("other"))
        merged = scratch.table(near.select("id", F.least(own, F.col("best"))["other"].alias("label"), "degree"))
        for side in ("u", "v"):
            names = merged.select(F.col("id").alias(side), F.col("label").alias(f"new_{side}"), F.col("degree").alias(f"deg_{side}"))
            links = join_hot(links, names, side, f"deg_{side}", 2 * n)
        links = scratch.table(links.filter("new_u <> new_v").select(
            F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).distinct())
        step = merged.select("id", "label")
        if found is None:
            found = step
        else:
            onward = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
            found = found.join(onward, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
        turn += 1
    if found is None:
        return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = scratch.table(found)
    smallest = scratch.table(found.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("members")))
    return join_hot(found, smallest, "label", "members", found.count()).select("id", "component")
