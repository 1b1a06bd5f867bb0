"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every normalised text and counts how many texts meet each of two
Bloom places; the places met twice make a bitmap of at most 32 MB.  Pass 2
probes it: a text that has a copy always passes.  Only the passing digests
shuffle, to be grouped exactly; all others pass straight through as unique.
Texts themselves never shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common as C


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The largest id of a group stays.  Rows that repeat an id with the same text
    count in group_size and share one verdict.  A null id is below all others:
    its row stays only if all ids of its group are null.  Other columns are not
    read.  An empty table gives no rows."""
    with C.Scratch(docs.sparkSession) as scratch:
        text = C.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
        digests = scratch.table(docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("digest")))
        total = digests.count()
        bits = C.bits_for(total)
        twice = (digests.select(F.explode(F.array(*C.positions(F.col("digest"), bits))).alias("place"))
                 .groupBy("place").count().filter("count > 1"))
        probed = C.probe(digests, F.col("digest"), bits, scratch.table(C.bitmap(twice)))
        maybe = scratch.table(probed.filter("_maybe").drop("_maybe"))
        groups = scratch.table(maybe.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count("*").alias("n")))
        copies = C.join_hot(maybe, groups, "digest", "n", total)
        single = probed.filter("NOT _maybe").select("_id", "digest", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        return copies.unionByName(single).select(
            F.col("_id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256")).checkpoint()
