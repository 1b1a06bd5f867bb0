"""Title search over a stored gallery's title index (Q2, Q3, Q8 at scale).

A text that holds three characters in a row without a wildcard is looked up: the
artifacts that have all its three-character pieces are the candidates, their rows
are read from their folders, and ILIKE decides.  Any other text scans the titles.
Results equal the scan's, so the catalogue queries take them as their artifacts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.columns import blank_to_none, text_contains
from vitrine.sources.snapshots import GRAM_CHARS, GRAMS, Store


def pattern_grams(spark: SparkSession, text: str) -> list[str]:
    """The distinct pieces that every title matching ``%text%`` holds.  Lower case is
    Spark's, of the whole pattern, as ILIKE takes it; wildcards and escaped
    characters end a stretch."""
    lowered = spark.sql("SELECT lower(:p)", args={"p": f"%{text}%"}).first()[0]
    stretches = re.split(r"\\.|[%_\\]", lowered, flags=re.DOTALL)
    return sorted({s[i:i + GRAM_CHARS] for s in stretches for i in range(len(s) - GRAM_CHARS + 1)})


def title_candidates(store: Store, grams: list[str]) -> DataFrame:
    """Ids of artifacts that have all the pieces."""
    return (store.table(GRAMS).filter(F.col("gram").isin(grams)).groupBy("artifact_id")
            .agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("artifact_id"))


def find_titles(store: Store, text: str | None) -> DataFrame:
    """Artifacts whose title contains ``text``, any case (all artifacts if blank)."""
    text = blank_to_none(text)
    if text is None:
        return store.table("artifact")
    grams = pattern_grams(store.spark, text)
    found = store.lookup("artifact", title_candidates(store, grams)) if grams else store.table("artifact")
    return found.filter(text_contains("title", text))
