"""A training corpus from ``documents``, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import line_dedup, minhash, mixing, quality, sentencepiece
from vitrine.llm.common import Batches, Scratch, prepare, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = read(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts, and with them the
    documents that consisted of nothing else."""
    prepare(spark)
    done = line_dedup.line_dedup(docs)
    return done.filter("removed_words = 0 OR text <> ''").drop("removed_words", "removed_lines")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return minhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents are left out or repeated."""
    prepare(spark)
    return mixing.mixed(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded to ids, and decoded again to see that nothing is lost."""
    prepare(spark)
    return sentencepiece.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", sentencepiece_stage),
]
# No SQL: classifier, signatures, drawing and encoding are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared
    checkpoint folder and go at the end, as do the stages' session settings.  Rows
    with null, empty or repeated texts pass the stages as their operators state;
    of an empty table every stage gives no rows."""
    with Batches(spark), Scratch(spark) as scratch:
        docs = read(spark, sf_dir, "documents")
        for _, stage in STAGES:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return docs.checkpoint()
