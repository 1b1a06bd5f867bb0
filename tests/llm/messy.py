"""A small table with everything awkward: nulls, empty and long texts, ties,
repeated rows, and extra columns named like those the operators make."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
CLASHING = ("kept", "keep_id", "group_size", "score", "size", "target", "ids", "_id", "_text", "_row", "n", "digest", "removed_words", "spans")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING])
BODY = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of ancient herbs near the river bank tonight."
ROWS = [
    (1, BODY, "a"), (2, BODY.upper(), "a"), (2, BODY.upper(), "a"), (3, None, "b"), (4, "", None), (5, " \t\n ", "b"),
    (6, LONG, "c"), (7, LONG + " tail", "c"), (None, BODY, "a"), (None, None, None), (8, "one two", "é"), (9, "ONE two", "z"),
    (10, BODY + "\n" + BODY, None), (11, "Ünïcode ßtraße ▁ mark 😀 x", "é"), (12, "ÜNÏCODE ßtraße ▁ mark 😀 x", "é"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(CLASHING))]) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
