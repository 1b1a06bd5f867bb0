"""Helpers shared by the operators: session set-up, scratch tables, an exact
semi-join behind a size-bounded bitmap, and a join that splits hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import checkpoint_dir, configure

BITMAP_BITS = 1 << 28        # a broadcast bitmap never exceeds 2^28 bits = 32 MB
BUCKET_BITS = 1 << 15        # bits that bitmap_construct_agg() packs into one 4 KB row
# Texts can be long: batches small in rows and bytes bound a Python worker's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
HOT_SHARE = 1000             # a key with more than 1/1000 of the rows is hot: at most 1000 such keys
WORD = r"[^\x20\x09-\x0D]+"  # the words of the contracts


def prepare(spark: SparkSession) -> None:
    """Plan settings, checkpoint folder, and worker code pickled by value."""
    import vitrine.llm
    from pyspark import cloudpickle

    configure(spark)
    cloudpickle.register_pickle_by_value(vitrine.llm)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


class Batches:
    """The session's settings of Arrow batches as they were, put back when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, {key: spark.conf.get(key, None) for key in BATCHES}

    def __enter__(self) -> "Batches":
        return self

    def __exit__(self, *exc) -> None:
        for key, value in self.before.items():
            self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)


def tidy(run):
    """``run`` (for mapInArrow), after which its worker gives its free memory back:
    workers are kept for later tasks, beside those of other operators."""
    def whole(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return whole


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Intermediate tables as Parquet in the shared checkpoint folder, removed
    when the block ends.  They cut the lineage: a lost executor costs only the
    tasks that read them.  What an operator returns must not read them any
    more, so it is checkpointed before the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scratch":
        return self

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *exc) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z only.  Without other than ASCII characters lower() does the same, faster."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def bits_for(rows: int) -> int:
    """Bits of a bitmap over so many keys: 16 a key, up to the bound of a broadcast.
    Beyond it more keys pass by chance; results stay exact, as a join follows."""
    return min(BITMAP_BITS, max(BUCKET_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))


def positions(key: Column, bits: int) -> list[Column]:
    """The two places of a key in the bitmap."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (11, 23)]


def bitmap(places: DataFrame) -> DataFrame:
    """Rows (bucket, bitmap) from rows (place): at most bits / 2^15 rows of 4 KB."""
    return places.groupBy(F.shiftright("place", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(BUCKET_BITS - 1))).alias("bitmap"))


def probe(df: DataFrame, key: Column, bits: int, maps: DataFrame) -> DataFrame:
    """``df`` with a boolean ``_maybe``: both places of the key are set."""
    found = F.lit(True)
    names = df.columns
    for i, place in enumerate(positions(key, bits)):
        m = F.broadcast(maps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_map{i}")))
        df = df.withColumn(f"_place{i}", place)
        df = df.join(m, F.shiftright(f"_place{i}", 15) == F.col(f"_bucket{i}"), "left")
        bit = F.col(f"_place{i}").bitwiseAND(F.lit(BUCKET_BITS - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_map{i}"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        found = found & F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return df.select(*names, found.alias("_maybe"))


def likely(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """``df`` with ``_maybe``: true for every row whose key is in ``keys`` (one
    column), and for few others.  Only the bitmap travels, never rows of ``df``."""
    bits = bits_for(n_keys)
    k = keys.columns[0]
    maps = bitmap(keys.select(F.explode(F.array(*positions(F.col(k), bits))).alias("place")))
    return probe(df, F.col(key), bits, maps)


def join_hot(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the row of ``groups`` (one per key) of their key, which may be
    several columns; rows without a group go.  Groups with over 1/1000 of all
    ``total`` rows, so 1000 at most, are broadcast, and the hashes of their keys
    are the only thing the driver reads; the others hold few rows each and are
    joined by a shuffle that no key dominates."""
    columns = [key] if isinstance(key, str) else key
    mark = F.xxhash64(*columns)
    hot = [r[0] for r in groups.filter(F.col(size) > max(1, total // HOT_SHARE)).select(mark).distinct().collect()]
    if not hot:
        return rows.join(groups, key)
    # The same test on both sides: keys that share a hash go the same way.
    is_hot = mark.isin(hot)
    return rows.filter(is_hot).join(F.broadcast(groups.filter(is_hot)), key).unionByName(
        rows.filter(~is_hot).join(groups.filter(~is_hot), key))


def values_of(batch, *columns: str) -> Iterator[tuple]:
    """The rows of an Arrow batch, by column."""
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def only(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys`` (one column of distinct keys).
    Rows that the bitmap rules out stay where they are; the others are joined."""
    flagged = likely(df, key, keys, n_keys)
    return flagged.filter("_maybe").drop("_maybe").join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")


def without(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows of ``df`` whose key is not in ``keys`` (one column)."""
    flagged = likely(df, key, keys, n_keys)
    left = flagged.filter("_maybe").join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_anti")
    return flagged.filter("NOT _maybe").unionByName(left.select(*flagged.columns)).drop("_maybe")
