"""Session settings.

Library code never builds its own session for real work: it takes the
caller's, and only adjusts SQL settings that shape plans (AQE, skew handling).
``local_session`` is for tests and the local benchmark.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

PLAN_SETTINGS = {
    # Re-plan at stage boundaries on measured sizes: coalesce small partitions,
    # split skewed join partitions, turn joins into broadcasts when a side is
    # measured small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Timestamps in the data carry no zone.
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in PLAN_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Functions that run in Python workers (mapInPandas folds, stateful
    processors) are pickled by value, so executors and the driver-side streaming
    worker need no copy of this package on their path."""
    import sys

    from pyspark import cloudpickle

    for name in ("vitrine.functions.running", "vitrine.functions.grouping", "vitrine.operators.admission", "vitrine.operators.cart", "vitrine.streaming.admission_stream",
                 "vitrine.streaming.cart_stream"):
        __import__(name)
        cloudpickle.register_pickle_by_value(sys.modules[name])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    On a cluster this is the folder named by ``spark.checkpoint.dir``, which must
    be set.  Only a local master without the setting (tests) gets a private
    temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vitrine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "vitrine") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in PLAN_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
