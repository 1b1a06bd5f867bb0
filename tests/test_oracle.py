"""Every registered query against its SQL oracle (DuckDB) on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from vitrine.plans.compare import DRIVER_TABLES, diff, duck
from vitrine.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert all(q.sql for q in REGISTRY.values()) and len(REGISTRY) >= 51
    assert set(REGISTRY) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The same tables, the large ones as folders of shuffled part files."""
    base = tmp_path_factory.mktemp("many")
    for t in DRIVER_TABLES[:8]:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.repartition(5, F.rand(3)) if t in ("lineitem", "events", "orders") else df).write.parquet(str(base / f"{t}.parquet"))
    return str(base)


@pytest.mark.parametrize("key", [k for k in REGISTRY if k.startswith("stream_")] + ["admit_purchases", "cart_state", "assign_ids"])
def test_results_do_not_depend_on_files(spark, con, many_files, key):
    assert diff(E.queries()[key](spark, many_files), con, E.oracle_sql()[key]) is None


@pytest.mark.parametrize("key", [k for k in REGISTRY if not k.startswith("stream_")])
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    assert diff(df, con, E.oracle_sql()[key]) is None


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["customer_id", "name", "total_spent"]
    assert df.count() > 0
