"""Catalogue and exhibition queries (Q1-Q9)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import TS, fixture_rows, rows

from vitrine.operators import catalogue as Q
from vitrine.sources.tables import from_rows


def test_catalogue_dash_for_missing(spark):
    data = fixture_rows()
    data["artifact"].append((6, None, None, "Orphan", None, "Other", None, None, D("1.00"), 1, None,
                             dt.datetime(2025, 10, 2)))
    g = from_rows(spark, data)
    got = rows(Q.catalogue(g), "artifact_id", "artist_name", "museum_name")
    assert got[0] == (6, "—", "—")  # newest first
    assert got[1] == (1, "Mara Quill", "North Hall")


def test_search_ignores_case_keeps_wildcards(spark):
    data = fixture_rows()
    data["artifact"].append((6, 1, 1, "100% Pure", None, "Painting", None, None, D("1.00"), 1, None, TS))
    g = from_rows(spark, data)
    assert rows(Q.in_stock_artifacts(g, search="dawn"), "artifact_id") == [(1,)]
    assert rows(Q.in_stock_artifacts(g, search="  DAWN  "), "artifact_id") == [(1,)]
    # '%' is a wildcard, as in the source: '0%p' matches '100% Pure'.
    assert rows(Q.in_stock_artifacts(g, search="0%p"), "artifact_id") == [(6,)]
    assert rows(Q.in_stock_artifacts(g, type_="sculpture"), "artifact_id") == [(3,), (4,)]
    assert Q.in_stock_artifacts(g, search="", type_=" ").count() == 6


def test_accent_insensitive_search(spark):
    data = fixture_rows()
    data["artifact"].append((6, 1, 1, "Café Scène", None, "Painting", None, None, D("1.00"), 1, None, TS))
    g = from_rows(spark, data)
    assert rows(Q.faceted_search(g, text="cafe scene", accents=False), "artifact_id") == [(6,)]
    assert Q.faceted_search(g, text="cafe scene").count() == 0


def test_artist_artifacts(spark, tiny):
    assert sorted(rows(Q.artist_artifacts(tiny, 1), "artifact_id")) == [(1,), (2,), (5,)]
    assert rows(Q.artist_artifacts(tiny, 1, search="hour"), "artifact_id") == [(2,)]
    artists = spark.createDataFrame([(2,)], "artist_id bigint")
    assert sorted(rows(Q.artist_artifacts(tiny, artists), "artifact_id")) == [(3,), (4,)]


def test_types_and_museums(tiny):
    assert sorted(r[0] for r in rows(Q.artifact_types(tiny))) == ["Digital", "Painting", "Sculpture"]
    assert rows(Q.museums_by_name(tiny), "name") == [("Lantern Rooms",), ("North Hall",)]


def test_upcoming(spark):
    data = fixture_rows()
    data["exhibition"].append((4, "No date", None, None, None, None, 1, None, 1, None))
    g = from_rows(spark, data)
    assert rows(Q.upcoming_exhibitions(g, "2025-12-01"), "exhibition_id") == [(2,), (3,)]
    got = rows(Q.upcoming_exhibitions_with_museum(g, "2025-12-01"), "title", "museum_name")
    assert got == [("Weights", "North Hall"), ("Signals", "Lantern Rooms")]


def test_faceted_search_bounds_inclusive(tiny):
    got = rows(Q.faceted_search(tiny, min_price=1800, max_price=5000), "artifact_id")
    assert got == [(3,), (1,), (2,)]
    assert rows(Q.faceted_search(tiny, museum_id=2, artist_id=1), "artifact_id") == [(5,)]


def test_artifacts_by_ids(spark, tiny):
    assert sorted(rows(Q.artifacts_by_ids(tiny, [1, 5, 99]), "artifact_id")) == [(1,), (5,)]
    ids = spark.createDataFrame([(2,), (2,), (4,)], "artifact_id bigint")
    assert sorted(rows(Q.artifacts_by_ids(tiny, ids), "artifact_id")) == [(2,), (4,)]


def test_repeated_ids_are_counted_out_before_the_join(spark, tiny):
    ids = spark.range(200_000).select((F.col("id") % 2 + 4).alias("artifact_id"))
    found = Q.artifacts_by_ids(tiny, ids)
    assert sorted(rows(found, "artifact_id")) == [(4,), (5,)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [artifact_id" in plan[plan.index("LeftSemi"):]
