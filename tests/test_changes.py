"""Bulk changes (W1-W7) and the display projection."""

import datetime as dt
from decimal import Decimal as D

from conftest import TS, rows
from pyspark.sql import functions as F

from vitrine.operators import changes as W
from vitrine.operators import display as P


def test_delete_artifacts_archives_sold(spark, tiny):
    ids = spark.createDataFrame([(3,), (4,), (99,)], "artifact_id long")
    after, report = W.delete_artifacts(tiny, ids)
    assert sorted(rows(report)) == [(3, "archived"), (4, "deleted"), (99, "not_found")]
    q = dict(rows(after.artifact, "artifact_id", "quantity"))
    assert q[3] == 0 and 4 not in q and q[1] == 9


def test_owner_delete(spark, tiny):
    req = spark.createDataFrame([(4, 2, "Artist"), (4, 1, "Artist"), (1, 1, "Artist"), (5, 5, "Admin"),
                                 (4, 3, "Customer"), (42, 1, "Artist")],
                                "artifact_id long, requester_id long, role string")
    after, out = W.owner_delete_artifacts(tiny, req)
    assert sorted(rows(out)) == sorted([(4, 2, "Artist", "deleted"), (4, 1, "Artist", "unauthorized"),
                                        (1, 1, "Artist", "has_purchases"), (5, 5, "Admin", "deleted"),
                                        (4, 3, "Customer", "unauthorized"), (42, 1, "Artist", "not_found")])
    assert sorted(r[0] for r in rows(after.artifact, "artifact_id")) == [1, 2, 3]
    assert (3, 5) not in set(rows(after.exhibition_artifact, "exhibition_id", "artifact_id"))


def test_cascade_delete_customer(spark, tiny):
    users = spark.createDataFrame([(3,)], "user_id long")
    after, log = W.cascade_delete(tiny, users=users)
    assert sorted(r[0] for r in rows(after.purchase, "purchase_id")) == [3]
    assert rows(after.attends, "customer_id", "exhibition_id") == [(4, 1)]
    assert rows(after.visits, "customer_id", "museum_id") == [(4, 1)]
    assert dict(rows(after.artifact, "artifact_id", "quantity"))[1] == 9  # no restock
    assert ("purchase", "1", "deleted") in set(rows(log))


def test_cascade_delete_artist_sets_null(spark, tiny):
    users = spark.createDataFrame([(1,)], "user_id long")
    after, log = W.cascade_delete(tiny, users=users)
    art = dict(rows(after.artifact, "artifact_id", "artist_id"))
    assert sorted(a for a, v in art.items() if v is None) == [1, 2, 5]
    ex = dict(rows(after.exhibition, "exhibition_id", "artist_id"))
    assert sorted(e for e, v in ex.items() if v is None) == [1, 3]


def test_rekey_follows_references(spark, tiny):
    mapping = spark.createDataFrame([(3, 300)], "old_id long, new_id long")
    after, log = W.rekey(tiny, user_map=mapping)
    assert sorted(r[0] for r in rows(after.users, "user_id")) == [1, 2, 4, 5, 300]
    assert sorted(rows(after.purchase, "purchase_id", "customer_id")) == [(1, 300), (2, 300), (3, 4)]
    assert set(rows(log, "table_name", "column_name")) == {("users", "user_id"), ("attends", "customer_id"),
                                                          ("visits", "customer_id"), ("purchase", "customer_id")}


def test_rekey_without_maps(spark, tiny):
    after, log = W.rekey(tiny)
    assert log.count() == 0 and after.users.count() == 5


def test_assign_ids_dense_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = W.assign_ids(df, ["k"], 41, "new_id")
    got = sorted(rows(out, "k", "new_id"))
    assert got == [(k, 42 + k) for k in range(1000)]


def test_column_defaults_only_for_absent(spark):
    raw = spark.createDataFrame([(1, "A", None)], "artifact_id long, title string, quantity int")
    out = W.column_defaults(raw, "artifact", now=F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).collect()[0]
    assert out["type"] == "Other" and out["price"] == D("0.00") and out["quantity"] is None
    assert out["created_at"] == dt.datetime(2024, 1, 1)


def test_append_artifacts(spark, tiny):
    raw = spark.createDataFrame([
        (1, 1, "  New one ", " d ", None, "", "", "", "x.png"),
        (2, 1, "Bad", "", "Painting", "abc", "1", "1", "x.gif"),
        (3, 2, "Neg", "", "Sculpture", "5", "-1", "2", None),
        (4, 2, "Far", "", "Digital", "5", "1", "9", None),
        (5, 999, "Nobody's", "", "Digital", "5", "1", "1", None),
        (6, 2, None, "", "Digital", "5", "1", "1", None),
        (7, 2, "T" * 400, "", "Digital", "5", "1", "1", None),
        (8, 2, "Odd", "", "Pottery", "5", "1", "1", None),
        (9, None, "Free", "", "Digital", "5", "1", "1", None),
    ], "src long, artist_id long, title string, description string, type string, price string, "
       "quantity string, museum string, image string")
    snap, outcome = W.append_artifacts(tiny, raw, ["src"], now=F.lit(TS).cast("timestamp_ntz"))
    got = sorted(rows(outcome, "src", "artifact_id", "title", "type", "price", "quantity", "museum_id", "image",
                      "reason"))
    assert got == [(1, 6, "New one", "Other", D("0.00"), 0, None, "x.png", None),
                   (2, None, "Bad", "Painting", None, 1, 1, None, "bad_price"),
                   (3, None, "Neg", "Sculpture", D("5.00"), -1, 2, None, "quantity_negative"),
                   (4, None, "Far", "Digital", D("5.00"), 1, 9, None, "museum_not_found"),
                   (5, None, "Nobody's", "Digital", D("5.00"), 1, 1, None, "artist_not_found"),
                   (6, None, None, "Digital", D("5.00"), 1, 1, None, "title_missing"),
                   (7, None, "T" * 400, "Digital", D("5.00"), 1, 1, None, "title_too_long"),
                   (8, None, "Odd", "Pottery", D("5.00"), 1, 1, None, "bad_type"),
                   (9, 7, "Free", "Digital", D("5.00"), 1, 1, None, None)]
    assert snap.count() == 7


def test_append_exhibitions(spark, tiny):
    raw = spark.createDataFrame([
        (1, "Good", "t", "2026-01-01", "2026-02-01", "", "1", 1),
        (2, "NotArtist", "t", "2026-01-01", "", "5", "1", 3),
        (3, "Back", "t", "2026-01-02", "2026-01-01", "5", "1", 2),
        (4, "Cap", "t", "2026-01-01", "", "lots", "1", 2),
        (5, None, "t", "2026-01-01", "", "5", "1", 2),
        (6, "E" * 151, "t", "2026-01-01", "", "5", "1", 2),
    ], "src long, title string, theme string, start string, end string, capacity string, museum string, "
       "artist_id long")
    snap, outcome = W.append_exhibitions(tiny, raw, ["src"])
    got = sorted(rows(outcome, "src", "exhibition_id", "capacity", "reason"))
    assert got == [(1, 4, 0, None), (2, None, 5, "Only artists can organize exhibitions"),
                   (3, None, 5, "end_before_start"), (4, None, None, "bad_capacity"),
                   (5, None, 5, "title_missing"), (6, None, 5, "title_too_long")]
    assert snap.count() == 4


def test_display_columns(spark):
    df = spark.createDataFrame([(D("2500.5"), "x" * 106, None, ""), (D("3.00"), "short", "a.png", "Name")],
                               "price decimal(12,2), description string, image string, artist string")
    got = rows(P.display_columns(df, money=["price"], short=["description"],
                                 fills={"image": "placeholder.png", "artist": "-"}))
    assert got[0] == ("2500.50", "x" * 99 + "…", "placeholder.png", "-")
    assert got[1] == ("3.00", "short", "a.png", "Name")


def test_append_with_absent_fields(spark, tiny):
    raw = spark.createDataFrame([(1, 2, "Only a title")], "src long, artist_id long, title string")
    _, outcome = W.append_artifacts(tiny, raw, ["src"], now=F.lit(TS).cast("timestamp_ntz"))
    got = rows(outcome, "artifact_id", "title", "type", "price", "quantity", "museum_id", "reason")
    assert got == [(6, "Only a title", "Other", D("0.00"), 0, None, None)]
    raw = spark.createDataFrame([(1, "Show", "1", 1)], "src long, title string, museum string, artist_id long")
    _, outcome = W.append_exhibitions(tiny, raw, ["src"])
    assert rows(outcome, "exhibition_id", "capacity", "start_date", "reason") == [(4, 0, None, None)]
