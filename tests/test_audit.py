"""Constraint audits (C1-C7) on the sample data with planted violations."""

import datetime as dt
from decimal import Decimal as D

from conftest import TS, fixture_rows, rows

from vitrine.operators import audit as C
from vitrine.sources.tables import from_rows


def test_clean_fixture_has_no_findings(tiny):
    assert C.audit(tiny).count() == 0


def test_planted_violations(spark):
    data = fixture_rows()
    d = D
    data["users"] += [
        (6, "Élodie", "X", "MARA@NORTH.EXAMPLE", "Curator", "0" * 21, None, None, TS),   # duplicate e-mail (case), bad role
        (6, "", "Y", None, "Customer", None, None, None, TS),                  # duplicate key, empty name, NULL e-mail
    ]
    data["artifact"] += [
        (7, 42, 9, "T" * 151, None, "Pottery", "q" * 51, "o" * 151, d("-1.00"), -2, "img.GIF", TS),  # orphans, checks, domain, length
        (8, None, None, "Ok", None, "Other", None, None, d("1.00"), 0, "noext", TS),
        (9, None, None, "Ok", None, "Other", None, None, d("1.00"), 0, "a.Webp", TS),
    ]
    data["exhibition"].append((4, "Backwards", None, dt.date(2025, 5, 2), dt.date(2025, 5, 1), None, 1, 10, 1, TS))
    data["attends"].append((3, 1, TS))  # repeated pair
    data["purchase"].append((9, 99, 1, TS, 0, d("0.00"), "Cheque"))
    g = from_rows(spark, data)
    found = set(rows(C.audit(g)))
    expected = {
        ("users", "pk_duplicate", "6", "2"),
        ("users", "unique_email", "MARA@NORTH.EXAMPLE", "2"),
        ("users", "length", "6", "contact_no"),
        ("users", "not_null", "6", "email"),
        ("users", "names_not_empty", "6", ""),
        ("users", "domain", "6", "role=Curator"),
        ("artifact", "fk_artist_id", "7", "artist_id=42"),
        ("artifact", "fk_museum_id", "7", "museum_id=9"),
        ("artifact", "price_non_negative", "7", ""),
        ("artifact", "quantity_non_negative", "7", ""),
        ("artifact", "domain", "7", "type=Pottery"),
        ("artifact", "length", "7", "title"),
        ("artifact", "length", "7", "quality"),
        ("artifact", "length", "7", "owner"),
        ("artifact", "image_extension", "8", "noext"),
        ("exhibition", "end_after_start", "4", ""),
        ("attends", "pk_duplicate", "3|1", "2"),
        ("purchase", "fk_customer_id", "9", "customer_id=99"),
        ("purchase", "quantity_positive", "9", ""),
        ("purchase", "domain", "9", "payment_method=Cheque"),
    }
    assert expected <= found, expected - found
    assert not any(r[2] == "9" and r[0] == "artifact" for r in found)  # '.Webp' is allowed
    assert ("artifact", "image_extension", "7", "img.GIF") in found


def test_rows_with_null_keys_are_not_gathered(spark):
    """Half the rows have a NULL key: each is a finding, and none is grouped."""
    g = from_rows(spark, fixture_rows())
    loose = g.museum.selectExpr("IF(museum_id > 0, museum_id, NULL) AS museum_id", "name", "location", "capacity", "created_at")
    more = spark.range(5001).selectExpr("IF(id = 0, 1, NULL) AS museum_id", "concat('m', id) AS name", "'x' AS location", "1 AS capacity",
                                        "CAST(NULL AS TIMESTAMP_NTZ) AS created_at")
    found = C.audit_keys(g.with_tables(museum=loose.unionByName(more)))
    assert found.filter("rule = 'pk_null'").count() == 5000
    assert rows(found.filter("rule = 'pk_duplicate'"), "table_name", "key", "detail") == [("museum", "1", "2")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan and "collect_list" not in plan
