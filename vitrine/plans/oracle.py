"""Independent SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the canonical tables from the driver's tables with
CTEs (the SQL twin of ``vitrine.sources.adapter``) and then states what the
operator means in its own relational words.  Money sums are cast to the Spark result types; NULL ordering and string
concatenation are spelled out (``||`` propagates NULL like SQL CONCAT).
"""

from __future__ import annotations

ADAPTER_CTES = """
s_count AS (SELECT count(*) AS n FROM supplier),
users AS (
  SELECT c_custkey AS user_id, 'Customer' AS fname, substr(c_name, 10) AS lname,
         CASE WHEN c_custkey % 211 = 0 THEN NULL
              WHEN c_custkey % 97 = 0 THEN 'Dup' || CAST(c_custkey % 3 AS VARCHAR) || '@Gallery.Test'
              ELSE 'customer' || CAST(c_custkey AS VARCHAR) || '@gallery.test' END AS email,
         CASE WHEN c_custkey % 101 = 0 THEN 'Admin' ELSE 'Customer' END AS role,
         '+' || CAST(c_custkey AS VARCHAR) || repeat('0', CASE WHEN c_custkey % 499 = 0 THEN 25 ELSE 6 END) AS contact_no,
         'Nation ' || CAST(c_nationkey AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS bio,
         TIMESTAMP '2023-01-01 00:00:00' + to_minutes(c_custkey) AS created_at
  FROM customer
  UNION ALL
  SELECT s_suppkey + 10000000, 'Supplier', substr(s_name, 10),
         CASE WHEN s_suppkey % 50 = 0 THEN 'dup' || CAST(s_suppkey % 3 AS VARCHAR) || '@gallery.test'
              ELSE 'supplier' || CAST(s_suppkey AS VARCHAR) || '@gallery.test' END,
         'Artist', NULL, 'Nation ' || CAST(s_nationkey AS VARCHAR), 'Works as ' || s_name, TIMESTAMP '2023-01-01 00:00:00' + to_minutes(s_suppkey)
  FROM supplier
),
museum AS (
  SELECT CAST(n_nationkey AS INTEGER) AS museum_id, n_name AS name, r_name AS location,
         CAST(100 + 10 * n_nationkey AS INTEGER) AS capacity, TIMESTAMP '2023-01-01 00:00:00' AS created_at
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
),
artifact AS (
  SELECT p_partkey AS artifact_id,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % (SELECT n FROM s_count) + 10000000 END AS artist_id,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 23 AS INTEGER) END AS museum_id,
         p_name AS title,
         repeat(p_brand || ' ' || p_name || '. ', CAST(p_size % 8 AS BIGINT)) AS description,
         p_type AS type,
         CASE WHEN p_partkey % 3 <> 0 THEN 'Grade ' || CAST(p_size % 5 AS VARCHAR) END AS quality,
         repeat(p_brand, CASE WHEN p_partkey % 997 = 0 THEN 40 ELSE 1 END) AS owner,
         CAST(floor(p_retailprice) AS DECIMAL(12,2)) AS price,
         CAST(p_size - 1 AS INTEGER) AS quantity,
         CASE WHEN p_partkey % 5 = 0 THEN NULL
              ELSE 'uploads/' || CAST(p_partkey AS VARCHAR) ||
                   CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.gif' ELSE '' END
         END AS image,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(p_partkey) AS created_at
  FROM part
  UNION ALL
  SELECT s_suppkey + 20000000, s_suppkey + 10000000, CAST(s_nationkey AS INTEGER), 'study ' || substr(s_name, 10), NULL,
         'Other', NULL, s_name, CAST(floor(abs(s_acctbal)) AS DECIMAL(12,2)), CAST(s_suppkey % 4 AS INTEGER), NULL,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey)
  FROM supplier
),
exhibition AS (
  SELECT o_orderkey AS exhibition_id,
         'Exhibition ' || CAST(o_orderkey AS VARCHAR) AS title,
         'Theme ' || o_orderstatus AS theme,
         CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 3 AS INTEGER) END AS end_date,
         'Priority ' || o_orderpriority AS description,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 25 AS INTEGER) END AS museum_id,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 30 + 10 AS INTEGER) END AS capacity,
         CASE WHEN o_orderkey % 31 = 0 THEN o_custkey
              ELSE o_orderkey % ((SELECT n FROM s_count) + 1) + 10000000 END AS artist_id,
         o_orderdate AS created_at
  FROM orders
),
purchase AS (
  SELECT l_orderkey * 100 + row_number() OVER (
           PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax
         ) AS purchase_id,
         o_custkey AS customer_id, l_partkey AS artifact_id, l_shipdate AS purchase_ts,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN l_linenumber = 7 THEN 'Voucher'
              ELSE CASE l_linenumber % 4 WHEN 0 THEN 'Card' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Cash' ELSE 'NetBanking' END
         END AS payment_method
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
ex_count AS (SELECT count(*) // 60 + 1 AS n FROM events),
attends AS (
  SELECT user_id AS customer_id, event_id % (SELECT n FROM ex_count) AS exhibition_id, min(ts) AS attended_at
  FROM events WHERE event_type = 'signup' GROUP BY 1, 2
),
visits AS (
  SELECT c_custkey AS customer_id, CAST(c_nationkey AS INTEGER) AS museum_id,
         DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS visit_date, c_mktsegment AS purpose
  FROM customer
),
virtual_record AS (
  SELECT p_partkey + 1 AS record_id, p_partkey AS artifact_id, p_brand AS service,
         'vr/' || CAST(p_partkey AS VARCHAR) AS link,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(p_partkey) AS created_at
  FROM part
),
exhibition_artifact AS (
  SELECT l_orderkey AS exhibition_id, l_partkey AS artifact_id, CAST(l_linenumber AS INTEGER) AS display_order
  FROM lineitem
)"""


def with_adapter(body: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH <adapter CTEs>[, extra CTEs] <body>``."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    ctes = ADAPTER_CTES + ("," + extra if extra.strip() else "")
    return f"{head}{ctes}\n{body.strip()}"


NAME = "{a}.fname || ' ' || {a}.lname"


def name(alias: str) -> str:
    return NAME.format(a=alias)
