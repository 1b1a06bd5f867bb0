"""Canonical table schemas and value domains.

Every table is declared here once; nothing is inferred at run time.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the source application's domains, in the
# declared order (ENUM columns sort by position in this list, not by spelling).
ROLE_DOMAIN = ["Customer", "Artist", "Admin"]
ARTIFACT_TYPE_DOMAIN = ["Painting", "Sculpture", "Digital", "Photography", "Other"]
PAYMENT_DOMAIN = ["Card", "UPI", "Cash", "NetBanking"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp"]
# Declared VARCHAR lengths, by (table, column).
VARCHAR_LIMITS = {
    ("users", "fname"): 60,
    ("users", "lname"): 60,
    ("users", "email"): 150,
    ("users", "contact_no"): 20,
    ("museum", "name"): 150,
    ("museum", "location"): 200,
    ("artifact", "title"): 150,
    ("artifact", "quality"): 50,
    ("artifact", "owner"): 150,
    ("artifact", "image"): 255,
    ("exhibition", "title"): 150,
    ("exhibition", "theme"): 150,
    ("virtual_record", "service"): 150,
    ("virtual_record", "link"): 255,
    ("visits", "purpose"): 150,
}

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("fname", T.StringType()),
    T.StructField("lname", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("contact_no", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("bio", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

MUSEUM = T.StructType([
    T.StructField("museum_id", T.IntegerType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("capacity", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ARTIFACT = T.StructType([
    T.StructField("artifact_id", T.LongType(), False),
    T.StructField("artist_id", T.LongType()),
    T.StructField("museum_id", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("quality", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("price", T.DecimalType(12, 2)),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("image", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

EXHIBITION = T.StructType([
    T.StructField("exhibition_id", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("theme", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("museum_id", T.IntegerType()),
    T.StructField("capacity", T.IntegerType()),
    T.StructField("artist_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

PURCHASE = T.StructType([
    T.StructField("purchase_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType()),
    T.StructField("artifact_id", T.LongType()),
    T.StructField("purchase_ts", T.TimestampNTZType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("total_amount", T.DecimalType(12, 2)),
    T.StructField("payment_method", T.StringType()),
])

ATTENDS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("exhibition_id", T.LongType()),
    T.StructField("attended_at", T.TimestampNTZType()),
])

VISITS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("museum_id", T.IntegerType()),
    T.StructField("visit_date", T.DateType()),
    T.StructField("purpose", T.StringType()),
])

VIRTUAL_RECORD = T.StructType([
    T.StructField("record_id", T.LongType(), False),
    T.StructField("artifact_id", T.LongType()),
    T.StructField("service", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

EXHIBITION_ARTIFACT = T.StructType([
    T.StructField("exhibition_id", T.LongType()),
    T.StructField("artifact_id", T.LongType()),
    T.StructField("display_order", T.IntegerType()),
])

SCHEMAS = {
    "users": USERS,
    "museum": MUSEUM,
    "artifact": ARTIFACT,
    "exhibition": EXHIBITION,
    "purchase": PURCHASE,
    "attends": ATTENDS,
    "visits": VISITS,
    "virtual_record": VIRTUAL_RECORD,
    "exhibition_artifact": EXHIBITION_ARTIFACT,
}

# Fixed values, as the source application declares them, from here to the end.
# Primary keys (C1) and unique columns.
PRIMARY_KEYS = {
    "users": ["user_id"],
    "museum": ["museum_id"],
    "artifact": ["artifact_id"],
    "exhibition": ["exhibition_id"],
    "purchase": ["purchase_id"],
    "attends": ["customer_id", "exhibition_id"],
    "visits": ["customer_id", "museum_id"],
    "virtual_record": ["record_id"],
    "exhibition_artifact": ["exhibition_id", "artifact_id"],
}
UNIQUE_COLUMNS = [("users", "email"), ("museum", "name"), ("virtual_record", "artifact_id")]

# Foreign keys: (child table, child column, parent table, parent column, on delete).
FOREIGN_KEYS = [
    ("artifact", "artist_id", "users", "user_id", "set_null"),
    ("artifact", "museum_id", "museum", "museum_id", "set_null"),
    ("exhibition", "museum_id", "museum", "museum_id", "set_null"),
    ("exhibition", "artist_id", "users", "user_id", "set_null"),
    ("virtual_record", "artifact_id", "artifact", "artifact_id", "cascade"),
    ("exhibition_artifact", "exhibition_id", "exhibition", "exhibition_id", "cascade"),
    ("exhibition_artifact", "artifact_id", "artifact", "artifact_id", "cascade"),
    ("attends", "customer_id", "users", "user_id", "cascade"),
    ("attends", "exhibition_id", "exhibition", "exhibition_id", "cascade"),
    ("visits", "customer_id", "users", "user_id", "cascade"),
    ("visits", "museum_id", "museum", "museum_id", "cascade"),
    ("purchase", "customer_id", "users", "user_id", "cascade"),
    ("purchase", "artifact_id", "artifact", "artifact_id", "restrict"),
]

NOT_NULL_COLUMNS = {
    "users": ["fname", "lname", "email"],
    "museum": ["name"],
    "artifact": ["title", "price"],
    "exhibition": ["title"],
    "purchase": ["customer_id", "artifact_id"],
}

# CHECK constraints as SQL boolean expressions; a NULL result passes.
CHECKS = [
    ("users", "names_not_empty", "char_length(fname) > 0 AND char_length(lname) > 0"),
    ("museum", "capacity_non_negative", "capacity >= 0"),
    ("artifact", "price_non_negative", "price >= 0"),
    ("artifact", "quantity_non_negative", "quantity >= 0"),
    ("exhibition", "end_after_start", "end_date IS NULL OR end_date >= start_date"),
    ("exhibition_artifact", "display_order_positive", "display_order > 0"),
    ("purchase", "quantity_positive", "quantity > 0"),
]
