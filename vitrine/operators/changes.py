"""Bulk change application (W1-W7): snapshot in, snapshot out.

No table format with MERGE is assumed: every operator returns new DataFrames
(and a change log or outcome table); the caller writes them to a new path.
Referential actions (CASCADE, SET NULL, RESTRICT, ON UPDATE CASCADE) are anti
joins, left joins and ``when`` projections.  New keys are dense and follow a
stable order without a single-partition window (see ``assign_ids``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.columns import image_extension_ok, try_int
from vitrine.operators import admission
from vitrine.sources import schema as S
from vitrine.sources.tables import Gallery

_LOW_BITS = (1 << 33) - 1


# ------------------------------------------------------------------------- W6

def assign_ids(df: DataFrame, order_cols: Sequence[str], start: Column | int, id_col: str = "id") -> DataFrame:
    """Ids ``start + 1, start + 2, ...`` following the (unique) order columns.

    Rows are range-partitioned and sorted on the order columns; each row gets
    (partition, position) from ``monotonically_increasing_id``; the result is
    checkpointed so both are fixed once; a per-partition count (one row per
    partition, so a bounded broadcast) gives each partition its offset."""
    ranged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (ranged.join(F.broadcast(offsets), "_pid", "inner")
            .withColumn(id_col, (start_col + F.col("_off") + F.col("_pos") + 1).cast("bigint"))
            .drop("_mid", "_pid", "_pos", "_off"))


def max_id(df: DataFrame, column: str) -> Column:
    """Largest existing key (0 for an empty table), as a scalar subquery."""
    return df.agg(F.coalesce(F.max(column), F.lit(0))).scalar()


# ------------------------------------------------------------------------- W7

def defaults(table: str, now: Column | None = None) -> dict[str, Column]:
    """Declared column defaults of a table."""
    now = now if now is not None else F.localtimestamp().cast("timestamp_ntz")
    # Fixed values, as the source application declares them.
    d = {
        "users": {"role": F.lit("Customer"), "created_at": now},
        "museum": {"capacity": F.lit(100), "created_at": now},
        "artifact": {"type": F.lit("Other"), "price": F.lit(0), "quantity": F.lit(0), "created_at": now},
        "exhibition": {"capacity": F.lit(200), "created_at": now},
        "virtual_record": {"created_at": now},
        "exhibition_artifact": {"display_order": F.lit(1)},
        "attends": {"attended_at": now},
        "visits": {"visit_date": F.to_date(now)},
        "purchase": {"purchase_ts": now, "quantity": F.lit(1), "payment_method": F.lit("Card")},
    }
    return d.get(table, {})


def column_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Shape rows into ``table``'s schema; a column *absent* from the input
    takes its default (NULL when it has none); a present NULL stays NULL."""
    dflt = defaults(table, now)
    cols = []
    for field in S.SCHEMAS[table].fields:
        if field.name in df.columns:
            value = F.col(field.name)
        else:
            value = dflt.get(field.name, F.lit(None))
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)


# ------------------------------------------------------------------------- W1

def _with_blank_fields(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Form fields absent from the input are NULL (not sent)."""
    for name in fields:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return raw


def _title_missing() -> tuple[Column, Column]:
    return F.col("title").isNull(), F.lit("title_missing")


def _title_too_long(table: str) -> tuple[Column, Column]:
    return F.char_length("title") > S.VARCHAR_LIMITS[(table, "title")], F.lit("title_too_long")


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def append_artifacts(g: Gallery, raw: DataFrame, order_cols: Sequence[str],
                     now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Upload form rows (artist_id, title, description, type, price, quantity,
    museum, image as text) -> (new artifact snapshot, outcome per raw row).

    Title and description are trimmed; blank price/quantity mean 0; blank museum
    means none; a missing type is 'Other'; an image with a bad extension is
    dropped.  Rows that the database would refuse (missing or over-long title, a
    type outside the domain, negative numbers, an unknown artist or museum) get a
    ``reason`` and no id; an artist may be NULL."""
    raw = _with_blank_fields(raw, ["description", "type", "price", "quantity", "museum", "image"])
    price_txt, qty_txt, museum_txt = _blank("price"), _blank("quantity"), _blank("museum")
    price = F.when(price_txt.isNull(), F.lit(0).cast("decimal(12,2)")).otherwise(price_txt.try_cast("decimal(12,2)"))
    qty = F.when(qty_txt.isNull(), F.lit(0)).otherwise(try_int("quantity"))
    museum_id = try_int("museum")
    clean = raw.select(
        *order_cols,
        F.col("artist_id").cast("bigint").alias("artist_id"),
        museum_id.alias("museum_id"),
        F.trim("title").alias("title"),
        F.trim("description").alias("description"),
        F.coalesce(F.col("type"), F.lit("Other")).alias("type"),
        price.alias("price"),
        qty.alias("quantity"),
        F.when(image_extension_ok("image"), F.col("image")).alias("image"),
        (museum_txt.isNotNull() & museum_id.isNull()).alias("_bad_museum"),
    )
    known = g.museum.select("museum_id", F.lit(True).alias("_museum_ok"))
    artists = g.users.select(F.col("user_id").alias("artist_id"), F.lit(True).alias("_artist_ok"))
    j = clean.join(known, "museum_id", "left").join(artists, "artist_id", "left")
    reason = (F.when(F.col("price").isNull(), F.lit("bad_price"))
              .when(F.col("quantity").isNull(), F.lit("bad_quantity"))
              .when(F.col("_bad_museum"), F.lit("bad_museum"))
              .when(*_title_missing()).when(*_title_too_long("artifact"))
              .when(~F.col("type").isin(*g.type_domain), F.lit("bad_type"))
              .when(F.col("price") < 0, F.lit("price_negative"))
              .when(F.col("quantity") < 0, F.lit("quantity_negative"))
              .when(F.col("artist_id").isNotNull() & F.col("_artist_ok").isNull(), F.lit("artist_not_found"))
              .when(F.col("museum_id").isNotNull() & F.col("_museum_ok").isNull(), F.lit("museum_not_found")))
    judged = j.withColumn("reason", reason).drop("_bad_museum", "_museum_ok", "_artist_ok")
    ok = assign_ids(judged.filter(F.col("reason").isNull()), order_cols, max_id(g.artifact, "artifact_id"),
                    "artifact_id")
    ok = ok.withColumn("created_at", now if now is not None else F.localtimestamp().cast("timestamp_ntz"))
    new_rows = column_defaults(ok, "artifact")
    outcome = ok.drop("created_at").unionByName(
        judged.filter(F.col("reason").isNotNull()).withColumn("artifact_id", F.lit(None).cast("bigint")))
    return g.artifact.unionByName(new_rows), outcome


# ------------------------------------------------------------------------- W2

def append_exhibitions(g: Gallery, raw: DataFrame, order_cols: Sequence[str],
                       now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Exhibition form rows (title, theme, start, end, capacity, museum as
    text, artist_id) -> (new exhibition snapshot, outcome per raw row).

    Checks: form parsing (capacity blank means 0, museum required), title present
    and short enough, organiser (A3), end not before start, museum exists."""
    raw = _with_blank_fields(raw, ["theme", "start", "end", "capacity", "museum"])
    start, end = _blank("start"), _blank("end")
    cap_txt = _blank("capacity")
    capacity = F.when(cap_txt.isNull(), F.lit(0)).otherwise(try_int("capacity"))
    parsed = raw.select(
        *order_cols,
        F.trim("title").alias("title"), F.trim("theme").alias("theme"),
        start.try_cast("date").alias("start_date"), end.try_cast("date").alias("end_date"),
        ((start.isNotNull() & start.try_cast("date").isNull()) | (end.isNotNull() & end.try_cast("date").isNull()))
        .alias("_bad_date"),
        try_int("museum").alias("museum_id"),
        capacity.alias("capacity"),
        F.col("artist_id").cast("bigint").alias("artist_id"),
    )
    organiser = admission.validate_exhibitions(parsed, g.users).withColumnRenamed("reason", "_organiser")
    known = g.museum.select("museum_id", F.lit(True).alias("_museum_ok"))
    j = organiser.join(known, "museum_id", "left")
    reason = (F.when(F.col("capacity").isNull(), F.lit("bad_capacity"))
              .when(F.col("museum_id").isNull(), F.lit("bad_museum"))
              .when(F.col("_bad_date"), F.lit("bad_date"))
              .when(*_title_missing()).when(*_title_too_long("exhibition"))
              .when(F.col("_organiser").isNotNull(), F.col("_organiser"))
              .when(F.col("end_date") < F.col("start_date"), F.lit("end_before_start"))
              .when(F.col("_museum_ok").isNull(), F.lit("museum_not_found")))
    judged = j.withColumn("reason", reason).drop("_bad_date", "_organiser", "_museum_ok", "accepted")
    ok = assign_ids(judged.filter(F.col("reason").isNull()), order_cols,
                    max_id(g.exhibition, "exhibition_id"), "exhibition_id")
    new_rows = column_defaults(ok, "exhibition", now)
    outcome = ok.unionByName(
        judged.filter(F.col("reason").isNotNull()).withColumn("exhibition_id", F.lit(None).cast("bigint")))
    return g.exhibition.unionByName(new_rows), outcome


# ---------------------------------------------------------------------- W3, W3b

def _flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(keys.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False)))


def _remove_artifacts(g: Gallery, gone: DataFrame) -> Gallery:
    """Delete artifacts and CASCADE to their virtual records and exhibition links."""
    ids = gone.select("artifact_id").distinct()
    return g.with_tables(
        artifact=g.artifact.join(ids, "artifact_id", "left_anti"),
        virtual_record=g.virtual_record.join(ids, "artifact_id", "left_anti"),
        exhibition_artifact=g.exhibition_artifact.join(ids, "artifact_id", "left_anti"),
    )


def delete_artifacts(g: Gallery, ids: DataFrame) -> tuple[Gallery, DataFrame]:
    """Delete artifacts; one with purchases cannot be deleted (RESTRICT) and
    is archived instead (quantity 0).  Returns (new gallery, report of
    artifact_id, action in deleted / archived / not_found)."""
    asked = ids.select("artifact_id").distinct()
    sold = g.purchase.select("artifact_id").distinct()
    report = (_flag(_flag(asked, g.artifact, "artifact_id", "_exists"), sold, "artifact_id", "_sold")
              .select("artifact_id",
                      F.when(~F.col("_exists"), F.lit("not_found"))
                      .when(F.col("_sold"), F.lit("archived"))
                      .otherwise(F.lit("deleted")).alias("action")))
    gone = report.filter(F.col("action") == "deleted")
    archived = report.filter(F.col("action") == "archived").select("artifact_id", F.lit(True).alias("_arch"))
    after = _remove_artifacts(g, gone)
    artifact = (after.artifact.join(archived, "artifact_id", "left")
                .withColumn("quantity", F.when(F.col("_arch"), F.lit(0)).otherwise(F.col("quantity")))
                .drop("_arch").select(*S.SCHEMAS["artifact"].fieldNames()))
    return after.with_tables(artifact=artifact), report


def owner_delete_artifacts(g: Gallery, requests: DataFrame) -> tuple[Gallery, DataFrame]:
    """Delete requests (artifact_id, requester_id, role).  Only the owning
    artist or an admin may delete; sold artifacts are refused (RESTRICT).
    Outcome: not_found, unauthorized, has_purchases or deleted."""
    owners = g.artifact.select("artifact_id", F.col("artist_id").alias("_owner"), F.lit(True).alias("_exists"))
    sold = g.purchase.select("artifact_id").distinct().withColumn("_sold", F.lit(True))
    r = requests.join(owners, "artifact_id", "left").join(sold, "artifact_id", "left")
    allowed = (F.col("role") == "Admin") | ((F.col("role") == "Artist") & (F.col("_owner") == F.col("requester_id")))
    outcome = (F.when(F.col("_exists").isNull(), F.lit("not_found"))
               .when(~F.coalesce(allowed, F.lit(False)), F.lit("unauthorized"))
               .when(F.col("_sold").isNotNull(), F.lit("has_purchases"))
               .otherwise(F.lit("deleted")))
    result = r.select(*requests.columns, outcome.alias("outcome"))
    return _remove_artifacts(g, result.filter(F.col("outcome") == "deleted")), result


# ------------------------------------------------------------------------- W4

def _key(table: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in S.PRIMARY_KEYS[table]])


def cascade_delete(g: Gallery, users: DataFrame | None = None, museums: DataFrame | None = None,
                   exhibitions: DataFrame | None = None) -> tuple[Gallery, DataFrame]:
    """Delete users, museums and exhibitions by id with the declared
    referential actions: CASCADE to attends, visits, purchases and exhibition
    links, SET NULL on artist_id and museum_id.  Cascaded purchases do not
    restock.  Returns (new gallery, change log of table_name, key, action)."""
    spark = g.artifact.sparkSession

    def ids(df: DataFrame | None, dtype: str) -> DataFrame:
        if df is None:
            return spark.createDataFrame([], f"_id {dtype}")
        return df.select(F.col(df.columns[0]).cast(dtype).alias("_id")).distinct()

    u, m, e = ids(users, "bigint"), ids(museums, "int"), ids(exhibitions, "bigint")

    def hit(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
        return df.join(ids.withColumnRenamed("_id", column).withColumn(name, F.lit(True)), column, "left")

    def log(df: DataFrame, table: str, *actions: Column) -> DataFrame:
        """One pass over a table gives all its entries."""
        return df.select(_key(table).alias("key"), F.explode(F.array_compact(F.array(*actions))).alias("action")).select(
            F.lit(table).alias("table_name"), "key", "action")

    def marked(name: str, action: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.lit(action))

    # Parent rows.
    users_t = hit(g.users, "user_id", u, "_del")
    museum_t = hit(g.museum, "museum_id", m, "_del")
    ex_t = hit(hit(hit(g.exhibition, "exhibition_id", e, "_del"), "artist_id", u, "_a"), "museum_id", m, "_m")
    keep_ex = ex_t.filter(F.col("_del").isNull())
    art_t = hit(hit(g.artifact, "artist_id", u, "_a"), "museum_id", m, "_m")
    # CASCADE children.
    att = hit(hit(g.attends, "customer_id", u, "_c"), "exhibition_id", e, "_e")
    att_gone = F.col("_c").isNotNull() | F.col("_e").isNotNull()
    vis = hit(hit(g.visits, "customer_id", u, "_c"), "museum_id", m, "_m")
    vis_gone = F.col("_c").isNotNull() | F.col("_m").isNotNull()
    pur = hit(g.purchase, "customer_id", u, "_c")
    ea = hit(g.exhibition_artifact, "exhibition_id", e, "_e")
    stays = F.col("_del").isNull()
    logs = [
        log(users_t, "users", marked("_del", "deleted")),
        log(museum_t, "museum", marked("_del", "deleted")),
        log(ex_t, "exhibition", marked("_del", "deleted"), F.when(stays, marked("_a", "set_null:artist_id")),
            F.when(stays, marked("_m", "set_null:museum_id"))),
        log(art_t, "artifact", marked("_a", "set_null:artist_id"), marked("_m", "set_null:museum_id")),
        log(att, "attends", F.when(att_gone, F.lit("deleted"))),
        log(vis, "visits", F.when(vis_gone, F.lit("deleted"))),
        log(pur, "purchase", marked("_c", "deleted")),
        log(ea, "exhibition_artifact", marked("_e", "deleted")),
    ]

    def cols(t):
        return S.SCHEMAS[t].fieldNames()

    new = g.with_tables(
        users=users_t.filter(F.col("_del").isNull()).select(*cols("users")),
        museum=museum_t.filter(F.col("_del").isNull()).select(*cols("museum")),
        exhibition=keep_ex.withColumn("artist_id", F.when(F.col("_a").isNull(), F.col("artist_id")))
        .withColumn("museum_id", F.when(F.col("_m").isNull(), F.col("museum_id"))).select(*cols("exhibition")),
        artifact=art_t.withColumn("artist_id", F.when(F.col("_a").isNull(), F.col("artist_id")))
        .withColumn("museum_id", F.when(F.col("_m").isNull(), F.col("museum_id"))).select(*cols("artifact")),
        attends=att.filter(~att_gone).select(*cols("attends")),
        visits=vis.filter(~vis_gone).select(*cols("visits")),
        purchase=pur.filter(F.col("_c").isNull()).select(*cols("purchase")),
        exhibition_artifact=ea.filter(F.col("_e").isNull()).select(*cols("exhibition_artifact")),
    )
    changes = logs[0]
    for part in logs[1:]:
        changes = changes.unionByName(part)
    return new, changes


# ------------------------------------------------------------------------- W5

def rekey(g: Gallery, user_map: DataFrame | None = None, museum_map: DataFrame | None = None,
          artifact_map: DataFrame | None = None, exhibition_map: DataFrame | None = None) -> tuple[Gallery, DataFrame]:
    """ON UPDATE CASCADE.  Each map has (old_id, new_id); the parent key and
    every referencing column take the new value.  Returns (new gallery, change
    log of table_name, key (before), column_name, old_value, new_value)."""
    maps = {"users": user_map, "museum": museum_map, "artifact": artifact_map, "exhibition": exhibition_map}
    parent_key = {"users": "user_id", "museum": "museum_id", "artifact": "artifact_id",
                  "exhibition": "exhibition_id"}
    targets: dict[str, list[tuple[str, str]]] = {}
    for parent, column in parent_key.items():
        if maps[parent] is not None:
            targets.setdefault(parent, []).append((column, parent))
    for child, column, parent, _, _ in S.FOREIGN_KEYS:
        if maps[parent] is not None:
            targets.setdefault(child, []).append((column, parent))

    if not targets:
        spark = g.users.sparkSession
        return g, spark.createDataFrame(
            [], "table_name string, key string, column_name string, old_value bigint, new_value bigint")
    tables, logs = {}, []
    for table, changes in targets.items():
        df = g.table(table).withColumn("_key", _key(table))
        for column, parent in changes:
            mp = maps[parent].select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
            df = df.join(mp, column, "left")
            logs.append(df.filter(F.col("_new").isNotNull()).select(
                F.lit(table).alias("table_name"), F.col("_key").alias("key"), F.lit(column).alias("column_name"),
                F.col(column).cast("bigint").alias("old_value"), F.col("_new").cast("bigint").alias("new_value")))
            df = df.withColumn(column, F.coalesce(F.col("_new"), F.col(column)).cast(
                S.SCHEMAS[table][column].dataType)).drop("_new")
        tables[table] = df.select(*S.SCHEMAS[table].fieldNames())
    log = logs[0]
    for part in logs[1:]:
        log = log.unionByName(part)
    return g.with_tables(**tables), log
