"""What the change operators (W1-W5) change, as keys that go and rows that come.

``Store.commit`` writes a delta by rewriting the folders it touches.  Child tables
are scanned for their key columns to find cascades; nothing else is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.columns import all_of
from vitrine.operators.changes import max_id
from vitrine.sources import schema as S
from vitrine.sources.snapshots import Delta
from vitrine.sources.tables import Gallery


def _marked(df: DataFrame, column: str, ids: DataFrame, mark: str) -> DataFrame:
    """``df`` with a column ``mark``, true where ``column`` is among ``ids``."""
    ids = ids.select(F.col(ids.columns[0]).cast(df.schema[column].dataType).alias(column)).distinct()
    return df.join(ids.withColumn(mark, F.lit(True)), column, "left").withColumn(mark, F.col(mark).isNotNull())


def append_delta(g: Gallery, table: str, after: DataFrame) -> Delta:
    """The rows of ``after`` (the table that ``append_artifacts`` or
    ``append_exhibitions`` gives) that ``g`` lacks: their keys follow its largest."""
    key = S.PRIMARY_KEYS[table][0]
    return Delta(written={table: after.filter(F.col(key) > max_id(g.table(table), key))})


def delete_delta(g: Gallery, report: DataFrame) -> Delta:
    """From the report of ``delete_artifacts`` or ``owner_delete_artifacts``.
    Deleted artifacts go with their virtual records and exhibition links; archived
    ones come back with quantity 0."""
    said = F.col("action" if "action" in report.columns else "outcome")
    gone = report.filter(said == "deleted").select("artifact_id").distinct()
    archived = report.filter(said == "archived").select("artifact_id").distinct()
    delta = Delta(removed={"artifact": gone})
    for child in ("virtual_record", "exhibition_artifact"):
        delta.removed[child] = g.table(child).join(gone, "artifact_id", "left_semi").select(*S.PRIMARY_KEYS[child])
    delta.written["artifact"] = g.artifact.join(archived, "artifact_id", "left_semi").withColumn("quantity", F.lit(0))
    return delta


def cascade_delta(g: Gallery, users: DataFrame | None = None, museums: DataFrame | None = None,
                  exhibitions: DataFrame | None = None) -> Delta:
    """The ids of each DataFrame's first column go, rows that a CASCADE key ties
    to them go too, and SET NULL keys to them become NULL."""
    asked = {t: ids for t, ids in (("users", users), ("museum", museums), ("exhibition", exhibitions)) if ids is not None}
    delta = Delta()
    for table in S.SCHEMAS:
        df, goes, nulls = g.table(table), [], {}
        if table in asked:
            df = _marked(df, S.PRIMARY_KEYS[table][0], asked[table], "_own")
            goes.append(F.col("_own"))
        for child, column, parent, _, action in S.FOREIGN_KEYS:
            if child != table or parent not in asked:
                continue
            mark = f"_{column}"
            df = _marked(df, column, asked[parent], mark)
            if action == "cascade":
                goes.append(F.col(mark))
            else:
                nulls[column] = F.col(mark)
        away = ~all_of(~c for c in goes) if goes else F.lit(False)
        if goes:
            delta.removed[table] = df.filter(away).select(*S.PRIMARY_KEYS[table])
        if nulls:
            delta.written[table] = df.filter(~away & ~all_of(~c for c in nulls.values())).withColumns(
                {c: F.when(~mark, F.col(c)) for c, mark in nulls.items()}).select(*S.SCHEMAS[table].fieldNames())
    return delta


def rekey_delta(g: Gallery, user_map: DataFrame | None = None, museum_map: DataFrame | None = None,
                artifact_map: DataFrame | None = None, exhibition_map: DataFrame | None = None) -> Delta:
    """Rows that hold an old id, as key or reference, go, and come with the new one."""
    maps = {"users": user_map, "museum": museum_map, "artifact": artifact_map, "exhibition": exhibition_map}
    delta = Delta()
    for table in S.SCHEMAS:
        columns = [(S.PRIMARY_KEYS[table][0], table)] if maps.get(table) is not None else []
        columns += [(c, parent) for child, c, parent, _, _ in S.FOREIGN_KEYS if child == table and maps.get(parent) is not None]
        if not columns:
            continue
        df = g.table(table)
        for column, parent in columns:
            m = maps[parent].select(F.col("old_id").alias(column), F.col("new_id").alias(f"_new_{column}"))
            df = df.join(m, column, "left")
        hit = df.filter(~all_of(F.col(f"_new_{c}").isNull() for c, _ in columns))
        delta.removed[table] = hit.select(*S.PRIMARY_KEYS[table])
        delta.written[table] = hit.withColumns({
            c: F.coalesce(F.col(f"_new_{c}"), F.col(c)).cast(S.SCHEMAS[table][c].dataType) for c, _ in columns}).select(
            *S.SCHEMAS[table].fieldNames())
    return delta
