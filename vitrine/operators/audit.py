"""Declared constraints as data-quality jobs.

Every rule returns rows ``(table_name, rule, key, detail)``; ``key`` is the
offending row's primary key as text (``a|b`` for composite keys, ``NULL`` for
a missing part).  Row-local rules (NOT NULL, CHECK, domains, lengths, image
names) of one table are evaluated in a single scan: one array of
``when(violated, struct(rule, detail))`` per row, exploded and filtered.
Key, uniqueness and foreign-key rules need a shuffle each (aggregate or anti
join); the anti joins let AQE pick broadcast or sort-merge on measured sizes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.columns import image_extension_ok
from vitrine.sources import schema as S
from vitrine.sources.tables import Gallery

OUT_COLUMNS = ["table_name", "rule", "key", "detail"]


def key_text(cols: Iterable[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _empty(g: Gallery) -> DataFrame:
    spark = g.artifact.sparkSession
    return spark.createDataFrame([], "table_name string, rule string, key string, detail string")


def _union(frames: list[DataFrame], g: Gallery) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out if out is not None else _empty(g)


# ----------------------------------------------------------------- C1, C2, C3

def audit_keys(g: Gallery) -> DataFrame:
    """Primary keys are not NULL (one row per such row) and unique (one row
    per repeated key).  Rows with a NULL in the key come from a filter, which
    reaches the scan; only the others are grouped."""
    frames = []
    for table, cols in S.PRIMARY_KEYS.items():
        any_null = F.lit(False)
        for c in cols:
            any_null = any_null | F.col(c).isNull()
        frames.append(g.table(table).filter(any_null).select(
            F.lit(table).alias("table_name"), F.lit("pk_null").alias("rule"), key_text(cols).alias("key"), F.lit("").alias("detail")))
        counted = g.table(table).filter(~any_null).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        frames.append(counted.select(F.lit(table).alias("table_name"), F.lit("pk_duplicate").alias("rule"), key_text(cols).alias("key"),
                                     F.col("_n").cast("string").alias("detail")))
    return _union(frames, g)


def audit_unique(g: Gallery) -> DataFrame:
    """Unique columns; many NULLs allowed; comparison ignores case and accents
    (grouping on a case- and accent-insensitive collation)."""
    frames = []
    for table, column in S.UNIQUE_COLUMNS:
        df = g.table(table).filter(F.col(column).isNotNull())
        is_text = dict(df.dtypes)[column] == "string"
        k = F.collate(F.col(column), "UNICODE_CI_AI") if is_text else F.col(column)
        dup = (df.groupBy(k.alias("_k"))
               .agg(F.min(F.col(column).cast("string")).alias("_v"), F.count(F.lit(1)).alias("_n"))
               .filter(F.col("_n") > 1))
        frames.append(dup.select(
            F.lit(table).alias("table_name"), F.lit(f"unique_{column}").alias("rule"),
            F.col("_v").alias("key"), F.col("_n").cast("string").alias("detail")))
    return _union(frames, g)


def audit_foreign_keys(g: Gallery) -> DataFrame:
    """No orphans (a NULL reference is allowed)."""
    frames = []
    for child, column, parent, parent_col, _ in S.FOREIGN_KEYS:
        refs = g.table(parent).select(F.col(parent_col).alias("_ref"))
        c = g.table(child).filter(F.col(column).isNotNull())
        orphans = c.join(refs, c[column] == refs["_ref"], "left_anti")
        frames.append(orphans.select(
            F.lit(child).alias("table_name"), F.lit(f"fk_{column}").alias("rule"),
            key_text(S.PRIMARY_KEYS[child]).alias("key"),
            F.concat(F.lit(f"{column}="), F.col(column).cast("string")).alias("detail")))
    return _union(frames, g)


# ------------------------------------------------------------ row-local rules

def _not_null_rules(table: str) -> list[tuple[str, Column, Column]]:
    return [("not_null", F.col(c).isNull(), F.lit(c)) for c in S.NOT_NULL_COLUMNS.get(table, [])]


def _check_rules(table: str) -> list[tuple[str, Column, Column]]:
    # A CHECK fails only when its condition is FALSE (NULL passes).
    return [(name, F.expr(f"NOT ({cond})") == F.lit(True), F.lit(""))
            for t, name, cond in S.CHECKS if t == table]


def _domain_rules(g: Gallery, table: str) -> list[tuple[str, Column, Column]]:
    domains = {("users", "role"): S.ROLE_DOMAIN, ("artifact", "type"): g.type_domain,
               ("purchase", "payment_method"): S.PAYMENT_DOMAIN}
    rules = []
    for (t, c), values in domains.items():
        if t == table:
            rules.append(("domain", F.col(c).isNotNull() & ~F.col(c).isin(*values),
                          F.concat(F.lit(f"{c}="), F.col(c))))
    for (t, c), limit in S.VARCHAR_LIMITS.items():
        if t == table:
            rules.append(("length", F.char_length(c) > limit, F.lit(c)))
    return rules


def _image_rules(table: str) -> list[tuple[str, Column, Column]]:
    if table != "artifact":
        return []
    return [("image_extension", F.col("image").isNotNull() & ~image_extension_ok("image"), F.col("image"))]


def _row_rules(g: Gallery, families: Iterable[str]) -> DataFrame:
    frames = []
    for table in S.SCHEMAS:
        rules = []
        if "not_null" in families:
            rules += _not_null_rules(table)
        if "checks" in families:
            rules += _check_rules(table)
        if "domains" in families:
            rules += _domain_rules(g, table)
        if "images" in families:
            rules += _image_rules(table)
        if not rules:
            continue
        hits = F.array(*[F.when(F.coalesce(cond, F.lit(False)),
                                F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
                         for rule, cond, detail in rules])
        df = g.table(table)
        frames.append(df.select(key_text(S.PRIMARY_KEYS[table]).alias("key"), F.explode(hits).alias("_h"))
                      .filter(F.col("_h").isNotNull())
                      .select(F.lit(table).alias("table_name"), "_h.rule", "key", "_h.detail"))
    return _union(frames, g)


def audit_not_null(g: Gallery) -> DataFrame:
    """C4: NOT NULL columns."""
    return _row_rules(g, ["not_null"])


def audit_checks(g: Gallery) -> DataFrame:
    """CHECK constraints; a NULL result passes."""
    return _row_rules(g, ["checks"])


def audit_domains(g: Gallery) -> DataFrame:
    """ENUM domains and VARCHAR lengths."""
    return _row_rules(g, ["domains"])


def audit_images(g: Gallery) -> DataFrame:
    """Image names need a dot and an allowed extension (any case)."""
    return _row_rules(g, ["images"])


def audit(g: Gallery) -> DataFrame:
    """All rules; row-local rules share one scan per table."""
    return _union([audit_keys(g), audit_unique(g), audit_foreign_keys(g),
                   _row_rules(g, ["not_null", "checks", "domains", "images"])], g)
