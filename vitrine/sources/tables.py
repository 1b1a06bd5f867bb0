"""The set of canonical tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.sources import schema as S


class Gallery:
    """Canonical DataFrames (lazy plans, never data).  A table is built on first
    use, so a query only plans and lists the sources it reads.
    ``type_domain`` is the ENUM order of ``artifact.type``."""

    TABLES = tuple(S.SCHEMAS)

    def __init__(self, type_domain: list[str] | None = None,
                 loaders: dict[str, Callable[[], DataFrame]] | None = None, **tables: DataFrame):
        unknown = set(tables) - set(self.TABLES)
        if unknown:
            raise TypeError(f"unknown tables {sorted(unknown)}")
        self._tables = dict(tables)
        self._loaders = dict(loaders or {})
        self.type_domain = list(type_domain) if type_domain is not None else list(S.ARTIFACT_TYPE_DOMAIN)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._loaders[name]()
        return self._tables[name]

    def with_tables(self, **tables: DataFrame) -> "Gallery":
        merged = {n: t for n, t in self._tables.items()}
        merged.update(tables)
        return Gallery(self.type_domain, self._loaders, **merged)

    def register_views(self, prefix: str = "") -> None:
        """Expose every table as a temp view so the same data can be queried by SQL."""
        for name in self.TABLES:
            self.table(name).createOrReplaceTempView(prefix + name)


for _name in Gallery.TABLES:
    setattr(Gallery, _name, property(lambda self, _n=_name: self.table(_n)))


def from_rows(spark: SparkSession, rows: dict[str, list[tuple]], type_domain=None) -> Gallery:
    """Build a Gallery from literal rows (tests, tiny fixtures); missing tables are empty."""
    frames = {
        name: spark.createDataFrame(rows.get(name, []), schema=S.SCHEMAS[name])
        for name in S.SCHEMAS
    }
    return Gallery(type_domain, **frames)


def read_tables(spark: SparkSession, path: str, type_domain: list[str] | None = None) -> Gallery:
    """Read a Gallery written by :func:`write_tables` (one parquet folder per table)."""
    frames = {
        name: spark.read.parquet(f"{path}/{name}").select(*S.SCHEMAS[name].fieldNames())
        for name in S.SCHEMAS
    }
    return Gallery(type_domain, **frames)


def write_tables(g: Gallery, path: str, mode: str = "errorifexists",
                 partition_by: dict[str, list[str]] | None = None) -> None:
    """Write every table as parquet below ``path`` (a new snapshot, never in
    place).  ``partition_by`` names low-cardinality columns per table (e.g.
    artifact by type) so later scans prune whole folders."""
    partition_by = partition_by or {}
    for name in S.SCHEMAS:
        writer = g.table(name).write.mode(mode)
        if partition_by.get(name):
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{path}/{name}")
