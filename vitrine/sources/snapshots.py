"""Stored galleries that change folder by folder.

A table lies in folders by range of its first key column (``width`` key values
each), a folder's rows sorted by primary key.  A commit rewrites the folders that
hold changed keys into a new snapshot and then writes a manifest, which names for
each table and key range the snapshot to read.  A manifest counts once it has its
``_SUCCESS`` file, so a write that dies leaves the earlier snapshot as it was;
the next commit overwrites what was left behind.  Earlier manifests stay readable.
One writer at a time.

What passes the driver is the manifest, a row per folder, as Spark's own file
listing does; rows never do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import checkpoint_dir
from vitrine.sources import schema as S
from vitrine.sources.tables import Gallery

WIDTH = 1 << 20  # key values a folder
NULL_RANGE = -(1 << 63)  # the folder of rows whose key is NULL
GRAMS = "title_grams"
GRAM_CHARS = 3
MANIFEST = "table_name string, key_range bigint, snapshot int, width bigint"


@dataclass
class Delta:
    """A change of stored tables: the primary keys of rows that go, and whole rows
    that come, which replace all rows of their keys."""

    removed: dict[str, DataFrame] = field(default_factory=dict)
    written: dict[str, DataFrame] = field(default_factory=dict)


def title_grams(artifact: DataFrame) -> DataFrame:
    """The distinct three-character pieces of each lower-cased title.  Titles that
    are NULL or shorter have none."""
    title = F.lower("title")
    pieces = F.transform(F.sequence(F.lit(1), F.char_length(title) - (GRAM_CHARS - 1)),
                         lambda i: F.substring(title, i, F.lit(GRAM_CHARS)))
    return (artifact.filter(F.char_length(title) >= GRAM_CHARS)
            .withColumn("gram", F.explode(F.array_distinct(pieces))))


def _range(column: str, width: int) -> Column:
    return F.coalesce(F.expr(f"`{column}` div {width}L"), F.lit(NULL_RANGE))


def _same_key(columns: list[str]) -> Column:
    return F.expr(" AND ".join(f"l.`{c}` <=> r.`{c}`" for c in columns))


class Store:
    """A stored gallery at ``path`` as of one version (the latest if not given)."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        checkpoint_dir(spark)
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        elif version not in found:
            raise ValueError(f"no complete version {version} at {path}")
        self.version = version
        # table -> key range -> snapshot, and table -> width; a row without a range names a table.
        self.folders: dict[str, dict[int, int]] = {}
        self.widths: dict[str, int] = {}
        if version:
            for r in spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect():
                ranges = self.folders.setdefault(r.table_name, {})
                self.widths[r.table_name] = r.width
                if r.key_range is not None:
                    ranges[r.key_range] = r.snapshot

    # ------------------------------------------------------------- file names

    def _list(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        return sorted(int(n.split("=")[1]) for n in self._list(f"{self.path}/manifest")
                      if n.startswith("version=") and "_SUCCESS" in self._list(f"{self.path}/manifest/{n}"))

    def remove(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # ---------------------------------------------------------------- reading

    def _read(self, name: str, ranges: dict[int, int]) -> DataFrame:
        schema = S.SCHEMAS[name] if name != GRAMS else "artifact_id bigint, gram string"
        base = f"{self.path}/data/{name}"
        if not ranges:
            return self.spark.createDataFrame([], schema)
        paths = [f"{base}/snapshot={v}/key_range={k}" for k, v in sorted(ranges.items())]
        df = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return df.drop("snapshot", "key_range")

    def table(self, name: str) -> DataFrame:
        """A whole table."""
        return self._read(name, self.folders[name])

    def gallery(self, type_domain: list[str] | None = None) -> Gallery:
        """The stored tables as a Gallery; a table that is not stored is missing from it."""
        return Gallery(type_domain, {n: lambda n=n: self.table(n) for n in self.folders if n in S.SCHEMAS})

    def _ranges_of(self, name: str, keys: DataFrame, stored: bool) -> list[int]:
        """Key ranges that ``keys`` fall in.  With ``stored`` only those that have a
        folder, else all (keys of rows to write, whose ranges become folders): in
        both cases no more reach the driver than a manifest has rows."""
        ranges = keys.select(_range(S.PRIMARY_KEYS[name][0], self.widths[name]).alias("k"))
        if stored:
            have = self.spark.createDataFrame([(k,) for k in self.folders[name]], "k bigint")
            ranges = ranges.join(F.broadcast(have), "k", "left_semi")
        return [r.k for r in ranges.distinct().collect()]

    def lookup(self, name: str, keys: list[int] | DataFrame) -> DataFrame:
        """Rows whose first key column is among ``keys``, read from the folders of
        their ranges only.  A list is pushed to the scan, which skips row groups and
        pages by their bounds and Bloom filters; a DataFrame (its first column) is a
        semi join with the distinct keys.  NULL keys match nothing."""
        column, width = S.PRIMARY_KEYS[name][0], self.widths[name]
        folders = self.folders[name]
        if isinstance(keys, DataFrame):
            keys = keys.select(F.col(keys.columns[0]).cast("bigint").alias(column)).filter(F.col(column).isNotNull()).distinct().checkpoint()
            return self._read(name, {k: folders[k] for k in self._ranges_of(name, keys, stored=True)}).join(keys, column, "left_semi")
        keys = [int(k) for k in keys if k is not None]
        ranges = {abs(k) // width * (1 if k >= 0 else -1) for k in keys}
        return self._read(name, {k: folders[k] for k in ranges if k in folders}).filter(F.col(column).isin(keys))

    # ---------------------------------------------------------------- writing

    def _write(self, name: str, df: DataFrame, version: int, width: int) -> dict[int, int]:
        """``df``'s rows as folders of a new snapshot; gives the ranges written."""
        if name == GRAMS:
            key, order, bloom = "artifact_id", ["gram", "artifact_id"], "gram"
        else:
            key, order = S.PRIMARY_KEYS[name][0], S.PRIMARY_KEYS[name]
            bloom = key
        target = f"{self.path}/data/{name}/snapshot={version}"
        (df.withColumn("key_range", _range(key, width))
         .repartitionByRange("key_range", *order).sortWithinPartitions("key_range", *order)
         .write.mode("overwrite").option("partitionOverwriteMode", "static")
         .option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .partitionBy("key_range").parquet(target))
        return {int(n.split("=")[1]): version for n in self._list(target) if n.startswith("key_range=")}

    def _publish(self, version: int, folders: dict[str, dict[int, int]], widths: dict[str, int]) -> "Store":
        rows = [(t, k, v, widths[t]) for t, ranges in folders.items() for k, v in ranges.items()]
        rows += [(t, None, None, widths[t]) for t in folders]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.path}/manifest/version={version}"))
        return Store(self.spark, self.path, version)

    def commit(self, delta: Delta) -> "Store":
        """Apply a change: only folders that hold its keys are read and rewritten.
        A title index follows its artifacts' folders.  Gives the new version; with
        nothing to change it is the same one."""
        version = max(self.versions()) + 1
        if version != self.version + 1:
            raise ValueError(f"version {self.version} is not the latest")
        folders = {t: dict(r) for t, r in self.folders.items()}
        unknown = (set(delta.removed) | set(delta.written)) - set(folders)
        if unknown:
            raise ValueError(f"not stored: {sorted(unknown)}")
        changed = False
        for name in sorted(set(delta.removed) | set(delta.written)):
            pk, fields = S.PRIMARY_KEYS[name], S.SCHEMAS[name].fieldNames()
            types = {c: S.SCHEMAS[name][c].dataType for c in pk}
            # Fixed once: they decide the folders as well as what goes in them.
            rows = delta.written[name].select(*fields).checkpoint() if name in delta.written else None
            gone = delta.removed[name].select(*[F.col(c).cast(types[c]).alias(c) for c in pk]) if name in delta.removed else None
            coming = rows.select(*pk) if rows is not None else None
            dirty = set()
            if gone is not None:
                gone = gone.distinct().checkpoint()
                dirty |= set(self._ranges_of(name, gone, stored=True))
            if coming is not None:
                dirty |= set(self._ranges_of(name, coming, stored=False))
            if not dirty:
                continue
            changed = True
            keys = coming if gone is None else gone if coming is None else gone.unionByName(coming)
            old = self._read(name, {k: folders[name][k] for k in dirty if k in folders[name]})
            kept = old.alias("l").join(keys.alias("r"), _same_key(pk), "left_anti").select(*fields)
            new = self._write(name, kept if rows is None else kept.unionByName(rows), version, self.widths[name])
            folders[name] = {k: v for k, v in folders[name].items() if k not in dirty} | new
            if name == "artifact" and GRAMS in folders:
                grams = title_grams(self._read(name, new)).select("artifact_id", "gram")
                folders[GRAMS] = ({k: v for k, v in folders[GRAMS].items() if k not in dirty}
                                  | self._write(GRAMS, grams, version, self.widths[name]))
        return self._publish(version, folders, self.widths) if changed else self


def create(g: Gallery, path: str, tables: list[str] | None = None, width: int | dict[str, int] = WIDTH,
           index_titles: bool = False) -> Store:
    """Store ``tables`` (all if not given) of a gallery as the first version at a
    path that holds none.  ``index_titles`` adds the table that title searches use."""
    tables = list(tables if tables is not None else S.SCHEMAS)
    store = Store(g.table(tables[0]).sparkSession, path)
    if store.version:
        raise ValueError(f"{path} holds a gallery already")
    widths = {t: width if isinstance(width, int) else width.get(t, WIDTH) for t in tables}
    folders = {t: store._write(t, g.table(t).select(*S.SCHEMAS[t].fieldNames()), 1, widths[t]) for t in tables}
    if index_titles and "artifact" in tables:
        widths[GRAMS] = widths["artifact"]
        grams = title_grams(store._read("artifact", folders["artifact"])).select("artifact_id", "gram")
        folders[GRAMS] = store._write(GRAMS, grams, 1, widths[GRAMS])
    return store._publish(1, folders, widths)
