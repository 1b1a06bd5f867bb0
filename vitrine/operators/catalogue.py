"""Catalogue and exhibition queries (Q1-Q9).

Filters are plain column predicates applied to the scan, so Catalyst merges
them into one condition and pushes what it can (equality, ranges,
``StringContains``) to the parquet reader.  Optional filters are dropped when
blank, as in the source application's dashboards.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.columns import EM_DASH, all_of, blank_to_none, full_name, text_contains
from vitrine.sources.tables import Gallery

ARTIFACT_COLUMNS = ["artifact_id", "artist_id", "museum_id", "title", "description", "type", "quality", "owner",
                    "price", "quantity", "image", "created_at"]


def _as_date(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(_dt.date.fromisoformat(str(as_of)))


def _type_filter(g: Gallery, type_: str) -> Column:
    """ENUM comparison ignores case.  The asked value is mapped to the domain's
    own spelling on the driver, so the scan still gets a pushed-down equality."""
    for value in g.type_domain:
        if value.lower() == type_.lower():
            return F.col("type") == value
    return F.lower(F.col("type")) == type_.lower()


def _search_filters(g: Gallery, search: str | None, type_: str | None, accents: bool = True) -> list[Column]:
    conds = []
    search, type_ = blank_to_none(search), blank_to_none(type_)
    if search is not None:
        conds.append(text_contains("title", search, accents=accents))
    if type_ is not None:
        conds.append(_type_filter(g, type_))
    return conds


def catalogue(g: Gallery) -> DataFrame:
    """Q1: every artifact with its artist's and museum's name (a dash when missing), newest first."""
    artists = g.users.select(F.col("user_id").alias("artist_id"), full_name().alias("_artist"))
    museums = g.museum.select("museum_id", F.col("name").alias("_museum"))
    return (g.artifact.join(artists, "artist_id", "left").join(museums, "museum_id", "left")
            .select("artifact_id", "title", "price", "type", "image", "quantity",
                    F.coalesce("_artist", F.lit(EM_DASH)).alias("artist_name"),
                    F.coalesce("_museum", F.lit(EM_DASH)).alias("museum_name"))
            .orderBy(F.desc("created_at"), F.asc("artifact_id")))


def artist_artifacts(g: Gallery, artist: int | DataFrame, search: str | None = None,
                     type_: str | None = None) -> DataFrame:
    """Q2: an artist's own artifacts with optional title search and type filter.
    ``artist`` is one id, or a DataFrame with an ``artist_id`` column (many
    artists' dashboards in one job, as a semi join)."""
    art = g.artifact
    if isinstance(artist, DataFrame):
        art = art.join(artist.select("artist_id"), "artist_id", "left_semi")
    else:
        art = art.filter(F.col("artist_id") == F.lit(artist))
    return art.filter(all_of(_search_filters(g, search, type_))).select(*ARTIFACT_COLUMNS).orderBy(
        F.desc("created_at"), F.asc("artifact_id"))


def in_stock_artifacts(g: Gallery, search: str | None = None, type_: str | None = None) -> DataFrame:
    """Q3: the customer gallery: artifacts in stock, same optional filters."""
    conds = [F.col("quantity") > 0] + _search_filters(g, search, type_)
    return g.artifact.filter(all_of(conds)).select(*ARTIFACT_COLUMNS).orderBy(
        F.desc("created_at"), F.asc("artifact_id"))


def artifact_types(g: Gallery) -> DataFrame:
    """Q4: the distinct types (NULL is one value)."""
    return g.artifact.select("type").distinct()


def museums_by_name(g: Gallery) -> DataFrame:
    """Q5: museum pick list."""
    return g.museum.select("museum_id", "name").orderBy("name", "museum_id")


def upcoming_exhibitions_with_museum(g: Gallery, as_of=None) -> DataFrame:
    """Q6: exhibitions starting on or after ``as_of`` (NULL start excluded), with museum name."""
    museums = g.museum.select("museum_id", F.col("name").alias("museum_name"))
    return (g.exhibition.filter(F.col("start_date") >= _as_date(as_of))
            .join(museums, "museum_id", "left")
            .orderBy("start_date", "exhibition_id")
            .select("title", "theme", "start_date", "end_date", "capacity", "museum_name"))


def upcoming_exhibitions(g: Gallery, as_of=None, n: int = 100) -> DataFrame:
    """Q7: the next ``n`` exhibitions (report form)."""
    return (g.exhibition.filter(F.col("start_date") >= _as_date(as_of))
            .select("exhibition_id", "title", "start_date", "end_date")
            .orderBy("start_date", "exhibition_id")
            .limit(n))


def faceted_search(g: Gallery, text: str | None = None, type_: str | None = None,
                   min_price=None, max_price=None, museum_id: int | None = None,
                   artist_id: int | None = None, accents: bool = True) -> DataFrame:
    """Q8: search by text, type, inclusive price range, museum and artist; shows
    image, stock, artist and museum names."""
    conds = _search_filters(g, text, type_, accents=accents)
    if min_price is not None:
        conds.append(F.col("price") >= F.lit(min_price).cast("decimal(12,2)"))
    if max_price is not None:
        conds.append(F.col("price") <= F.lit(max_price).cast("decimal(12,2)"))
    if museum_id is not None:
        conds.append(F.col("museum_id") == F.lit(museum_id))
    if artist_id is not None:
        conds.append(F.col("artist_id") == F.lit(artist_id))
    artists = g.users.select(F.col("user_id").alias("artist_id"), full_name().alias("artist_name"))
    museums = g.museum.select("museum_id", F.col("name").alias("museum_name"))
    return (g.artifact.filter(all_of(conds))
            .join(artists, "artist_id", "left").join(museums, "museum_id", "left")
            .select("artifact_id", "title", "type", "price", "quantity", "image", "artist_name", "museum_name")
            .orderBy(F.desc("price"), F.asc("artifact_id")))


def artifacts_by_ids(g: Gallery, ids: DataFrame | list[int]) -> DataFrame:
    """Q9: batch point lookup.  A short literal list becomes ``isin`` (pushed to
    the scan); a DataFrame of ids becomes a semi join with the distinct ones, so
    that repeated ids are neither shuffled nor sorted."""
    cols = ["artifact_id", "title", "price", "image"]
    if isinstance(ids, DataFrame):
        return g.artifact.join(ids.select("artifact_id").distinct(), "artifact_id", "left_semi").select(*cols)
    return g.artifact.filter(F.col("artifact_id").isin(list(ids))).select(*cols)
