"""Presentation projection (P1): the last formatting step of the source
application's pages, as column expressions (money as two-decimal text, long
text shortened, empty values replaced by a placeholder)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.columns import money_text, placeholder, shorten

PLACEHOLDER_IMAGE = "placeholder.png"


def display_columns(df: DataFrame, money: Sequence[str] = (), short: Sequence[str] = (),
                    fills: Mapping[str, str] | None = None, length: int = 100) -> DataFrame:
    """Replace the named columns by their display text; other columns pass through."""
    fills = dict(fills or {})
    out = []
    for c in df.columns:
        if c in money:
            out.append(money_text(c).alias(c))
        elif c in short:
            out.append(shorten(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("")), length).alias(c))
        elif c in fills:
            out.append(placeholder(c, fills[c]).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
