"""Column expressions shared by the operators.  All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.sources.schema import IMAGE_EXTENSIONS

EM_DASH = "—"
ELLIPSIS = "…"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_name(fname: str | Column = "fname", lname: str | Column = "lname") -> Column:
    """``fname || ' ' || lname``; NULL when either part is NULL (SQL CONCAT semantics)."""
    return F.concat(col(fname), F.lit(" "), col(lname))


def enum_rank(c: str | Column, domain: Sequence[str]) -> Column:
    """1-based position of the value in its ENUM domain (0 if outside, NULL if NULL).
    Sorting by this key reproduces ENUM ordering."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), col(c))


def blank_to_none(value: str | None) -> str | None:
    """Driver-side parameter cleaning: strip, and treat '' as not given."""
    if value is None:
        return None
    value = str(value).strip()
    return value or None


def text_contains(c: str | Column, text: str, accents: bool = True) -> Column:
    """Case-blind ``LIKE '%text%'``.  ``%`` and ``_`` in the text keep their
    wildcard meaning, as in the source application.  ``accents=False`` also
    ignores accents, via a case- and accent-insensitive collation (then the
    wildcards are literal)."""
    if accents:
        return col(c).ilike(f"%{text}%")
    return F.contains(F.collate(col(c), "UNICODE_CI_AI"), F.lit(text))


def all_of(conditions: Iterable[Column]) -> Column:
    out = None
    for cond in conditions:
        out = cond if out is None else (out & cond)
    return F.lit(True) if out is None else out


def image_extension_ok(c: str | Column = "image") -> Column:
    """A dot is required and the text after the last dot is an allowed extension, any case."""
    image = col(c)
    return (F.instr(image, ".") > 0) & F.lower(F.substring_index(image, ".", -1)).isin(*IMAGE_EXTENSIONS)


def money_text(c: str | Column) -> Column:
    """Two-decimal text of a money value."""
    return F.format_string("%.2f", col(c).cast("double"))


def shorten(c: str | Column, length: int = 100, leeway: int = 5, end: str = ELLIPSIS) -> Column:
    """Cut long text: unchanged up to ``length + leeway`` characters, else the first
    ``length - len(end)`` characters followed by ``end``."""
    text = col(c)
    return F.when(F.char_length(text) <= length + leeway, text).otherwise(
        F.concat(F.substring(text, 1, length - len(end)), F.lit(end)))


def placeholder(c: str | Column, fill: str) -> Column:
    """Replace NULL and the empty string by ``fill``."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(fill))


def try_int(c: str | Column) -> Column:
    """32-bit integer value of a text field of digits with an optional sign, with
    blanks around; NULL for any other text."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text).try_cast("int")
