"""Text helpers as Column functions. Null reads as empty throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_SPECIFIED = "Not Specified"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(filled(c), r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Every run of Unicode white space as one space."""
    return F.regexp_replace(filled(c), r"(?U)\s+", " ")


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def joined(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator)


def article_id(c: Column) -> Column:
    """The id that a sheet holds as a number: '123.0' -> '123'; other text as it is."""
    whole = c.cast("string").try_cast("double").try_cast("bigint").cast("string")
    return F.coalesce(whole, F.trim(c.cast("string")))


def sections_text(sections: Column, heading: str) -> Column:
    """Texts of the sections whose lower-cased heading matches, a blank line between them."""
    hit = F.filter(sections, lambda s: F.lower(s["title"]).rlike(heading))
    return F.array_join(F.transform(hit, lambda s: s["text"]), "\n\n")
