"""Small text expressions that differ from Spark's built-in of the same idea."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# \b of an engine that counts only ASCII letters, digits and underscore as word characters
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def strip(text: Column) -> Column:
    """Trims every kind of white space; ``trim`` only knows the blank."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def slug(text: Column) -> Column:
    """Everything but word characters becomes a single underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", "_"), r"_+", "_")


def rubric_slug(*parts: Column) -> Column:
    return F.regexp_replace(slug(F.concat_ws("_", *parts)), r"\A_+|_+\z", "")


def export_slug(title: Column, default: str = "export") -> Column:
    """File-name part of a title: at most 60 characters, never empty."""
    base = F.lower(strip(F.coalesce(F.nullif(title, F.lit("")), F.lit(default))))
    base = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w\-]+", "_"), "_+", "_")
    cut = F.substring(F.regexp_replace(base, r"\A_+|_+\z", ""), 1, 60)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def title_case(text: Column) -> Column:
    """Upper case after anything that is no letter ("7a" → "7A"), lower case elsewhere."""
    chars = F.split(text, "")
    starts = lambda i: (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}")
    return F.array_join(F.transform(chars, lambda c, i: F.when(starts(i), F.upper(c)).otherwise(F.lower(c))), "")
