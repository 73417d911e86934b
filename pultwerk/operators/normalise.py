"""Free-text profile fields: states, school types, subjects, class levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions.text import ASCII_EDGE, strip


def nearest_name(raw: Column, names: list[str], max_edits: int, aliases: list[tuple[str, str]] = ()) -> Column:
    """Alias, then exact, then the first nearest name within ``max_edits``; else unchanged.

    The candidate list is a constant of a few names, so it is part of the expression; a
    bounded edit distance stops early and nothing is joined.
    """
    lowered = F.lower(strip(raw))
    known = {**{n.lower(): n for n in reversed(names)}, **dict(aliases)}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    distances = [F.levenshtein(lowered, F.lit(n.lower()), max_edits) for n in names]
    scored = F.array(*[F.when(d >= 0, F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")))
                       for i, (d, n) in enumerate(zip(distances, names))])
    return (F.when(lowered == "", raw)
            .otherwise(F.coalesce(F.try_element_at(lookup, lowered), F.array_min(F.array_compact(scored))["n"], raw)))


def state_name(raw: Column) -> Column:
    return nearest_name(raw, fv.STATES, fv.STATE_MAX_EDITS, fv.STATE_ALIASES)


def school_type(raw: Column) -> Column:
    return nearest_name(raw, fv.SCHOOL_TYPES, fv.SCHOOL_TYPE_MAX_EDITS)


def subject_name(raw: Column) -> Column:
    pattern = r"(?d)\A([a-zA-ZäöüÄÖÜß]+)((?U:[\s\-–]).+)?\z"
    word, rest = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
    lookup = F.create_map(*[F.lit(x) for pair in fv.SUBJECT_NAMES for x in pair])
    mapped = F.coalesce(F.try_element_at(lookup, F.lower(word)), F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2))))
    return F.when(F.coalesce(raw, F.lit("")) == "", "").when(word == "", raw).otherwise(F.concat(mapped, rest))


def class_levels(text: Column) -> Column:
    """Every one- or two-digit class level named in a text."""
    hits = F.regexp_extract_all(text, F.lit(rf"(?i){ASCII_EDGE}(\d{{1,2}})\s*[a-zäöüß]?{ASCII_EDGE}"), 1)
    return F.transform(hits, lambda n: n.cast("int"))


def invalid_levels(text: Column) -> Column:
    return F.array_distinct(F.filter(class_levels(text), lambda n: (n < 1) | (n > 13)))


def class_label_problem(value: Column) -> Column:
    """NULL for 1–13 with an optional letter (or blank), else what is wrong."""
    v = strip(F.coalesce(value, F.lit("")))
    level = F.regexp_extract(v, r"(?iu)\A(\d{1,2})\s*([a-zäöüß]?)\z", 1)
    return F.when(v == "", None).when(level == "", "format").when((level.cast("int") < 1) | (level.cast("int") > 13), "range")
