"""Alias assignment, replacement of confirmed names and restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import arrow
from pultwerk.functions.privacy import DETECTORS
from pultwerk.functions.text import strip
from pultwerk.operators import ordered
from pultwerk.session import cut_lineage

# two digits or more, so that the hundredth alias is still found
ALIAS = r"SuS-\d{2,}"


def name_candidates(text: Column) -> Column:
    """Suggested names in order of first appearance per detector; nothing is replaced."""
    field = rf"(?imduU)^\s*(?:{fv.NAME_FIELD_WORDS})\s*[:\-–]\s*(.{{2,60}})$"
    fields = F.regexp_extract_all(text, F.lit(field), 1)
    first_line = F.regexp_extract(text, r"(?U)\A\s*([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1)
    phrases = F.transform(F.regexp_extract_all(text, F.lit(f"({DETECTORS['person_name']})"), 1),
                          lambda p: F.regexp_replace(p, rf"(?iuU)^(?:{fv.NAME_LEAD_WORDS})\s+", ""))
    trimmed = F.transform(F.concat(fields, F.array(first_line), phrases), strip)
    return F.array_distinct(F.filter(trimmed, lambda n: n != ""))


def assign_aliases(names: DataFrame, known: DataFrame | None = None, by_count: bool = False) -> DataFrame:
    """(name, seen) rows → alias map (real, alias, first_seen, idx), known entries kept.

    New names are numbered by first appearance, from the highest known index on, or from
    the number of known entries if ``by_count``; numbers already taken are skipped. The
    numbering runs over range partitions, so no task ever holds the whole map.
    """
    spark = names.sparkSession
    if known is None:
        known = spark.createDataFrame([], "real string, alias string, first_seen long, idx long")
    known = known.select("real", "alias", "first_seen", "idx")
    # written: numbering reads it several times, and the grouping should run once
    fresh = cut_lineage(first_seen(names).join(known.select("real"), "real", "left_anti"))
    last = known.agg((F.count("*") if by_count else F.coalesce(F.max("idx"), F.lit(0))).alias("n")).first()["n"]
    numbered = in_order(fresh)
    taken = known.select(taken_number(F.col("alias")).alias("t")).filter(F.col("t") > last).distinct()
    if taken.isEmpty():
        numbered = numbered.withColumn("idx", F.col("place") + last)
    else:
        # a taken number with f free numbers below it is skipped by every place above f
        ranked = ordered.position(ordered.range_split(taken, [], ["t"]), [], ["t"], "j")
        gaps = ranked.select((F.col("t") - last - F.col("j") + 1).alias("place"), F.lit(0).alias("kind"),
                             F.lit(None).cast("string").alias("real"), F.lit(None).cast("long").alias("first_seen"))
        both = gaps.unionByName(numbered.select("place", F.lit(1).alias("kind"), "real", "first_seen"))
        merged = ordered.running(ordered.range_split(both, [], ["place", "kind", "real"]), [], ["place", "kind", "real"],
                                 (F.lit(1) - F.col("kind")).cast("long"), "skipped")
        numbered = merged.filter("kind = 1").withColumn("idx", F.col("place") + F.col("skipped") + last)
    return known.unionByName(numbered.select("real", alias_text(F.col("idx")).alias("alias"), "first_seen", "idx"))


def first_seen(names: DataFrame) -> DataFrame:
    """(name, seen) rows → (real, first_seen), a row per trimmed name."""
    return names.select(strip(F.col("name")).alias("real"), "seen").filter("real <> ''").groupBy("real").agg(F.min("seen").cast("long").alias("first_seen"))


def in_order(fresh: DataFrame) -> DataFrame:
    """Adds ``place``: 1, 2, 3 … by first appearance."""
    order = ["first_seen", "real"]
    return ordered.position(ordered.range_split(fresh, [], order), [], order, "place").drop(ordered.PART)


def alias_text(idx: Column) -> Column:
    return F.concat(F.lit("SuS-"), F.when(idx < 10, F.concat(F.lit("0"), idx.cast("string"))).otherwise(idx.cast("string")))


def taken_number(alias: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(alias, r"^SuS-(\d{2,18})$", 1), F.lit("")).cast("long"), F.lit(0))


def pseudonymize(texts: DataFrame, aliases: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, names) + alias map → text with exactly the given names replaced.

    Names are replaced longest first, where the name's own edge is a word character only at
    a word edge. Only a text's own confirmed names are gathered, so the array per text is as
    long as the list the teacher confirmed for it.
    """
    own = F.array_distinct(F.filter(F.transform("names", strip), lambda n: n != ""))
    wanted = texts.select(key, F.explode(own).alias("real"))
    found = wanted.join(aliases.select("real", "alias"), "real").groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct((-F.char_length("real")).alias("l"), "real", "alias"))).alias("_names"))
    joined = texts.join(found, key, "left")
    return joined.withColumn("pseudonymized", arrow.replace_names("text", F.col("_names.real"), F.col("_names.alias"))).drop("_names")


def restore(texts: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Aliases back to names; an alias nobody assigned stays as it is."""
    hits = F.regexp_extract_all(F.col(text), F.lit(f"({ALIAS})"), 1)
    used = texts.select(key, F.explode(F.array_distinct(hits)).alias("alias"))
    known = used.join(aliases.select("alias", "real"), "alias").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("alias", "real"))).alias("_real"))
    joined = texts.join(known, key, "left").withColumn("_hits", hits)
    pieces = F.transform(F.split(text, ALIAS), lambda piece, i: F.concat(
        piece, F.coalesce(F.try_element_at(F.col("_real"), F.get(F.col("_hits"), i)), F.get(F.col("_hits"), i), F.lit(""))))
    return joined.withColumn("restored", F.array_join(pieces, "")).drop("_real", "_hits")


def reinsert_names(narratives: DataFrame, identities: DataFrame, key: str = "student_id", text: str = "text") -> DataFrame:
    """{NAME} and the four pronoun slots, in lower, capitalised and upper spelling."""
    joined = narratives.join(identities.select(key, "given_name", "alias", "pronoun"), key, "left")
    name = F.coalesce(F.nullif(strip(F.col("given_name")), F.lit("")), strip(F.col("alias")), F.lit(""))
    pronoun = F.lower(strip(F.coalesce(F.nullif("pronoun", F.lit("")), F.lit("sie"))))
    out = F.replace(F.col(text), F.lit("{NAME}"), name)
    for slot in fv.PRONOUNS["sie"]:
        value = F.when(pronoun == "er", fv.PRONOUNS["er"][slot]).otherwise(fv.PRONOUNS["sie"][slot])
        first, second = slot.split("/")
        out = F.replace(out, F.lit("{" + slot + "}"), value)
        for spelling in (f"{first.capitalize()}/{second}", f"{first.capitalize()}/{second.capitalize()}", slot.upper()):
            out = F.replace(out, F.lit("{" + spelling + "}"), F.initcap(value))
    return joined.withColumn("filled", out).drop("given_name", "alias", "pronoun")
