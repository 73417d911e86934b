"""Skill routing by trigger phrases and small text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions.text import strip


def trigger_dimension(index: DataFrame) -> DataFrame:
    """(name, folder, triggers, pos) rows → (skill_id, trigger, skill_pos, trigger_pos).

    Invalid ids are dropped and a later duplicate replaces an earlier one, but keeps the
    place of the first.
    """
    valid = index.filter(F.col("name").rlike(fv.SKILL_ID_PATTERN) & F.col("folder").rlike(fv.SKILL_ID_PATTERN))
    kept = valid.groupBy(F.col("name").alias("skill_id")).agg(
        F.max_by("triggers", "pos").alias("triggers"), F.min("pos").alias("skill_pos"))
    return kept.select("skill_id", "skill_pos", F.posexplode("triggers").alias("trigger_pos", "trigger")).withColumn(
        "trigger", F.lower("trigger"))


def match_skill(text: Column, skills: list[tuple[str, list[str]]] = fv.SKILLS) -> Column:
    """Skill with the longest trigger contained in the text; ties go to the earlier skill.

    The skill index is configuration, so it becomes part of the expression: no join, and
    the test stays inside generated code. Triggers are ranked once, up front.
    """
    ranked = sorted(((len(t), -pos, t.lower(), skill) for pos, (skill, triggers) in enumerate(skills)
                     for t in triggers if t), key=lambda r: (r[0], r[1]))
    # bound as a lambda variable, so that a long text is lowered once and not per trigger
    best = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda t: F.greatest(
        F.lit(0), *[F.when(t.contains(trigger), F.lit(i)).otherwise(0) for i, (_, _, trigger, _) in enumerate(ranked, 1)]))[0]
    return F.when(best > 0, F.element_at(F.array(*[F.lit(r[3]) for r in ranked]), best))


def public_index(triggers: DataFrame) -> DataFrame:
    """Trigger lists without the always-on skill, with the local-only flag."""
    return (triggers.filter(F.col("skill_id") != fv.ALWAYS_ON_SKILL).groupBy("skill_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("trigger_pos", "trigger")))["trigger"], "|").alias("triggers"))
        .withColumn("local_required", F.col("skill_id").isin(fv.SENSITIVE_SKILLS)))


def is_question(text: Column) -> Column:
    lowered = F.lower(strip(text))
    starts = [lowered.startswith(s) for s in fv.QUESTION_STARTS]
    marks = [lowered.contains(m) for m in fv.QUESTION_MARKERS]
    out = text.contains("?")
    for test in starts + marks:
        out = out | test
    return out


def _first_group(text: Column, groups: list[tuple[str, list[str]]]) -> Column:
    lowered, out = F.lower(text), None
    for name, words in groups:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def faq_topic(text: Column) -> Column:
    return _first_group(text, fv.FAQ_KEYS)


def mood(text: Column) -> Column:
    return _first_group(text, fv.MOOD_WORDS)


def exam_title(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, "(?iu)" + fv.EXAM_WORDS, 0)), F.lit(""))


def exam_date(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, rf"(?U)\b{fv.EXAM_DATE}\b", i)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def unresolved_marks(text: Column) -> Column:
    """Reader marks still in a text; any mark forbids grading."""
    return F.regexp_extract_all(text, F.lit(r"(\[\+?[^\[\]]*\?\]|" + fv.UNCLEAR.replace("?", r"\?") + ")"), 1)
