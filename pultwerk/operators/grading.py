"""Points to grades, class statistics, task analysis and rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv

EXAM = ["class_id", "exam_month"]


def grade(percent: Column, key: str = "standard") -> Column:
    """The key is six thresholds, so it is a CASE and not a join."""
    out = None
    for name, number, minimum in fv.GRADE_KEYS:
        if name == key:
            out = F.when(percent >= minimum, number) if out is None else out.when(percent >= minimum, number)
    if out is None:
        raise ValueError(f"unknown grade key {key!r}")
    return out


def _band(number: Column, key: str) -> tuple[Column, Column]:
    limits = [m for n, _, m in fv.GRADE_KEYS if n == key]
    lower = F.element_at(F.array(*[F.lit(m) for m in limits]), number)
    upper = F.element_at(F.array(*[F.lit(m) for m in [100, *limits[:-1]]]), number)
    return lower, upper


def tendency(percent: Column, key: str = "standard") -> Column:
    """Upper, middle or lower third of the grade's own band."""
    lower, upper = _band(grade(percent, key), key)
    place = (percent - lower) * 3
    return F.when(place >= (upper - lower) * 2, "obere").when(place >= upper - lower, "mittlere").otherwise("untere")


def points_for_grade(total: Column, key: str = "standard") -> Column:
    """Array of (grade, name, min_points, percent), points rounded half up to half points."""
    rows = [(n, fv.GRADE_NAMES[n - 1], p) for k, n, p in fv.GRADE_KEYS if k == key]
    return F.array(*[F.struct(F.lit(n).alias("grade"), F.lit(name).alias("name"),
                              (F.floor(total * p / 100 * 2 + 0.5) / 2).alias("min_points"), F.lit(p).alias("percent"))
                     for n, name, p in rows])


def student_totals(scores: DataFrame, key: str = "standard") -> DataFrame:
    """One row per student and exam: points, percent and grade."""
    totals = scores.groupBy(*EXAM, "student_id").agg(F.sum("points").alias("points"), F.sum("max_points").alias("max_points"))
    return totals.withColumn("percent", F.col("points") * 100 / F.col("max_points")).withColumn("grade", grade(F.col("percent"), key))


def statistics(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*EXAM).agg(
        F.count("*").alias("n"), F.min("points").alias("min_points"), F.max("points").alias("max_points"),
        (F.max("points") - F.min("points")).alias("spread"), F.round(F.avg("points"), 6).alias("mean_points"),
        F.median("points").alias("median_points"), F.round(F.stddev_pop("points"), 6).alias("std_points"))


def _grade_counts() -> list[Column]:
    return [F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(1, 7)]


def distribution(totals: DataFrame) -> DataFrame:
    """Six rows per exam, zero rows included: six counters in one pass, then unpivoted."""
    counts = totals.groupBy(*EXAM).agg(F.count("*").alias("n"), *_grade_counts())
    long = counts.unpivot([*EXAM, "n"], [f"n{g}" for g in range(1, 7)], "g", "students")
    return long.select(*EXAM, F.substring("g", 2, 1).cast("int").alias("grade"), "students",
                       F.round(F.col("students") / F.col("n"), 6).alias("share"))


def pass_rate(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*EXAM).agg(F.round(F.avg((F.col("grade") <= 4).cast("int")), 6).alias("pass_rate"))


def task_analysis(scores: DataFrame) -> DataFrame:
    solved = F.sum("points") / F.sum("max_points")
    return scores.groupBy(*EXAM, "task").agg(F.count("*").alias("n"), F.round(solved, 6).alias("solve_rate"),
                                             F.when(solved < 0.4, "zu schwer").when(solved > 0.9, "zu leicht").alias("note"))


def _verdict(mean: Column) -> Column:
    return (F.when(mean <= 2.5, "sehr gut").when(mean <= 3.5, "solide").when(mean <= 4.5, "Förderbedarf").otherwise("kritisch"))


def verdicts(totals: DataFrame) -> DataFrame:
    mean, spread = F.avg("grade"), F.stddev_pop("grade")
    return totals.groupBy(*EXAM).agg(F.round(mean, 6).alias("mean_grade"), F.round(spread, 6).alias("std_grade")).withColumns(
        {"verdict": _verdict(F.col("mean_grade")), "heterogeneous": F.col("std_grade") > 1})


def compare_previous(per_exam: DataFrame) -> DataFrame:
    """Change against the exam before; the frame has one row per class and exam by now."""
    before = W.partitionBy("class_id").orderBy("exam_month")
    return per_exam.withColumns({
        "grade_change": F.round(F.col("mean_grade") - F.lag("mean_grade").over(before), 6),
        "pass_change": F.round(F.col("pass_rate") - F.lag("pass_rate").over(before), 6)})


def class_report(scores: DataFrame, key: str = "standard") -> DataFrame:
    """Everything about an exam in one aggregation over student totals."""
    totals = student_totals(scores, key)
    per_exam = totals.groupBy(*EXAM).agg(
        F.count("*").alias("n"), F.min("points").alias("min_points"), F.max("points").alias("max_points"),
        F.round(F.avg("points"), 6).alias("mean_points"), F.median("points").alias("median_points"),
        F.round(F.stddev_pop("points"), 6).alias("std_points"), *_grade_counts(),
        F.round(F.avg((F.col("grade") <= 4).cast("int")), 6).alias("pass_rate"),
        F.round(F.avg("grade"), 6).alias("mean_grade"), F.round(F.stddev_pop("grade"), 6).alias("std_grade"))
    return compare_previous(per_exam).withColumns(
        {"verdict": _verdict(F.col("mean_grade")), "heterogeneous": F.col("std_grade") > 1})


def rubric_shares(rows: DataFrame, kind: str = "klassenarbeit") -> DataFrame:
    """Points and share per requirement level next to the target share."""
    per_level = rows.groupBy("rubric", "level").agg(F.sum("points").alias("points"))
    target = F.create_map(*[F.lit(x) for k, level, share in fv.LEVEL_TARGETS if k == kind for x in (level, share)])
    total = F.sum("points").over(W.partitionBy("rubric"))
    return per_level.withColumn("total", total).withColumns({
        "share": F.round(F.col("points") * 100 / F.col("total"), 6), "target": F.try_element_at(target, F.col("level"))})


def correction_tendency(corrections: DataFrame) -> DataFrame:
    ratio = F.avg(F.col("points") / F.col("max_points"))
    out = corrections.groupBy("corrector").agg(F.count("*").alias("corrections"), F.round(ratio, 6).alias("ratio"))
    return out.filter(F.col("corrections") >= fv.MIN_CORRECTIONS).withColumn(
        "tendency", F.when(F.col("ratio") >= fv.GENEROUS_FROM, "großzügig").when(F.col("ratio") <= fv.STRICT_TO, "streng").otherwise("neutral"))


def batch_progress(works: DataFrame) -> DataFrame:
    """works(batch, done) → how many of a batch's works are corrected."""
    return works.groupBy("batch").agg(F.count_if("done").alias("done"), F.count("*").alias("total"))


def milestones(log: DataFrame) -> DataFrame:
    """log(kind) → activities by kind."""
    return log.groupBy("kind").agg(F.count("*").alias("n"))


def phase_problems(phases: DataFrame) -> DataFrame:
    return phases.withColumn("problem", F.when((F.col("phase") == "Einstieg") & (F.col("minutes") > fv.OPENING_MAX_MINUTES), "opening_too_long")
                             .when((F.col("phase") == "Sicherung") & (F.col("minutes") < fv.CONSOLIDATION_MIN_MINUTES), "consolidation_too_short"))


def wording_flags(text: Column) -> Column:
    """Names of the report-language rules a text breaks, in rule order."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?iuU)\b(?:{p})\b"), F.lit(n)) for n, p in fv.REPORT_RULES]))
