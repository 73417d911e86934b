"""Grading and lesson queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.operators import grading, lessons, records
from pultwerk.plans.privacy_queries import _L, _R
from pultwerk.plans.registry import query, quote, values
from pultwerk.sources.tables import table, view, view_sql

_EX = f"WITH {view_sql('exam_scores')}"


def grade_sql(pct: str, key: str = "standard") -> str:
    return "CASE " + " ".join(f"WHEN {pct} >= {m} THEN {n}" for k, n, m in fv.GRADE_KEYS if k == key) + " END"


_TOT = _EX + f""", totals AS (SELECT class_id, exam_month, student_id, sum(points) AS points, sum(max_points) AS max_points, sum(points) * 100 / sum(max_points) AS percent, {grade_sql('(sum(points) * 100 / sum(max_points))')} AS grade
 FROM exam_scores GROUP BY class_id, exam_month, student_id) """
_M = "strftime(exam_month, '%Y-%m') AS exam_month"


def _month(df):
    return df.withColumn("exam_month", F.date_format("exam_month", "yyyy-MM"))


def _totals(spark, sf):
    return grading.student_totals(view(spark, sf, "exam_scores"))


@query("jn_07_grades", _EX + f", p AS (SELECT class_id, {_M}, student_id, task, points * 100 / max_points AS percent FROM exam_scores) SELECT class_id, exam_month, student_id, task, percent, {grade_sql('percent')} AS standard, {grade_sql('percent', 'mild')} AS mild, {grade_sql('percent', 'verschaerft')} AS verschaerft FROM p")
def _(spark, sf):
    s = _month(view(spark, sf, "exam_scores")).withColumn("percent", F.col("points") * 100 / F.col("max_points"))
    return s.select("class_id", "exam_month", "student_id", "task", "percent", *[grading.grade(F.col("percent"), k).alias(k) for k in ("standard", "mild", "verschaerft")])


@query("ag_13_class_statistics", _TOT + f"SELECT class_id, {_M}, count(*) AS n, min(points) AS min_points, max(points) AS max_points, max(points) - min(points) AS spread, round(avg(points), 6) AS mean_points, median(points) AS median_points, round(stddev_pop(points), 6) AS std_points FROM totals GROUP BY class_id, totals.exam_month")
def _(spark, sf):
    return _month(grading.statistics(_totals(spark, sf)))


@query("ag_14_grade_distribution", _TOT + f", grades AS (SELECT unnest(range(1, 7)) AS grade), exams AS (SELECT class_id, exam_month, count(*) AS n FROM totals GROUP BY ALL) SELECT e.class_id, strftime(e.exam_month, '%Y-%m') AS exam_month, CAST(g.grade AS INTEGER) AS grade, count(t.student_id) AS students, round(count(t.student_id) / CAST(n AS DOUBLE), 6) AS share FROM exams e CROSS JOIN grades g LEFT JOIN totals t ON t.class_id = e.class_id AND t.exam_month = e.exam_month AND t.grade = g.grade GROUP BY e.class_id, e.exam_month, g.grade, n")
def _(spark, sf):
    return _month(grading.distribution(_totals(spark, sf)))


@query("ag_15_pass_rate", _TOT + f"SELECT class_id, {_M}, round(avg(CASE WHEN grade <= 4 THEN 1 ELSE 0 END), 6) AS pass_rate FROM totals GROUP BY class_id, totals.exam_month")
def _(spark, sf):
    return _month(grading.pass_rate(_totals(spark, sf)))


@query("ag_16_task_analysis", _EX + f" SELECT class_id, {_M}, task, count(*) AS n, round(sum(points) / sum(max_points), 6) AS solve_rate, CASE WHEN sum(points) / sum(max_points) < 0.4 THEN 'zu schwer' WHEN sum(points) / sum(max_points) > 0.9 THEN 'zu leicht' END AS note FROM exam_scores GROUP BY class_id, exam_scores.exam_month, task")
def _(spark, sf):
    return _month(grading.task_analysis(view(spark, sf, "exam_scores")))


_VERDICT = "CASE WHEN mean_grade <= 2.5 THEN 'sehr gut' WHEN mean_grade <= 3.5 THEN 'solide' WHEN mean_grade <= 4.5 THEN 'Förderbedarf' ELSE 'kritisch' END AS verdict, std_grade > 1 AS heterogeneous"
_PER = _TOT + ", per AS (SELECT class_id, exam_month, round(avg(CASE WHEN grade <= 4 THEN 1 ELSE 0 END), 6) AS pass_rate, round(avg(grade), 6) AS mean_grade, round(stddev_pop(grade), 6) AS std_grade FROM totals GROUP BY class_id, exam_month) "
_CHANGE = "round(mean_grade - lag(mean_grade) OVER w, 6) AS grade_change, round(pass_rate - lag(pass_rate) OVER w, 6) AS pass_change"
_W = "WINDOW w AS (PARTITION BY class_id ORDER BY {t}.exam_month)"


@query("ag_17_class_verdict", _PER + f"SELECT class_id, {_M}, mean_grade, std_grade, {_VERDICT} FROM per")
def _(spark, sf):
    return _month(grading.verdicts(_totals(spark, sf)))


@query("wn_13_change_to_previous", _PER + f"SELECT class_id, {_M}, mean_grade, pass_rate, {_CHANGE} FROM per {_W.format(t='per')}")
def _(spark, sf):
    t = _totals(spark, sf)
    per = t.groupBy(*grading.EXAM).agg(F.round(F.avg("grade"), 6).alias("mean_grade"), F.round(F.avg((F.col("grade") <= 4).cast("int")), 6).alias("pass_rate"))
    return _month(grading.compare_previous(per))


@query("gr_01_class_report", _TOT + f""", r AS (SELECT class_id, exam_month, count(*) AS n, min(points) AS min_points, max(points) AS max_points, round(avg(points), 6) AS mean_points, median(points) AS median_points, round(stddev_pop(points), 6) AS std_points,
 {', '.join(f'count(*) FILTER (grade = {g}) AS n{g}' for g in range(1, 7))}, round(avg(CASE WHEN grade <= 4 THEN 1 ELSE 0 END), 6) AS pass_rate, round(avg(grade), 6) AS mean_grade, round(stddev_pop(grade), 6) AS std_grade FROM totals GROUP BY class_id, exam_month)
 SELECT r.* REPLACE (strftime(r.exam_month, '%Y-%m') AS exam_month), {_CHANGE}, {_VERDICT} FROM r {_W.format(t='r')}""")
def _(spark, sf):
    return _month(grading.class_report(view(spark, sf, "exam_scores")))


_RUB = f"WITH {view_sql('rubric_rows')} "


@query("ag_18_rubric_shares", _RUB + f", {values('target_of', 'kind, level, target', fv.LEVEL_TARGETS)}, l AS (SELECT rubric, level, CAST(sum(points) AS BIGINT) AS points FROM rubric_rows GROUP BY ALL) SELECT rubric, l.level, points, CAST(sum(points) OVER (PARTITION BY rubric) AS BIGINT) AS total, round(points * 100 / CAST(sum(points) OVER (PARTITION BY rubric) AS DOUBLE), 6) AS share, target FROM l JOIN target_of t ON t.level = l.level AND t.kind = 'lernzielkontrolle'")
def _(spark, sf):
    return grading.rubric_shares(view(spark, sf, "rubric_rows"), "lernzielkontrolle")


@query("sc_18_points_per_grade", _RUB + f", {values('k', 'key, grade, percent', fv.GRADE_KEYS)}, {values('nm', 'grade, name', list(enumerate(fv.GRADE_NAMES, 1)))}, t AS (SELECT rubric, CAST(sum(points) AS DOUBLE) AS total FROM rubric_rows GROUP BY rubric) SELECT rubric, k.grade, name, floor(total * percent / 100 * 2 + 0.5) / 2 AS min_points, percent FROM t CROSS JOIN k JOIN nm USING (grade) WHERE key = 'mild'")
def _(spark, sf):
    totals = view(spark, sf, "rubric_rows").groupBy("rubric").agg(F.sum("points").cast("double").alias("total"))
    return totals.select("rubric", F.inline(grading.points_for_grade(F.col("total"), "mild")))


@query("sc_19_grade_tendency", _TOT + f""", {values('k', 'key, grade, lo', fv.GRADE_KEYS)}, b AS (SELECT grade, lo, COALESCE(lag(lo) OVER (ORDER BY grade), 100) AS hi FROM k WHERE key = 'standard')
 SELECT class_id, {_M}, student_id, t.grade, CASE WHEN (percent - lo) * 3 >= (hi - lo) * 2 THEN 'obere' WHEN (percent - lo) * 3 >= hi - lo THEN 'mittlere' ELSE 'untere' END AS tendency FROM totals t JOIN b USING (grade)""")
def _(spark, sf):
    return _month(_totals(spark, sf)).select("class_id", "exam_month", "student_id", "grade", grading.tendency(F.col("percent")).alias("tendency"))


_PHASE = "CASE l_linenumber WHEN 1 THEN 'Einstieg' WHEN 7 THEN 'Sicherung' ELSE 'Erarbeitung' END"


@query("sc_20_phase_limits", f"SELECT l_orderkey AS lesson_id, {_PHASE} AS phase, l_quantity AS minutes, CASE WHEN l_linenumber = 1 AND l_quantity > 10 THEN 'opening_too_long' WHEN l_linenumber = 7 AND l_quantity < 5 THEN 'consolidation_too_short' END AS problem FROM lineitem")
def _(spark, sf):
    return grading.phase_problems(table(spark, sf, "lineitem").selectExpr("l_orderkey AS lesson_id", f"{_PHASE} AS phase", "l_quantity AS minutes"))


@query("sc_21_wording_flags", f"WITH {view_sql('docs')} SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {quote(f'(?i){_L}(?:{p}){_R}')}) THEN '{n}' END" for n, p in fv.REPORT_RULES) + "], lambda x: x IS NOT NULL), ',') AS flags FROM docs")
def _(spark, sf):
    return view(spark, sf, "docs").select("doc_id", F.array_join(grading.wording_flags(F.col("text")), ",").alias("flags"))


@query("ag_26_correction_tendency", "SELECT l_partkey AS corrector, count(*) AS corrections, round(avg(l_quantity / 50), 6) AS ratio, CASE WHEN round(avg(l_quantity / 50), 6) >= 0.55 THEN 'großzügig' WHEN round(avg(l_quantity / 50), 6) <= 0.45 THEN 'streng' ELSE 'neutral' END AS tendency FROM lineitem GROUP BY l_partkey HAVING count(*) >= 3")
def _(spark, sf):
    return grading.correction_tendency(table(spark, sf, "lineitem").selectExpr("l_partkey AS corrector", "l_quantity AS points", "cast(50 AS double) AS max_points"))


@query("ag_24_batch_progress", "SELECT o_custkey AS batch, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return grading.batch_progress(table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), (F.col("o_orderstatus") == "F").alias("done")))


@query("ag_25_milestones", "SELECT 'planned_lessons' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'rubrics', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'corrections', count(*) FROM lineitem")
def _(spark, sf):
    """Lessons, rubrics and corrections as one activity log, counted by kind."""
    log = (table(spark, sf, "orders").select(F.lit("planned_lessons").alias("kind"))
           .unionByName(table(spark, sf, "part").select("p_brand").distinct().select(F.lit("rubrics").alias("kind")))
           .unionByName(table(spark, sf, "lineitem").select(F.lit("corrections").alias("kind"))))
    return grading.milestones(log)


_LES = f"WITH {view_sql('lessons')} "
_SHARES = "shares AS (SELECT class_id, method, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY class_id) AS DOUBLE), 6) AS share FROM lessons GROUP BY class_id, method)"
_RUNS = """marked AS (SELECT class_id, method, held_on, lesson_id, row_number() OVER (PARTITION BY class_id ORDER BY held_on, lesson_id) - row_number() OVER (PARTITION BY class_id, method ORDER BY held_on, lesson_id) AS island FROM lessons),
 runs AS (SELECT class_id, method, max(c) AS longest_run FROM (SELECT class_id, method, island, count(*) AS c FROM marked GROUP BY ALL) GROUP BY class_id, method)"""
_LAST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY held_on DESC, lesson_id DESC) AS rn FROM lessons), last5 AS (SELECT class_id, string_agg(method, ' > ' ORDER BY rn DESC) AS last_methods FROM ranked WHERE rn <= 5 GROUP BY class_id)"


@query("ag_19_method_shares", _LES + f", {_SHARES} SELECT * FROM shares")
def _(spark, sf):
    return lessons.method_shares(view(spark, sf, "lessons"))


@query("wn_07_method_runs", _LES + f", {_SHARES}, {_RUNS} SELECT class_id, method, n, share, longest_run, longest_run >= 3 AS run_warning, share >= 0.4 AS share_warning FROM shares JOIN runs USING (class_id, method)")
def _(spark, sf):
    return lessons.method_warnings(view(spark, sf, "lessons"))


@query("wn_08_last_five_methods", _LES + f", {_LAST} SELECT * FROM last5")
def _(spark, sf):
    return lessons.last_methods(view(spark, sf, "lessons"))


@query("ag_20_coverage_period", _LES + "SELECT class_id, strftime(min(held_on), '%Y-%m-%d') AS first_day, strftime(max(held_on), '%Y-%m-%d') AS last_day, count(*) AS lessons FROM lessons GROUP BY class_id")
def _(spark, sf):
    out = lessons.coverage_period(view(spark, sf, "lessons"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@query("ag_20_topic_hours", _LES + "SELECT subject, topic_id, count(*) AS hours, strftime(max(held_on), '%Y-%m-%d') AS last_day FROM lessons GROUP BY ALL")
def _(spark, sf):
    return lessons.topic_hours(view(spark, sf, "lessons")).withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


@query("ls_01_lesson_report", _LES + f""", {_SHARES}, {_RUNS}, {_LAST}, per AS (SELECT class_id, arg_max(method, (n, method)) AS top_method, max(share) AS top_share, max(longest_run) AS longest_run, max(longest_run) >= 3 AS run_warning, max(share) >= 0.4 AS share_warning FROM shares JOIN runs USING (class_id, method) GROUP BY class_id),
 span AS (SELECT class_id, strftime(min(held_on), '%Y-%m-%d') AS first_day, strftime(max(held_on), '%Y-%m-%d') AS last_day, count(*) AS lessons FROM lessons GROUP BY class_id) SELECT * FROM per JOIN last5 USING (class_id) JOIN span USING (class_id)""")
def _(spark, sf):
    out = lessons.lesson_report(view(spark, sf, "lessons"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@query("jn_05_curriculum_lookup", f"WITH {view_sql('curriculum', 'curriculum_asks')} SELECT ask_id, topic_id, title, c.state_id = 0 AS nationwide FROM curriculum_asks a JOIN curriculum c ON a.subject = c.subject AND a.class_level BETWEEN c.class_from AND c.class_to AND (c.state_id = a.state_id OR c.state_id = 0)")
def _(spark, sf):
    return lessons.curriculum_lookup(view(spark, sf, "curriculum_asks"), view(spark, sf, "curriculum"))


@query("jn_05_answered_asks", f"WITH {view_sql('curriculum', 'curriculum_asks')}, found AS (SELECT ask_id, count(*) AS n, string_agg(topic_id, ',' ORDER BY topic_id) AS topics FROM curriculum_asks a JOIN curriculum c ON a.subject = c.subject AND a.class_level BETWEEN c.class_from AND c.class_to AND (c.state_id = a.state_id OR c.state_id = 0) GROUP BY ask_id) SELECT ask_id, CAST(COALESCE(n, 0) AS INTEGER) AS n, COALESCE(topics, '') AS topics FROM curriculum_asks LEFT JOIN found USING (ask_id)")
def _(spark, sf):
    """One row per ask, those without an entry included."""
    found = lessons.answered_asks(view(spark, sf, "curriculum_asks"), view(spark, sf, "curriculum"))
    return found.select("ask_id", F.size("entries").alias("n"), F.array_join(F.col("entries.topic_id").cast("array<string>"), ",").alias("topics"))


_TOPIC = "CASE lesson_id % 3 WHEN 0 THEN p_name WHEN 1 THEN concat('Einstieg: ', split_part(p_name, ' ', 1)) ELSE 'Wiederholung' END"


@query("jn_06_topic_coverage", f"WITH {view_sql('curriculum', 'lessons')}" + f""", held AS (SELECT DISTINCT subject, unnest(string_split_regex(lower({_TOPIC}), '[^a-z]+')) AS word FROM lessons JOIN part ON p_partkey = topic_id),
 w AS (SELECT subject, topic_id, title, unnest(list_distinct(string_split(lower(title), ' '))) AS word FROM curriculum)
 SELECT subject, topic_id, title, round(count(h.word) / CAST(count(*) AS DOUBLE), 6) AS share, CASE WHEN count(h.word) / CAST(count(*) AS DOUBLE) >= 0.6 THEN 'covered' WHEN count(h.word) > 0 THEN 'partial' ELSE 'outstanding' END AS status
 FROM w LEFT JOIN held h USING (subject, word) GROUP BY subject, topic_id, title""")
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("topic_id"), "p_name")
    held = view(spark, sf, "lessons").join(parts, "topic_id").select("subject", F.expr(_TOPIC).alias("topic"))
    return lessons.topic_coverage(view(spark, sf, "curriculum"), held)


@query("jn_15_already_present", f"WITH {view_sql('curriculum')}, new AS (SELECT topic_id, state_id, subject, class_from + topic_id % 2 * 20 AS class_from, class_to FROM curriculum WHERE topic_id % 3 = 0) SELECT topic_id FROM new n WHERE EXISTS (SELECT 1 FROM curriculum c WHERE c.state_id = n.state_id AND c.subject = n.subject AND c.class_from = n.class_from AND c.class_to = n.class_to)")
def _(spark, sf):
    """Of the entries a school hands in again, those that are there already."""
    plan = view(spark, sf, "curriculum")
    new = plan.filter("topic_id % 3 = 0").withColumn("class_from", F.col("class_from") + F.col("topic_id") % 2 * 20)
    return lessons.already_present(new, plan, ["state_id", "subject", "class_from", "class_to"]).select("topic_id")


@query("jn_15_duplicate_entries", f"WITH {view_sql('curriculum')} SELECT state_id, subject, class_from, class_to, count(*) AS entries FROM curriculum GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return lessons.duplicate_entries(view(spark, sf, "curriculum"), ["state_id", "subject", "class_from", "class_to"])
