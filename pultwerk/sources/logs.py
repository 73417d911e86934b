"""Markdown logs and tables by convention → typed rows.

Each reader takes whole files (``read_files``) or any table with ``path`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.functions.text import strip, title_case


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, modified): whole files with the time of their last change."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def _field(entry: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(entry, pattern, group)), F.lit(""))


def _entries(files: DataFrame, heading: str) -> DataFrame:
    """One row per heading of the given level, with the text below it."""
    parts = F.filter(F.split("value", rf"(?m)^{heading} "), lambda p: strip(p) != "")
    keep = [c for c in files.columns if c != "value"]
    # whatever precedes the first heading is the file's own preamble
    body = F.when(F.col("value").rlike(rf"\A\s*{heading} "), parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))))
    return files.select(*keep, F.posexplode(body).alias("pos", "entry"))


def _rejected(files: DataFrame, heading: str, problem: Column) -> DataFrame:
    """(path, pos, line, reason) of the entries that have a problem; a file without a single
    entry is one too."""
    entries = _entries(files.select("path", "value"), heading)
    line = strip(F.regexp_extract("entry", r"\A([^\n]*)", 1))
    bad = entries.select("path", "pos", line.alias("line"), problem.alias("reason")).filter("reason is not null")
    bare = files.filter(~F.col("value").rlike(rf"(?m)^{heading} ")).select(
        "path", F.lit(-1).alias("pos"), strip(F.regexp_extract("value", r"\A\s*([^\n]*)", 1)).alias("line"), F.lit("no_entry").alias("reason"))
    return bad.unionByName(bare)


_LESSON = r"(?U)\A([^–\n]*?)\s*–\s*(.*?)\s+Klasse\s+([^:\n]*):\s*([^\n]*)"
_CURRICULUM = r"\A([^|\n]*)\|([^|\n]*)\|([^|\n]*)\|\s*Klasse\s*(\d+)\s*(?:[–-]\s*(\d+))?"
_CORRECTION = r"(?U)\A([^–\n]*?)\s*–\s*(\S+)\s+([^:\n]*):\s*([^\n]*)"
_POINTS = r"(?m)^- Punkte:[ \t]*([\d.,]+)\s*/\s*([\d.,]+)(?:\s*\(([\d.,]+)\s*%\))?"


def _number(entry: Column, group: int) -> Column:
    return F.replace(_field(entry, _POINTS, group), F.lit(","), F.lit(".")).try_cast("double")


def lesson_log_rejects(files: DataFrame) -> DataFrame:
    """Entries whose heading does not say when, what and for whom."""
    return _rejected(files, "##", F.when(_field(F.col("entry"), _LESSON, 1).isNull(), "heading"))


def curriculum_index_rejects(files: DataFrame) -> DataFrame:
    e = F.col("entry")
    return _rejected(files, "###", F.when(_field(e, _CURRICULUM, 1).isNull() | _field(e, _CURRICULUM, 4).isNull(), "heading"))


def correction_log_rejects(files: DataFrame) -> DataFrame:
    """Entries left out for their heading, and those kept without points they seem to have."""
    e = F.col("entry")
    unread = e.rlike(r"(?m)^- Punkte:[ \t]*\S") & (_number(e, 1).isNull() | _number(e, 2).isNull())
    return _rejected(files, "##", F.when(_field(e, _CORRECTION, 1).isNull(), "heading").when(unread, "points"))


def rubric_rejects(files: DataFrame) -> DataFrame:
    """Rubric files without a table of criteria."""
    readable = rubric_tables(files).select("path").distinct()
    return files.join(readable, "path", "left_anti").select("path", F.lit(-1).alias("pos"), F.regexp_extract("value", r"\A([^\n]*)", 1).alias("line"), F.lit("no_table").alias("reason"))


def lesson_log(files: DataFrame) -> DataFrame:
    """``## date – subject Klasse class: topic`` with goal, methods and feedback lines."""
    e, head = F.col("entry"), _LESSON
    rows = _entries(files, "##").withColumns({
        "held_on": _field(e, head, 1), "subject": _field(e, head, 2), "class_name": _field(e, head, 3), "topic": _field(e, head, 4),
        "goal": _field(e, r"(?m)^- Lernziel:[ \t]*(.*)$"), "methods": _field(e, r"(?m)^- Methoden:[ \t]*(.*)$"),
        "feedback": _field(e, r"(?m)^- Feedback nach der Stunde:[ \t]*(.*)$")})
    return rows.filter("held_on is not null").drop("entry").withColumn(
        "methods", F.transform(F.split(F.coalesce("methods", F.lit("")), ","), strip)).withColumn("methods", F.filter("methods", lambda m: m != ""))


def _bullets(entry: Column, title: str) -> Column:
    block = F.regexp_extract(entry, rf"(?m)^\*\*{title}:\*\*[ \t]*\n((?:- .*(?:\n|\z))+)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^- (.*)$"), 1), strip)


def curriculum_index(files: DataFrame) -> DataFrame:
    """``### state | school type | subject | Klasse a–b`` with contents, goals and source."""
    e, head = F.col("entry"), _CURRICULUM
    rows = _entries(files, "###").withColumns({
        "state": _field(e, head, 1), "school_type": _field(e, head, 2), "subject": _field(e, head, 3),
        "class_from": _field(e, head, 4).cast("int"), "class_to": F.coalesce(_field(e, head, 5), _field(e, head, 4)).cast("int"),
        "area": _field(e, r"(?m)^\*\*Kompetenzbereich:\*\*[ \t]*(.*)$"), "contents": _bullets(e, "Inhaltsbereiche"),
        "goals": F.transform(F.regexp_extract_all(e, F.lit(r"(?m)^- (AFB I{1,3}: .*)$"), 1), strip), "topics": _bullets(e, "Mögliche Unterrichtsthemen"),
        "source": _field(e, r"(?m)^\*\*Quelle:\*\*[ \t]*(.*)$"), "verified": _field(e, r"(?m)^\*\*Verifiziert:\*\*[ \t]*(.*)$")})
    return rows.filter("state is not null and class_from is not null").drop("entry")


def correction_log(files: DataFrame) -> DataFrame:
    """``## date – subject class: task`` with points, grade and rubric."""
    e, head = F.col("entry"), _CORRECTION
    number = lambda i: _number(e, i)
    rows = _entries(files, "##").withColumns({
        "corrected_on": _field(e, head, 1), "subject": _field(e, head, 2), "class_name": _field(e, head, 3), "task": _field(e, head, 4),
        "points": number(1), "max_points": number(2), "percent": number(3),
        "grade": _field(e, r"(?m)^- Notentendenz:[ \t]*(.*)$"), "rubric": _field(e, r"(?m)^- Bewertungsraster:[ \t]*(.*)$")})
    return rows.filter("corrected_on is not null").drop("entry")


def rubric_tables(files: DataFrame) -> DataFrame:
    """Criterion rows of the first table, and subject, class and topic from the file name."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.md\z", "")
    parts = F.split(stem, "_")
    topic = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), " ")
    table = F.regexp_extract("value", r"(?m)^\|.+\|[ \t]*\n\|[ \t:|-]+\|[ \t]*\n((?:\|.*\|[ \t]*(?:\n|\z))+)", 1)
    rows = files.select("path", stem.alias("stem"), F.concat(F.upper(F.substring(parts[0], 1, 1)), F.substr(parts[0], F.lit(2))).alias("subject"),
                        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("class_name"), F.coalesce(F.nullif(topic, F.lit("")), stem).alias("topic"),
                        F.posexplode(F.filter(F.split(table, "\n"), lambda r: strip(r) != "")).alias("pos", "row"))
    cells = F.filter(F.transform(F.split("row", r"\|"), strip), lambda c: c != "")
    points = F.coalesce(F.nullif(F.regexp_extract(F.get("cells", F.lit(1)), r"\A[+-]?\d+", 0), F.lit("")).cast("int"), F.lit(0))
    return rows.withColumn("cells", cells).filter(F.size("cells") >= 2).select(
        "path", "stem", "subject", "class_name", "topic", "pos", F.col("cells")[0].alias("criterion"), F.when(points == 0, 10).otherwise(points).alias("points"),
        F.coalesce(F.get("cells", F.lit(2)), F.lit("II")).alias("level"), F.coalesce(F.get("cells", F.lit(3)), F.lit("")).alias("description"))


def rubric_list(files: DataFrame) -> DataFrame:
    """Rubric files by last change, newest first, with a readable label."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"\.md\z", "")
    return files.withColumns({"filename": name, "label": title_case(F.replace(stem, F.lit("_"), F.lit(" ")))}).filter(
        "filename <> 'README.md' and filename like '%.md'").orderBy(F.desc("modified"), "filename")
