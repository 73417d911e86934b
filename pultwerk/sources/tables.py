"""The parquet tables and the school-shaped views derived from them.

Each view is one projection whose expressions read the same in Spark SQL and in the SQL
used for checking, so both sides start from equal rows. Projections only: column pruning
and filters still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "usage_events": ("events", {
        "request_id": "event_id",
        "ts": "ts",
        "user_id": "CAST(user_id AS BIGINT)",
        "model": "CASE event_type WHEN 'signup' THEN 'anthropic/claude-3-haiku' WHEN 'view' THEN 'openai/gpt-4' WHEN 'click' THEN 'meta-llama/llama-2-70b-chat' WHEN 'purchase' THEN 'gpt-3.5-turbo' ELSE 'unlisted-model' END",
        "provider": "CASE WHEN event_type = 'purchase' THEN 'openai' END",
        "input_tokens": "CAST(floor(value * 1000) AS BIGINT)",
        "output_tokens": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100",
        "skill_name": "CASE user_id % 4 WHEN 1 THEN 'Klassenstatistik' WHEN 2 THEN 'Unterricht planen' WHEN 3 THEN 'a/b test' END",
    }),
    "usage_history": ("lineitem", {
        "request_id": "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))",
        "ts": "l_shipdate",
        "user_id": "l_suppkey",
        "model": "CASE l_returnflag WHEN 'A' THEN 'openai/gpt-4' WHEN 'N' THEN 'gemini-pro' ELSE 'unlisted-model' END",
        "provider": "CAST(NULL AS VARCHAR(10))",
        "input_tokens": "CAST(l_quantity AS BIGINT) * 1000",
        "output_tokens": "CAST(l_linenumber AS BIGINT) * 100",
        "skill_name": "CASE WHEN l_linestatus = 'O' THEN 'Klassenstatistik' END",
    }),
    "turns": ("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    # a user turn with an added school phrase, so that German phrase rules have something to find
    "requests": ("conversations", {
        "conv_id": "conv_id",
        "turn": "turn",
        "role": "role",
        "text": "concat(text, CASE (conv_id + turn) % 12 WHEN 0 THEN ' Bitte plane eine Stunde zum Lehrplan' WHEN 1 THEN ' Lehrplan einlesen, das muss schnell gehen' WHEN 2 THEN ' Kannst du diese Korrektur bewerten?' WHEN 3 THEN ' Zeugnis für Anna Meier' WHEN 4 THEN ' Ich bin so müde, das funktioniert nicht' WHEN 5 THEN ' Was kostet das?' WHEN 6 THEN ' Klassenarbeit Bruchrechnung am 3.5.2026 und 12/6/2027' WHEN 7 THEN ' Mathe 7a, 8b und Deutsch 15c' WHEN 8 THEN ' geboren am 01.02.2010, Tel. 030 1234567' WHEN 9 THEN ' SuS-07 schreibt an max@example.de' WHEN 10 THEN ' Noten auswerten [nicht?] und [3,5|8,5?] m' ELSE '' END)",
    }),
    "docs": ("documents", {
        "doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source",
        "classification": "CASE doc_id % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END",
    }),
    "urls": ("pages", {"page_id": "page_id", "url": "CASE page_id % 5 WHEN 0 THEN 'http://127.0.0.1:11434/api' WHEN 1 THEN replace(replace(replace(replace(url, 'http://', 'https://'), '.com/', '.com:8443/'), '.net/', '.net:8443/'), '.org/', '.org:8443/') WHEN 2 THEN replace(url, '://', '://user:pw@') WHEN 3 THEN replace(url, 'http://', 'https://') ELSE url END"}),
    "chunks": ("embeddings", {
        "chunk_id": "vec_id", "document_id": "CAST(label AS BIGINT)", "embedding": "embedding",
        "source": "concat('src', CAST(label AS VARCHAR(10)))",
        "classification": "CASE vec_id % 4 WHEN 0 THEN 'personal' ELSE 'public_curriculum' END",
    }),
    "exam_scores": ("lineitem", {
        "class_id": "l_suppkey % 20", "exam_month": "date_trunc('month', l_shipdate)",
        "student_id": "l_orderkey", "task": "CAST(l_linenumber AS BIGINT)",
        "points": "l_quantity", "max_points": "CAST(50 AS DOUBLE)",
    }),
    "rubric_rows": ("part", {
        "rubric": "p_brand", "criterion": "p_partkey", "points": "CAST(p_size AS BIGINT)",
        "level": "CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END",
    }),
    "lessons": ("orders", {
        "lesson_id": "o_orderkey", "class_id": "o_custkey", "held_on": "o_orderdate",
        "method": "o_orderpriority",
        "subject": "concat('Brand#', CAST(10 + o_custkey % 50 AS VARCHAR(10)))",
        "topic_id": "o_orderkey % 200",
    }),
    "curriculum": ("part", {
        "topic_id": "p_partkey", "subject": "p_brand", "title": "p_name",
        "class_from": "1 + p_size % 10", "class_to": "1 + p_size % 10 + p_partkey % 4",
        "state_id": "p_partkey % 5",
    }),
    "curriculum_asks": ("customer", {
        "ask_id": "c_custkey",
        "subject": "concat('Brand#', CAST(10 + c_custkey % 50 AS VARCHAR(10)))",
        "class_level": "1 + c_custkey % 13", "state_id": "1 + c_nationkey % 4",
    }),
    "review_events": ("events", {
        "event_id": "event_id", "ts": "ts", "job_id": "CAST(user_id AS BIGINT)",
        "kind": "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'complete' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'approve' ELSE CASE WHEN event_id % 3 = 0 AND user_id % 4 = 0 THEN 'fail' WHEN event_id % 3 = 2 AND user_id % 5 = 0 THEN 'delete' ELSE 'edit' END END",
        "region_id": "event_id % 5",
        "completed_as": "CASE CAST(user_id AS BIGINT) % 4 WHEN 1 THEN 'approved' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'needs_review' END ELSE 'needs_review' END",
        "error_code": "CASE WHEN event_id % 2 = 0 THEN 'cloud_blocked' END",
        "engine": "CASE event_id % 7 WHEN 0 THEN 'htr' WHEN 1 THEN 'tesseract' WHEN 2 THEN 'abacus' END",
        "text": "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 > 2 THEN concat('Text ', CAST(event_id AS VARCHAR(20))) END",
    }),
    "jobs": ("supplier", {
        "job_id": "s_suppkey",
        "classification": "CASE s_suppkey % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END",
        "status": "CASE s_suppkey % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'failed' ELSE 'approved' END",
        "unresolved_critical": "CAST(CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 0 END AS BIGINT)",
    }),
    "region_rows": ("lineitem", {
        "job_id": "l_orderkey", "page": "CAST(l_suppkey % 3 AS INT)", "region_id": "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber",
        "n_readers": "CAST(l_suppkey % 4 AS INT)", "n_disagreements": "CAST(l_partkey % 3 AS INT)",
        "critical": "l_partkey % 3 > 0 AND l_quantity > 35", "edited": "l_returnflag = 'A'",
        "agreement": "CASE WHEN l_suppkey % 4 < 2 THEN CAST(0 AS DOUBLE) ELSE 1 - l_discount END", "mean_confidence": "CAST(1 AS DOUBLE) - l_tax * 5",
        "selected_text": "concat('Text ', CAST(l_partkey AS VARCHAR(20)))", "consensus_text": "concat('[Text|Test?] ', CAST(l_partkey AS VARCHAR(20)))",
    }),
    "page_rows": ("orders", {
        "job_id": "o_orderkey", "classification": "CASE o_orderkey % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END",
        "auto_approve": "o_custkey % 2 = 0", "quality_blocking": "o_custkey % 13 = 0",
    }),
    "image_metrics": ("lineitem", {
        "image_id": "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber", "order_id": "l_orderkey",
        "width": "CAST(l_partkey % 4000 AS INT)", "height": "CAST(200 + l_orderkey % 4000 AS INT)",
        "blur_score": "l_quantity * 6", "contrast": "l_discount * 6", "brightness": "l_tax * 12",
        "skew_degrees": "l_quantity / 5 - 5", "glare_ratio": "l_discount * l_tax * 10",
    }),
    "word_boxes": ("lineitem", {
        "page_id": "l_orderkey", "box_id": "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber",
        "x0": "l_partkey % 500", "y0": "l_linenumber * 18 + l_suppkey % 15",
        "x1": "l_partkey % 500 + 40",
        "y1": "l_linenumber * 18 + l_suppkey % 15 + 8 + CAST(l_quantity AS INT) % 12",
    }),
    "students": ("customer", {
        "student_id": "c_custkey", "family_name": "c_name", "given_name": "c_mktsegment",
        "class_id": "CAST(c_nationkey AS BIGINT)",
        "pronoun": "CASE WHEN c_custkey % 2 = 0 THEN 'sie' ELSE 'er' END",
    }),
    "observations": ("orders", {
        "obs_id": "o_orderkey", "student_id": "o_custkey", "obs_date": "o_orderdate",
        "subject": "concat('Fach ', o_orderstatus)",
        "competency": "o_orderpriority", "rating": "CAST(1 + o_orderkey % 4 AS VARCHAR(5))",
        "scale": "CASE WHEN o_orderkey % 3 > 0 THEN '1-4' END",
    }),
    "files": ("documents", {
        "path": "concat('memory/', source, '/', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.md.bak1' WHEN 2 THEN '.txt' ELSE '.md' END)",
        "area": "CASE WHEN doc_id % 10 = 3 THEN 'students' ELSE source END",
        "text": "text", "doc_id": "doc_id",
    }),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TEXT_PARTITIONS = "pultwerk.text.partitions"


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table, as it is scanned, unless the session names a number of partitions.

    A small file in one row group is one task whatever the split size; the setting is for
    local runs over such files.
    """
    keys = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}[name]
    wanted = spark.conf.get(TEXT_PARTITIONS, None)
    return table(spark, sf_dir, name).repartition(int(wanted), *keys) if wanted else table(spark, sf_dir, name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    source = texts(spark, sf_dir, base) if base in ("documents", "conversations") else table(spark, sf_dir, base)
    return source.selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])


def view_sql(*names: str) -> str:
    """The same views as CTEs, without the leading WITH."""
    parts = []
    for name in names:
        base, columns = VIEWS[name]
        body = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {base})")
    return ", ".join(parts)
