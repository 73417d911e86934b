"""File formats: text in each format is derived from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk.operators import usage
from pultwerk.plans.registry import query
from pultwerk.plans.written_files import new_folder, write_named
from pultwerk.sources import logs, manifest, results, roster, sse, usage_files
from pultwerk.sources.tables import table, view, view_sql


_folder = new_folder


@query("src_01_usage_files", f"WITH {view_sql('usage_events')} SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, model, input_tokens, output_tokens, skill_name FROM usage_events WHERE request_id % 13 <> 5")
def _(spark, sf):
    """Event lines with an offset behind the time; every thirteenth is cut off and left out."""
    line = F.to_json(F.struct(F.col("request_id").cast("string").alias("request_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("ts"), "user_id", "model", "provider", "input_tokens", "output_tokens", "skill_name"))
    folder = _folder(spark)
    view(spark, sf, "usage_events").select(F.when(F.col("request_id") % 13 == 5, F.substring(line, 1, 40)).otherwise(line)).write.text(folder)
    return usage_files.read_events(spark, folder).select(F.col("request_id").cast("long").alias("request_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "model", "input_tokens", "output_tokens", "skill_name")


@query("src_02_roster_files", "SELECT 'Kind ' || c_custkey AS vorname, c_name AS nachname, CASE WHEN c_nationkey % 2 = 1 THEN 'sie' ELSE '' END AS pronomen FROM customer WHERE c_custkey % 20 <> 3")
def _(spark, sf):
    """One folder of class lists with two orders of columns; rows without a first name are left out."""
    c = table(spark, sf, "customer").withColumn("first", F.when(F.col("c_custkey") % 20 == 3, F.lit("  ")).otherwise(F.concat(F.lit("Kind "), F.col("c_custkey").cast("string"))))
    folder = _folder(spark)
    for odd, columns in ((0, {"Vorname": "first", "NACHNAME": "c_name"}), (1, {"nachname": "c_name", "Pronomen": "'sie'", " Vorname ": "first"})):
        rows = c.filter(F.col("c_nationkey") % 2 == odd).selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])
        rows.write.mode("append").option("header", True).option("sep", ";").csv(folder)
    return roster.read_roster(spark, folder)


@query("src_12_report_json", f"WITH {view_sql('usage_events')} SELECT 'model' AS period, model AS key, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage_events GROUP BY model UNION ALL SELECT 'total', 'total', count(*), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT) FROM usage_events")
def _(spark, sf):
    """The whole report as JSON files by period, read back from two of its folders."""
    folder = _folder(spark)
    usage_files.write_json_report(usage.rollups(usage.with_cost(view(spark, sf, "usage_events"))), folder)
    back = spark.read.json(folder).filter("period IN ('model', 'total')")
    return back.select("period", "key", "requests", "input_tokens", "output_tokens")


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query("src_04_result_regions", "SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS \"jobId\", CAST(l_linenumber AS INTEGER) AS page, CAST(p AS INTEGER) AS pos, 'r' || p AS region_id, l_returnflag = 'A' AND p = 0 AS edited, false AS verify_failed, CAST(CASE WHEN p = 0 THEN 2 ELSE 0 END AS INTEGER) AS candidates, CAST(CASE WHEN p = 0 THEN -1 END AS INTEGER) AS char_start FROM lineitem, range(0, 2) t(p) WHERE l_partkey % 10 <> 0")
def _(spark, sf):
    """A two-region document per row; every tenth is cut off in the middle and left out."""
    l = table(spark, sf, "lineitem")
    c = lambda name, conf: F.struct(F.lit(name).alias("engine"), F.lit("Text").alias("text"), F.lit("Text").alias("rawText"), F.lit(conf).alias("confidence"))
    none = F.array().cast("array<struct<engine:string,text:string,rawText:string,confidence:double>>")
    d = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(True).alias("critical"), F.lit("number").alias("reason"))
    empty = F.array().cast("array<struct<start:int,end:int,critical:boolean,reason:string>>")
    region = lambda i, cands, dis, edited: F.struct(F.lit(f"r{i}").alias("id"), cands.alias("candidates"), dis.alias("disagreements"), edited.alias("editedByTeacher"))
    doc = F.to_json(F.struct(
        F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("jobId"),
        F.array(F.struct(F.col("l_linenumber").alias("index"), F.array(
            region(0, F.array(c("htr", 0.9), c("tesseract", 0.8)), F.array(d), F.when(F.col("l_returnflag") == "A", True)),
            region(1, none, empty, F.lit(None).cast("boolean"))).alias("regions"))).alias("pages")))
    broken = F.when(F.col("l_partkey") % 10 == 0, F.substring(doc, F.lit(1), F.floor(F.char_length(doc) / 2).cast("int"))).otherwise(doc)
    rows = results.region_rows(results.parse_documents(l.select(broken.alias("value"))))
    first = F.get("disagreements", F.lit(0))
    return rows.select("jobId", "page", "pos", "region_id", "edited", "verify_failed", F.size("candidates").alias("candidates"),
                       F.when(first.isNotNull(), F.coalesce(first["charStart"], F.lit(-1))).alias("char_start"))


_DAY = "strftime(o_orderdate, '%d.%m.%Y')"


@query("src_05_lesson_log", f"SELECT 'log/' || o_orderkey || '.md' AS path, CAST(k AS INTEGER) AS pos, {_DAY} AS held_on, 'Mathematik' AS subject, (o_custkey % 13 + 1) || 'b' AS class_name, 'Thema ' || o_orderkey % 200 AS topic, 'Ziel ' || o_orderstatus AS goal, CASE WHEN k = 0 THEN o_orderpriority || '|Stationen' ELSE o_orderpriority END AS methods, CASE WHEN k = 1 THEN 'gut' END AS feedback FROM orders, range(0, 2) t(k)")
def _(spark, sf):
    o = table(spark, sf, "orders")
    day, c = F.date_format("o_orderdate", "dd.MM.yyyy"), F.col
    def entry(methods, feedback):
        return _text("## ", day, " – Mathematik Klasse ", (c("o_custkey") % 13 + 1).cast("string"), "b: Thema ", (c("o_orderkey") % 200).cast("string"),
                     "\n- Lernziel: Ziel ", c("o_orderstatus"), "\n- Methoden: ", methods, "\n- Feedback nach der Stunde:", feedback, "\n\n")
    files = o.select(_text("log/", c("o_orderkey").cast("string"), ".md").alias("path"),
                     _text("# Vergangene Stunden\n\n", entry(_text(c("o_orderpriority"), ", Stationen"), ""), entry(c("o_orderpriority"), " gut")).alias("value"))
    return logs.lesson_log(files).withColumn("methods", F.array_join("methods", "|"))


@query("src_06_curriculum_index", "SELECT 'idx/' || p_partkey || '.md' AS path, 0 AS pos, 'Bayern' AS state, 'Gymnasium' AS school_type, p_brand AS subject, CAST(1 + p_size % 10 AS INTEGER) AS class_from, CAST(1 + p_size % 10 + p_partkey % 2 * 2 AS INTEGER) AS class_to, p_type AS area, p_name || '|Anwendung' AS contents, 'AFB I: Die SuS nennen ' || p_name || '|AFB III: Die SuS prüfen' AS goals, 'Plan ' || p_size AS source, CASE WHEN p_partkey % 3 = 0 THEN 'ja (offiziell)' ELSE 'nein (KI-Schätzung)' END AS verified FROM part")
def _(spark, sf):
    p, c = table(spark, sf, "part"), F.col
    low = 1 + c("p_size") % 10
    high = F.when(c("p_partkey") % 2 == 1, _text("–", (low + 2).cast("string"))).otherwise("")
    value = _text("# Index\n---\n### Bayern | Gymnasium | ", c("p_brand"), " | Klasse ", low.cast("string"), high, "\n**Kompetenzbereich:** ", c("p_type"),
                  "\n\n**Inhaltsbereiche:**\n- ", c("p_name"), "\n- Anwendung\n\n**Kompetenzerwartungen (Lernziele):**\n- AFB I: Die SuS nennen ", c("p_name"),
                  "\n- AFB III: Die SuS prüfen\n\n**Quelle:** Plan ", c("p_size").cast("string"), "\n**Verifiziert:** ",
                  F.when(c("p_partkey") % 3 == 0, "ja (offiziell)").otherwise("nein (KI-Schätzung)"), "\n---\n")
    files = p.select(_text("idx/", c("p_partkey").cast("string"), ".md").alias("path"), value.alias("value"))
    out = logs.curriculum_index(files).drop("topics")
    return out.withColumns({n: F.array_join(n, "|") for n in ("contents", "goals")})


@query("src_07_correction_log", "SELECT l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS path, 0 AS pos, strftime(l_shipdate, '%d.%m.%Y') AS corrected_on, 'Deutsch' AS subject, l_linenumber || 'a' AS class_name, 'Aufsatz ' || l_suppkey AS task, l_quantity + 0.5 AS points, 60.0::DOUBLE AS max_points, l_quantity AS percent, l_returnflag AS grade, 'deutsch_' || l_linenumber || '.md' AS rubric FROM lineitem")
def _(spark, sf):
    l, c = table(spark, sf, "lineitem"), F.col
    n = lambda x: c(x).cast("string")
    value = _text("# Protokoll\n\n## ", F.date_format("l_shipdate", "dd.MM.yyyy"), " – Deutsch ", n("l_linenumber"), "a: Aufsatz ", n("l_suppkey"), "\n- Punkte: ",
                  c("l_quantity").cast("int").cast("string"), ",5/60 (", c("l_quantity").cast("int").cast("string"), "%)\n- Notentendenz: ", c("l_returnflag"), "\n- Bewertungsraster: deutsch_", n("l_linenumber"), ".md\n")
    files = l.select(F.concat_ws("/", n("l_orderkey"), n("l_partkey"), n("l_suppkey"), n("l_linenumber")).alias("path"), value.alias("value"))
    return logs.correction_log(files)


@query("src_08_rubric_tables", "SELECT 'r/mathematik_7_' || replace(p_name, ' ', '_') || '.md' AS path, 'mathematik_7_' || replace(p_name, ' ', '_') AS stem, 'Mathematik' AS subject, '7' AS class_name, p_name AS topic, CAST(k AS INTEGER) AS pos, CASE WHEN k = 0 THEN p_type ELSE 'Form' END AS criterion, CAST(CASE WHEN k = 0 THEN p_size ELSE 10 END AS INTEGER) AS points, CASE WHEN k = 0 THEN 'III' ELSE 'II' END AS level, CASE WHEN k = 0 THEN p_brand ELSE '' END AS description, p_partkey AS id FROM part, range(0, 2) t(k)")
def _(spark, sf):
    p, c = table(spark, sf, "part"), F.col
    value = _text("# Bewertungsraster\n\n| Kriterium | Max. Punkte | AFB | Beschreibung |\n|---|---|---|---|\n| ", c("p_type"), " | ", c("p_size").cast("string"), " P | III | ", c("p_brand"), " |\n| Form | viele |\n\n| Prozent | Note |\n|---|---|\n| 95 | 1 |\n")
    stem = _text("r/mathematik_7_", F.replace("p_name", F.lit(" "), F.lit("_")), ".md")
    files = p.select(stem.alias("path"), value.alias("value"), "p_partkey")
    # the path repeats, so the row's key travels in the text's own table
    keyed = files.withColumn("path", F.concat_ws("#", "path", F.col("p_partkey").cast("string")))
    out = logs.rubric_tables(keyed.withColumn("path", F.regexp_replace("path", r"^(r/)(.*)#(\d+)$", "$3/$2")))
    return out.withColumn("id", F.regexp_extract("path", r"^(\d+)/", 1).cast("long")).withColumn("path", F.regexp_replace("path", r"^\d+/", "r/"))


@query("tk_05_rubric_list", "SELECT 'r/' || p_partkey || '_' || replace(p_name, ' ', '_') || '.md' AS path, p_partkey || '_' || replace(p_name, ' ', '_') || '.md' AS filename, p_partkey || ' ' || upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS label, p_retailprice AS modified FROM part WHERE p_partkey % 7 <> 0 ORDER BY modified DESC, filename")
def _(spark, sf):
    name = F.concat_ws("_", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_")))
    files = table(spark, sf, "part").select(F.concat(F.lit("r/"), F.when(F.col("p_partkey") % 7 == 0, F.lit("README")).otherwise(name), F.lit(".md")).alias("path"), F.col("p_retailprice").alias("modified"))
    return logs.rubric_list(files)


@query("src_10_streamed_output", "SELECT conv_id, turn, text, length(text) AS prompt_tokens, turn AS completion_tokens FROM conversations")
def _(spark, sf):
    """Every chat text as its stream of word pieces with noise lines, put together again."""
    t = view(spark, sf, "turns")
    pieces = F.regexp_extract_all("text", F.lit(r"(?s)(\S*\s*)"), 1)
    delta = lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))))
    usage = F.concat(F.lit("data: "), F.to_json(F.struct(F.struct(F.char_length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")).alias("usage"))))
    lines = F.concat(F.array(F.lit(": ping"), F.lit("data: {broken")), F.transform(pieces, delta), F.array(usage, F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"zu spät"}}]}')))
    return sse.reassemble(t.select("conv_id", "turn", F.posexplode(lines).alias("pos", "value")), ["conv_id", "turn"])


_FI = f"WITH {view_sql('files')}"
_MAN = ", man AS (SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, doc_id FROM files WHERE (path LIKE '%.md' OR path LIKE '%.bak1') AND NOT contains(path, '/students/'))"


def _files(spark, sf):
    student = F.when(F.col("doc_id") % 10 == 3, F.regexp_replace("path", "^memory/", "memory/students/")).otherwise(F.col("path"))
    return view(spark, sf, "files").select(student.alias("path"), F.encode("text", "utf-8").alias("content"), "doc_id")


@query("src_13_manifest", _FI.replace("concat('memory/', source", "concat('memory/', CASE WHEN doc_id % 10 = 3 THEN 'students/' ELSE '' END, source") + _MAN + " SELECT path, size, sha256 FROM man")
def _(spark, sf):
    return manifest.manifest(_files(spark, sf))


@query("src_14_manifest_check", _FI.replace("concat('memory/', source", "concat('memory/', CASE WHEN doc_id % 10 = 3 THEN 'students/' ELSE '' END, source") + _MAN + " SELECT path, CASE WHEN doc_id % 9 = 1 THEN 'missing' WHEN doc_id % 9 = 2 THEN 'size_mismatch' WHEN doc_id % 9 = 4 THEN 'unlisted' WHEN doc_id % 9 = 5 AND text_changes THEN 'hash_mismatch' ELSE 'ok' END AS status FROM (SELECT man.*, true AS text_changes FROM man)")
def _(spark, sf):
    """Files go missing, grow, change in place or appear, and the check has to say so."""
    files = _files(spark, sf)
    listed = manifest.manifest(files.filter("doc_id % 9 <> 4"))
    touched = F.when(F.col("doc_id") % 9 == 2, F.concat("content", F.lit(b"!"))).when(
        F.col("doc_id") % 9 == 5, F.concat(F.lit(b"\x00"), F.substr("content", F.lit(2)))).otherwise(F.col("content"))
    return manifest.verify(listed, manifest.manifest(files.filter("doc_id % 9 <> 1").withColumn("content", touched)))


# --- files by name, with what was not taken from them ------------------------------------

def _name():
    return F.regexp_extract("path", r"([^/]+)\z", 1)


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_suppkey").cast("string").alias("k"), "s_name")


@query("src_01_usage_rejects", f"WITH {view_sql('usage_events')} SELECT request_id, CASE request_id % 13 WHEN 5 THEN 'not_json' WHEN 7 THEN 'unreadable_time' ELSE 'no_time' END AS reason FROM usage_events WHERE request_id % 13 IN (5, 7, 9)")
def _(spark, sf):
    """Lines that were cut off, have a time nobody can read, or none."""
    time = F.when(F.col("request_id") % 13 == 7, "gestern").when(F.col("request_id") % 13 != 9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    line = F.to_json(F.struct(F.col("request_id").cast("string").alias("request_id"), time.alias("ts"), "user_id", "model", "input_tokens", "output_tokens"))
    folder = _folder(spark)
    view(spark, sf, "usage_events").select(F.when(F.col("request_id") % 13 == 5, F.rtrim(F.regexp_replace(line, r"\}\z", ""))).otherwise(line)).write.text(folder)
    return usage_files.event_rejects(spark, folder).select(F.regexp_extract("value", r'"request_id":"(\d+)"', 1).cast("long").alias("request_id"), "reason")


@query("src_02_roster_rejects", "SELECT CASE WHEN c_nationkey % 3 = 2 THEN 'header' ELSE 'name' END AS reason, count(*) AS n FROM customer WHERE c_nationkey % 3 = 2 OR c_custkey % 20 = 3 GROUP BY reason")
def _(spark, sf):
    """Lists without a column for the first name, and lines without one."""
    c = table(spark, sf, "customer").withColumn("first", F.when(F.col("c_custkey") % 20 == 3, F.lit("  ")).otherwise("Kind"))
    folder = _folder(spark)
    for kind, columns in ((0, {"Vorname": "first", "Nachname": "c_name"}), (1, {"nachname": "c_name", "Pronomen": "'er'", "vorname": "first"}), (2, {"Name": "c_name", "Nachname": "c_name"})):
        rows = c.filter(F.col("c_nationkey") % 3 == kind).selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])
        rows.write.mode("append").option("header", True).option("sep", ";").csv(folder)
    return roster.rejects(spark, folder).groupBy("reason").agg(F.count("*").alias("n"))


@query("src_04_result_files", """SELECT s_suppkey || '.json' AS file, CASE s_suppkey % 7 WHEN 3 THEN 'not_json' WHEN 4 THEN 'no_pages' WHEN 5 THEN 'wrong_type' ELSE 'read' END AS outcome,
 CAST(CASE WHEN s_suppkey % 7 IN (3, 4, 5) THEN 0 ELSE 2 END AS BIGINT) AS regions FROM supplier""")
def _(spark, sf):
    """A result file per supplier; some are cut off, badly typed or lack their pages."""
    region = lambda i: F.struct(F.lit(f"r{i}").alias("id"), F.lit("Text").alias("selectedText"), F.lit(0.5).alias("agreement"))
    whole = F.to_json(F.struct(F.concat(F.lit("job-"), "k").alias("jobId"), F.array(F.struct(F.lit(0).alias("index"), F.array(region(0), region(1)).alias("regions"))).alias("pages")))
    kind = F.col("n") % 7
    value = (F.when(kind == 3, F.substring(whole, 1, 40)).when(kind == 4, F.regexp_replace(whole, '"pages"', '"seiten"'))
             .when(kind == 5, F.regexp_replace(whole, "0\\.5", '"halb"')).otherwise(whole))
    folder = write_named(_suppliers(spark, sf).select("n", F.concat("k", F.lit(".json")).alias("path"), value.alias("value")))
    read = results.region_rows(results.read_documents(spark, folder)).groupBy(F.concat(F.regexp_extract("jobId", r"job-(.*)", 1), F.lit(".json")).alias("file")).agg(
        F.lit("read").alias("outcome"), F.count("*").alias("regions"))
    return read.unionByName(results.document_rejects(spark, folder).select(_name().alias("file"), F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("regions")))


def _read_and_rejected(read, rejected, label):
    """Entries by file and place: what was read, and why something was not."""
    return read.select(_name().alias("file"), "pos", label.alias("entry"), F.lit("read").alias("outcome")).unionByName(
        rejected.select(_name().alias("file"), "pos", F.col("line").alias("entry"), F.col("reason").alias("outcome")))


@query("src_05_lesson_files", """SELECT 'stunden_' || s_suppkey || '.md' AS file, CAST(p AS INTEGER) AS pos, CASE WHEN p = 0 THEN 'Thema ' || s_suppkey ELSE 'Ausflug ohne Datum' END AS entry, CASE WHEN p = 0 THEN 'read' ELSE 'heading' END AS outcome FROM supplier, range(0, 2) t(p) WHERE s_suppkey % 9 <> 4 AND (p = 0 OR s_suppkey % 4 = 1)
 UNION ALL SELECT 'stunden_' || s_suppkey || '.md', -1, 'leer', 'no_entry' FROM supplier WHERE s_suppkey % 9 = 4""")
def _(spark, sf):
    odd = F.when(F.col("n") % 4 == 1, "\n## Ausflug ohne Datum\n- Lernziel: keins\n").otherwise("")
    value = F.when(F.col("n") % 9 == 4, "leer").otherwise(_text("# Stunden\n\n## 3.5.2026 – Mathematik Klasse 7b: Thema ", F.col("k"), "\n- Lernziel: Ziel\n- Methoden: Stationen\n", odd))
    files = logs.read_files(spark, write_named(_suppliers(spark, sf).select("n", F.concat(F.lit("stunden_"), "k", F.lit(".md")).alias("path"), value.alias("value"))))
    return _read_and_rejected(logs.lesson_log(files), logs.lesson_log_rejects(files), F.col("topic"))


@query("src_06_curriculum_files", """SELECT 'plan_' || s_suppkey || '.md' AS file, CAST(p AS INTEGER) AS pos, CASE WHEN p = 0 THEN s_name ELSE 'Bayern | Gymnasium | ohne Klasse' END AS entry, CASE WHEN p = 0 THEN 'read' ELSE 'heading' END AS outcome FROM supplier, range(0, 2) t(p) WHERE p = 0 OR s_suppkey % 3 = 1""")
def _(spark, sf):
    odd = F.when(F.col("n") % 3 == 1, "### Bayern | Gymnasium | ohne Klasse\n").otherwise("")
    value = _text("# Index\n### Bayern | Gymnasium | Mathe | Klasse 5–7\n**Quelle:** ", F.col("s_name"), "\n\n", odd)
    files = logs.read_files(spark, write_named(_suppliers(spark, sf).select("n", F.concat(F.lit("plan_"), "k", F.lit(".md")).alias("path"), value.alias("value"))))
    return _read_and_rejected(logs.curriculum_index(files), logs.curriculum_index_rejects(files), F.col("source"))


@query("src_07_correction_files", """SELECT 'korrektur_' || s_suppkey || '.md' AS file, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN 'Aufsatz ' || s_suppkey WHEN 1 THEN 'Diktat' ELSE 'ohne Strich' END AS entry, CASE p WHEN 2 THEN 'heading' ELSE 'read' END AS outcome FROM supplier, range(0, 3) t(p) WHERE p < 2 OR s_suppkey % 5 = 2
 UNION ALL SELECT 'korrektur_' || s_suppkey || '.md', 1, '2.5.2026 – Deutsch 7a: Diktat', 'points' FROM supplier WHERE s_suppkey % 2 = 0""")
def _(spark, sf):
    """Points that cannot be read leave the entry in and are reported."""
    points = F.when(F.col("n") % 2 == 0, "viele/60").otherwise("12,5/60")
    odd = F.when(F.col("n") % 5 == 2, "## ohne Strich\n").otherwise("")
    value = _text("# Protokoll\n\n## 1.5.2026 – Deutsch 7a: Aufsatz ", F.col("k"), "\n- Punkte: 30/60 (50%)\n\n## 2.5.2026 – Deutsch 7a: Diktat\n- Punkte: ", points, "\n\n", odd)
    files = logs.read_files(spark, write_named(_suppliers(spark, sf).select("n", F.concat(F.lit("korrektur_"), "k", F.lit(".md")).alias("path"), value.alias("value"))))
    return _read_and_rejected(logs.correction_log(files), logs.correction_log_rejects(files), F.col("task"))


@query("src_08_rubric_files", """SELECT 'deutsch_7_thema_' || s_suppkey || '.md' AS file, CASE WHEN s_suppkey % 6 = 5 THEN -1 ELSE 0 END AS pos, CASE WHEN s_suppkey % 6 = 5 THEN '# Raster ohne Tabelle' ELSE 'thema ' || s_suppkey || ': ' || s_name || ' 12' END AS entry, CASE WHEN s_suppkey % 6 = 5 THEN 'no_table' ELSE 'read' END AS outcome FROM supplier""")
def _(spark, sf):
    value = F.when(F.col("n") % 6 == 5, "# Raster ohne Tabelle\n").otherwise(_text("# Raster\n\n| Kriterium | Punkte |\n|---|---|\n| ", F.col("s_name"), " | 12 P |\n"))
    files = logs.read_files(spark, write_named(_suppliers(spark, sf).select("n", F.concat(F.lit("raster/deutsch_7_thema_"), "k", F.lit(".md")).alias("path"), value.alias("value"))))
    label = F.concat("topic", F.lit(": "), "criterion", F.lit(" "), F.col("points").cast("string"))
    return _read_and_rejected(logs.rubric_tables(files), logs.rubric_rejects(files), label)


@query("src_13_inventory_files", """SELECT CASE s_suppkey % 5 WHEN 1 THEN 'notizen_' || s_suppkey || '.md.bak1' ELSE 'notizen_' || s_suppkey || '.md' END AS file, CAST(strlen(s_name) + 1 AS BIGINT) AS size, sha256(s_name || chr(10)) AS sha256, CASE WHEN s_suppkey % 3 = 0 THEN 'size_mismatch' ELSE 'ok' END AS status FROM supplier WHERE s_suppkey % 5 NOT IN (2, 3)""")
def _(spark, sf):
    """Notes and backups on disk, other files and the student area left out, checked against a second folder."""
    s, kind = _suppliers(spark, sf), F.col("n") % 5
    path = F.when(kind == 2, F.concat(F.lit("students/kind_"), "k", F.lit(".md"))).when(kind == 3, F.concat(F.lit("bild_"), "k", F.lit(".png"))).when(
        kind == 1, F.concat(F.lit("notizen_"), "k", F.lit(".md.bak1"))).otherwise(F.concat(F.lit("notizen_"), "k", F.lit(".md")))
    listed = lambda value: manifest.manifest(manifest.read_inventory(spark, write_named(s.select("n", path.alias("path"), value.alias("value"))))).withColumn("path", _name())
    first = listed(F.col("s_name"))
    later = listed(F.when(F.col("n") % 3 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return first.join(manifest.verify(first, later), "path").withColumnRenamed("path", "file")


@query("tk_05_rubric_files", "SELECT 'raster_' || s_suppkey || '.md' AS filename, 'Raster ' || s_suppkey AS label, CAST(1700000000 + (s_suppkey * 7919) % 1000003 AS BIGINT) AS modified FROM supplier WHERE s_suppkey % 8 <> 1 ORDER BY modified DESC, filename")
def _(spark, sf):
    """Rubric files by the time of their last change on disk."""
    name = F.when(F.col("n") % 8 == 1, F.concat("k", F.lit("/README.md"))).otherwise(F.concat(F.lit("raster_"), "k", F.lit(".md")))
    modified = F.lit(1700000000) + (F.col("n") * 7919) % 1000003
    files = logs.read_files(spark, write_named(_suppliers(spark, sf).select("n", name.alias("path"), F.lit("# Raster").alias("value"), modified.cast("long").alias("modified"))))
    return logs.rubric_list(files).select("filename", "label", F.unix_timestamp("modified").alias("modified"))
