"""Students, pseudonyms, observations and profile normalisation."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import text as tx
from pultwerk.operators import normalise, pseudonym, records
from pultwerk.plans.privacy_queries import _REQ
from pultwerk.plans.registry import query, quote, sql_list, values
from pultwerk.session import shared_dir
from pultwerk.sources import record_store, roster
from pultwerk.sources.tables import table, view, view_sql

_STU = f"WITH {view_sql('students')} "
_OBS = f"WITH {view_sql('students', 'observations')} "


@query("src_02_class_roster", _STU + "SELECT student_id, upper(given_name) AS vorname, family_name AS nachname, pronoun AS pronomen FROM students WHERE student_id % 9 <> 0")
def _(spark, sf):
    """Roster lines as a school would send them: padded cells, some without a given name."""
    s = view(spark, sf, "students")
    cell = F.when(F.col("student_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("given_name"), F.lit("  ")))
    lines = s.select("student_id", F.concat_ws(";", cell, F.concat(F.lit(" "), F.col("family_name")), "pronoun").alias("value"))
    return roster.parse_lines(lines, " Vorname ;NACHNAME;Pronomen").select("student_id", "vorname", "nachname", "pronomen")


_LATEST = ", latest AS (SELECT student_id, subject, competency, rating, scale, obs_date FROM observations QUALIFY row_number() OVER (PARTITION BY student_id, subject, competency ORDER BY obs_date DESC, obs_id DESC) = 1) "


@query("src_03_student_records", _OBS + _LATEST + """SELECT s.student_id AS id, 1 AS schema_version, given_name AS vorname, family_name AS nachname, pronoun AS pronomen, class_id AS klasse, subject, competency, rating, scale
 FROM students s LEFT JOIN latest l USING (student_id)""")
def _(spark, sf):
    """Records nested to JSON, parsed again with the explicit schema and flattened."""
    ratings = records.latest_ratings(view(spark, sf, "observations"))
    parsed = records.parse_records(records.nested_records(view(spark, sf, "students"), ratings))
    flat = parsed.select("id", "schema_version", "identity.*", "klasse", F.explode_outer("competencies").alias("subject", "c"))
    return flat.select("id", "schema_version", "vorname", "nachname", "pronomen", "klasse", "subject", F.explode_outer("c").alias("competency", "e")).select(
        "id", "schema_version", "vorname", "nachname", "pronomen", "klasse", "subject", "competency", "e.rating", "e.scale")


@query("prj_12_school_year", f"WITH {view_sql('lessons')} SELECT lesson_id, CASE WHEN month(held_on) >= 8 THEN year(held_on) || '/' || right(CAST(year(held_on) + 1 AS VARCHAR), 2) ELSE (year(held_on) - 1) || '/' || right(CAST(year(held_on) AS VARCHAR), 2) END AS school_year FROM lessons")
def _(spark, sf):
    return view(spark, sf, "lessons").select("lesson_id", records.school_year(F.col("held_on")).alias("school_year"))


@query("prj_13_rating_label", _OBS + "SELECT obs_id, CASE WHEN obs_id % 11 = 0 THEN '' WHEN scale IS NULL THEN rating ELSE rating || ' / ' || string_split(scale, '-')[-1] END AS label FROM observations")
def _(spark, sf):
    rating = F.when(F.col("obs_id") % 11 != 0, F.col("rating"))
    return view(spark, sf, "observations").select("obs_id", records.rating_label(rating, F.col("scale")).alias("label"))


@query("prj_14_slugs", "SELECT p_partkey AS id, lower(p_brand || '_' || p_size || '_' || p_name) AS raw, regexp_replace(lower(p_brand || '_' || p_size || '_' || p_name), '[^a-z0-9_]+', '_', 'g') AS rubric_file, left(regexp_replace(lower(p_type || ' -- ' || p_name || '/' || p_type || '/' || p_name || '/' || p_brand || '!' || p_name), '[^a-z0-9_-]+', '_', 'g'), 60) AS export_name FROM part")
def _(spark, sf):
    c = F.col
    title = F.concat(c("p_type"), F.lit(" -- "), c("p_name"), F.lit("/"), c("p_type"), F.lit("/"), c("p_name"), F.lit("/"), c("p_brand"), F.lit("!"), c("p_name"))
    return table(spark, sf, "part").select(
        c("p_partkey").alias("id"), F.lower(F.concat_ws("_", "p_brand", c("p_size").cast("string"), "p_name")).alias("raw"),
        tx.rubric_slug(c("p_brand"), c("p_size").cast("string"), c("p_name")).alias("rubric_file"), tx.export_slug(title).alias("export_name"))


@query("prj_15_students_of_class", _STU + "SELECT * FROM students WHERE class_id = 7")
def _(spark, sf):
    return records.in_class(view(spark, sf, "students"), 7)


@query("prj_21_record_checksum", _STU + """SELECT student_id, sha256('{"class_id":' || class_id || ',"family_name":"' || family_name || '","given_name":"' || given_name || '","pronoun":"' || pronoun || '","student_id":' || student_id || '}') AS checksum FROM students""")
def _(spark, sf):
    s = view(spark, sf, "students")
    return s.select("student_id", F.sha2(F.to_json(F.struct(*sorted(s.columns))), 256).alias("checksum"))


def _names(spark, sf):
    return view(spark, sf, "students").select(F.col("family_name").alias("name"), F.col("student_id").alias("seen"))


_ALIAS = "CASE WHEN {i} < 10 THEN 'SuS-0' ELSE 'SuS-' END || {i}"
_MAP = f"amap AS (SELECT family_name AS real, student_id, row_number() OVER (ORDER BY student_id) AS idx FROM students)"


@query("wn_11_aliases", _STU + f", {_MAP} SELECT real, {_ALIAS.format(i='idx')} AS alias, student_id AS first_seen, idx FROM amap")
def _(spark, sf):
    return pseudonym.assign_aliases(_names(spark, sf))


@query("wn_11_aliases_skipping_taken", _STU + f""", known AS (SELECT family_name AS real, row_number() OVER (ORDER BY student_id) AS n FROM students WHERE student_id % 3 = 0),
 free AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM range(1, (SELECT 2 * count(*) + 2 FROM students)) r(i) WHERE i > (SELECT count(*) FROM known) AND i NOT IN (SELECT n * 2 FROM known)),
 fresh AS (SELECT family_name AS real, row_number() OVER (ORDER BY student_id) AS k FROM students WHERE student_id % 3 <> 0)
 SELECT real, {_ALIAS.format(i='(n * 2)')} AS alias FROM known UNION ALL SELECT real, {_ALIAS.format(i='i')} FROM fresh JOIN free USING (k)""")
def _(spark, sf):
    """A third of the names already has an alias (even numbers only), so gaps are filled."""
    names = _names(spark, sf)
    first = pseudonym.assign_aliases(names.filter("seen % 3 = 0"))
    known = first.withColumn("idx", F.col("idx") * 2).withColumn("alias", pseudonym.alias_text(F.col("idx")))
    return pseudonym.assign_aliases(names, known, by_count=True).select("real", "alias")


_NOTE = "concat(c_name, ' half ', '{o}', c_name, 'x und x', c_name, '; ', c_name, '.')"


@query("sc_07_pseudonymize", _OBS + f""", {_MAP} SELECT obs_id AS doc_id, {_ALIAS.format(i='a.idx')} || ' half ' || {_ALIAS.format(i='b.idx')} || ', ' || a.real || 'x und x' || a.real || '; ' || {_ALIAS.format(i='a.idx')} || '.' AS pseudonymized
 FROM observations o JOIN amap a ON a.student_id = o.student_id JOIN amap b ON b.student_id = (o.obs_id * 7 + 3) % (SELECT count(*) FROM students)""")
def _(spark, sf):
    """Every observation names two students; 'name + x' must stay untouched."""
    students = view(spark, sf, "students").count()
    obs = view(spark, sf, "observations").select("obs_id", "student_id", ((F.col("obs_id") * 7 + 3) % students).alias("other_id"))
    s = view(spark, sf, "students").select("student_id", F.col("family_name").alias("a"))
    other = s.select(F.col("student_id").alias("other_id"), F.col("a").alias("b"))
    texts = obs.join(s, "student_id").join(other, "other_id").select(
        F.col("obs_id").alias("doc_id"), F.expr("concat(a, ' half ', b, ', ', a, 'x und x', a, '; ', a, '.')").alias("text"), F.array("a", "b").alias("names"))
    return pseudonym.pseudonymize(texts, pseudonym.assign_aliases(_names(spark, sf))).select("doc_id", "pseudonymized")


@query("sc_08_restore", _OBS + f""", {_MAP} SELECT obs_id AS doc_id, a.real || ' half ' || COALESCE(b.real, {_ALIAS.format(i='(o.obs_id % (SELECT count(*) + count(*) // 8 FROM students) + 1)')}) || '!' AS restored
 FROM observations o JOIN amap a ON a.idx = o.student_id + 1 LEFT JOIN amap b ON b.idx = o.obs_id % (SELECT count(*) + count(*) // 8 FROM students) + 1""")
def _(spark, sf):
    students = view(spark, sf, "students").count()
    texts = view(spark, sf, "observations").select(F.col("obs_id").alias("doc_id"), F.concat(
        pseudonym.alias_text(F.col("student_id") + 1), F.lit(" half "), pseudonym.alias_text(F.col("obs_id") % (students + students // 8) + 1), F.lit("!")).alias("text"))
    return pseudonym.restore(texts, pseudonym.assign_aliases(_names(spark, sf))).select("doc_id", "restored")


@query("jn_09_name_reinsertion", _OBS + """, p AS (SELECT o.obs_id, s.pronoun = 'sie' AS f, CASE WHEN s.student_id % 10 = 0 THEN 'SuS-' || s.student_id ELSE s.given_name END AS name FROM observations o JOIN students s USING (student_id))
 SELECT obs_id, name || ' zeigt, dass ' || CASE WHEN f THEN 'sie' ELSE 'er' END || ' ' || CASE WHEN f THEN 'ihr' ELSE 'sein' END || ' Ziel kennt. ' || CASE WHEN f THEN 'Ihr Heft hilft ihr; sie' ELSE 'Sein Heft hilft ihm; ihn' END || '. ' || CASE WHEN f THEN 'SIE' ELSE 'ER' END[1] || CASE WHEN f THEN 'ie' ELSE 'r' END AS filled FROM p""")
def _(spark, sf):
    text = F.lit("{NAME} zeigt, dass {er/sie} {sein/ihr} Ziel kennt. {Sein/Ihr} Heft hilft {ihm/ihr}; {ihn/sie}. {ER/SIE}")
    notes = view(spark, sf, "observations").select("obs_id", "student_id", text.alias("text"))
    who = view(spark, sf, "students").select(
        "student_id", F.when(F.col("student_id") % 10 != 0, F.col("given_name")).otherwise("").alias("given_name"),
        F.concat(F.lit("SuS-"), F.col("student_id").cast("string")).alias("alias"), "pronoun")
    return pseudonym.reinsert_names(notes, who).join(who.select("student_id"), "student_id", "left_semi").select("obs_id", "filled")


def _erasures(spark, sf):
    return view(spark, sf, "students").filter("student_id % 17 = 0").select("student_id")


@query("jn_10_erasure", _OBS + "SELECT student_id, obs_id, competency FROM observations WHERE student_id NOT IN (SELECT student_id FROM students WHERE student_id % 17 = 0)")
def _(spark, sf):
    return records.erase(view(spark, sf, "observations"), _erasures(spark, sf)).select("student_id", "obs_id", "competency")


def _learner_tables(spark, sf):
    """All tables that hold something on a learner, written to a folder of their own."""
    root = f"{shared_dir(spark)}/learners/{uuid.uuid4().hex}"
    s, o = view(spark, sf, "students"), view(spark, sf, "observations")
    name = F.concat_ws(" ", "given_name", "family_name")
    record_store.create(
        root, s, o, s.select(name.alias("real"), pseudonym.alias_text(F.col("student_id") + 1).alias("alias")),
        o.select(F.col("obs_id").alias("document_id"), F.concat_ws(": ", "subject", "competency").alias("chunk")))
    return root


@query("jn_10_erasure_everywhere", _OBS + """, left_over AS (SELECT * FROM students WHERE student_id % 17 <> 0), notes AS (SELECT o.* FROM observations o WHERE student_id NOT IN (SELECT student_id FROM students WHERE student_id % 17 = 0))
 SELECT 'records' AS held_in, CAST(student_id AS VARCHAR) AS key, count(*) AS n FROM left_over GROUP BY ALL UNION ALL SELECT 'index', CAST(student_id AS VARCHAR), count(*) FROM left_over GROUP BY ALL
 UNION ALL SELECT 'versions', CAST(student_id AS VARCHAR), count(*) FROM left_over WHERE student_id % 5 = 0 GROUP BY ALL UNION ALL SELECT 'aliases', given_name || ' ' || family_name, count(*) FROM left_over GROUP BY ALL
 UNION ALL SELECT 'observations', CAST(student_id AS VARCHAR), count(*) FROM notes GROUP BY ALL UNION ALL SELECT 'chunks', CAST(obs_id AS VARCHAR), count(*) FROM notes GROUP BY ALL""")
def _(spark, sf):
    """Learners are patched, then some are erased; what is left in the files of every table."""
    root = _learner_tables(spark, sf)
    patches = view(spark, sf, "students").filter("student_id % 5 = 0").selectExpr("student_id", "CAST(NULL AS STRING) AS given_name", "CAST(NULL AS STRING) AS family_name", "class_id + 1 AS class_id", "CAST(NULL AS STRING) AS pronoun")
    record_store.upsert(spark, root, patches, ["given_name", "family_name", "class_id", "pronoun"])
    record_store.erase(spark, root, _erasures(spark, sf))
    parts = [record_store.raw(spark, root, t).groupBy(F.lit(t.name).alias("held_in"), F.col(t.key).cast("string").alias("key")).agg(F.count("*").alias("n")) for t in record_store.LEARNER_TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("rc_01_index_in_step", _STU + """, p AS (SELECT CASE WHEN student_id % 5 = 0 THEN student_id ELSE student_id + 1000000 END AS student_id, CASE WHEN student_id % 2 = 0 THEN 'neu' END AS given_name, student_id % 3 AS class_id FROM students WHERE student_id % 5 < 2)
 SELECT COALESCE(p.student_id, s.student_id) AS student_id, COALESCE(p.class_id, s.class_id) AS class_id, concat_ws(' ', COALESCE(p.given_name, s.given_name), family_name) AS name FROM students s FULL JOIN p ON p.student_id = s.student_id""")
def _(spark, sf):
    """The list view after records were patched and added."""
    root = _learner_tables(spark, sf)
    patches = view(spark, sf, "students").filter("student_id % 5 < 2").selectExpr(
        "CASE WHEN student_id % 5 = 0 THEN student_id ELSE student_id + 1000000 END AS student_id",
        "CASE WHEN student_id % 2 = 0 THEN 'neu' END AS given_name", "cast(NULL AS string) AS family_name", "student_id % 3 AS class_id", "cast(NULL AS string) AS pronoun")
    record_store.upsert(spark, root, patches, ["given_name", "family_name", "class_id", "pronoun"])
    return record_store.read(spark, root, record_store.Kept("index"))


@query("jn_14_access_rows", _OBS + """SELECT student_id, 'student' AS kind, '{"family_name":"' || family_name || '","class_id":' || class_id || '}' AS payload FROM students WHERE student_id % 17 = 0
 UNION ALL SELECT student_id, 'observation', '{"obs_id":' || obs_id || ',"rating":"' || rating || '"}' FROM observations WHERE student_id IN (SELECT student_id FROM students WHERE student_id % 17 = 0)""")
def _(spark, sf):
    return records.access_rows(_erasures(spark, sf), {
        "student": view(spark, sf, "students").select("student_id", "family_name", "class_id"),
        "observation": view(spark, sf, "observations").select("student_id", "obs_id", "rating")})


@query("rc_01_record_upsert", _STU + """, p AS (SELECT CASE WHEN student_id % 5 = 0 THEN student_id ELSE student_id + 1000000 END AS student_id, CASE WHEN student_id % 2 = 0 THEN 'neu' END AS given_name, student_id % 3 AS class_id FROM students WHERE student_id % 5 < 2)
 SELECT COALESCE(p.student_id, s.student_id) AS student_id, COALESCE(p.given_name, s.given_name) AS given_name, family_name, COALESCE(p.class_id, s.class_id) AS class_id FROM students s FULL JOIN p ON p.student_id = s.student_id""")
def _(spark, sf):
    s = view(spark, sf, "students")
    patches = s.filter("student_id % 5 < 2").selectExpr(
        "CASE WHEN student_id % 5 = 0 THEN student_id ELSE student_id + 1000000 END AS student_id",
        "CASE WHEN student_id % 2 = 0 THEN 'neu' END AS given_name", "cast(NULL AS string) AS family_name", "student_id % 3 AS class_id")
    return records.upsert(s, patches, "student_id", ["given_name", "family_name", "class_id"])


@query("rc_02_latest_ratings", _OBS + _LATEST + "SELECT student_id, subject, competency, rating, scale, strftime(obs_date, '%Y-%m-%d') AS obs_date FROM latest")
def _(spark, sf):
    return records.latest_ratings(view(spark, sf, "observations")).withColumn("obs_date", F.date_format("obs_date", "yyyy-MM-dd"))


@query("tk_06_competency_rows", _OBS + _LATEST + "SELECT student_id, subject, competency, CASE WHEN scale IS NULL THEN rating ELSE rating || ' / 4' END AS label FROM latest ORDER BY 1, 2, 3")
def _(spark, sf):
    return records.competency_rows(records.latest_ratings(view(spark, sf, "observations")))


@query("ag_23_shared_difficulties", _OBS + "SELECT competency, count(DISTINCT student_id) AS learners FROM observations GROUP BY competency HAVING learners > 1")
def _(spark, sf):
    return records.shared_difficulties(view(spark, sf, "observations"))


_RAW = "CASE c_custkey % 5 WHEN 0 THEN lower({n}) WHEN 1 THEN concat(substring({n}, 1, 2), substring({n}, 4, 40)) WHEN 2 THEN concat(' ', {n}, 'x') WHEN 3 THEN {a} ELSE concat('Atlantis ', CAST(c_custkey % 40 AS VARCHAR(10))) END"


def _nearest_sql(names, limit, aliases) -> str:
    alias_case = "CASE lower(trim(raw)) " + " ".join(f"WHEN {quote(a)} THEN {quote(n)}" for a, n in aliases) + " END" if aliases else "NULL"
    return f""", {values('names', 'pos, name', list(enumerate(names)))}, uniq AS (SELECT DISTINCT raw FROM base),
 best AS (SELECT raw, name, levenshtein(lower(trim(raw)), lower(name)) AS d FROM uniq, names QUALIFY row_number() OVER (PARTITION BY raw ORDER BY d, pos) = 1)
 SELECT row_id, raw, COALESCE({alias_case}, CASE WHEN d <= {limit} THEN name END, raw) AS name FROM base JOIN best USING (raw)"""


def _raw_expr(names: str, alias: str) -> str:
    return _RAW.format(n=names, a=alias)


_STATES_SQL = f"WITH base AS (SELECT c_custkey AS row_id, {_raw_expr(sql_list(fv.STATES) + '[1 + c_custkey % 16]', sql_list([a for a, _ in fv.STATE_ALIASES]) + '[1 + c_custkey % 9]')} AS raw FROM customer)"
_TYPES_SQL = f"WITH base AS (SELECT c_custkey AS row_id, {_raw_expr(sql_list(fv.SCHOOL_TYPES) + '[1 + c_custkey % 16]', quote('IGS'))} AS raw FROM customer)"


def _spark_names(names):
    return "element_at(array(" + ", ".join(quote(n) for n in names) + "), cast(1 + c_custkey % {n} AS int))".format(n=len(names))


@query("jn_08_state_names", _STATES_SQL + _nearest_sql(fv.STATES, fv.STATE_MAX_EDITS, fv.STATE_ALIASES))
def _(spark, sf):
    raw = F.expr(_raw_expr(_spark_names(fv.STATES), _spark_names([a for a, _ in fv.STATE_ALIASES])))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), raw.alias("raw"))
    return base.withColumn("name", normalise.state_name(F.col("raw"))).select("row_id", "raw", "name")


@query("jn_08_school_types", _TYPES_SQL + _nearest_sql(fv.SCHOOL_TYPES, fv.SCHOOL_TYPE_MAX_EDITS, []))
def _(spark, sf):
    raw = F.expr(_raw_expr(_spark_names(fv.SCHOOL_TYPES), quote("IGS")))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), raw.alias("raw"))
    return base.withColumn("name", normalise.school_type(F.col("raw"))).select("row_id", "raw", "name")


_FACH = [k for k, _ in fv.SUBJECT_NAMES]
_FACH_RAW = "CASE c_custkey % 4 WHEN 0 THEN {k} WHEN 1 THEN concat(upper({k}), ' LK 12') WHEN 2 THEN concat('philosophie', '-', CAST(c_custkey AS VARCHAR(10))) ELSE concat('9 ', {k}) END"


@query("sc_10_subject_names", f"WITH base AS (SELECT c_custkey AS row_id, {_FACH_RAW.format(k=sql_list(_FACH) + f'[1 + c_custkey % {len(_FACH)}]')} AS raw FROM customer), {values('fach', 'key, name', fv.SUBJECT_NAMES)}, parts AS (SELECT *, regexp_extract(raw, '^([a-zA-ZäöüÄÖÜß]+)(.*)$', 1) AS word, regexp_extract(raw, '^([a-zA-ZäöüÄÖÜß]+)(.*)$', 2) AS rest FROM base) SELECT row_id, raw, CASE WHEN word = '' THEN raw ELSE COALESCE(name, upper(word[1]) || word[2:]) || rest END AS name FROM parts LEFT JOIN fach ON key = lower(word)")
def _(spark, sf):
    raw = F.expr(_FACH_RAW.format(k=_spark_names(_FACH)))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), raw.alias("raw"))
    return base.withColumn("name", normalise.subject_name(F.col("raw")))


_LEVELS = r"regexp_extract_all({c}, '(?i)\b(\d{{1,2}})\s*[a-zäöüß]?\b', 1)"


@query("sc_11_class_levels", _REQ + f"SELECT conv_id, turn, array_to_string(list_transform({_LEVELS.format(c='text')}, lambda x: CAST(x AS INTEGER)), ',') AS levels, len(list_filter({_LEVELS.format(c='text')}, lambda x: CAST(x AS INTEGER) < 1 OR CAST(x AS INTEGER) > 13)) > 0 AS has_invalid FROM requests")
def _(spark, sf):
    levels = normalise.class_levels(F.col("text"))
    return view(spark, sf, "requests").select("conv_id", "turn", F.array_join(F.transform(levels, lambda n: n.cast("string")), ",").alias("levels"),
                                              (F.size(normalise.invalid_levels(F.col("text"))) > 0).alias("has_invalid"))


@query("sc_11_class_levels_docs", f"WITH {view_sql('docs')} SELECT doc_id, array_to_string(list_transform({_LEVELS.format(c='text')}, lambda x: CAST(x AS INTEGER)), ',') AS levels FROM docs")
def _(spark, sf):
    return view(spark, sf, "docs").select("doc_id", F.array_join(F.transform(normalise.class_levels(F.col("text")), lambda n: n.cast("string")), ",").alias("levels"))


@query("sc_12_class_label", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN p_size > 13 THEN 'range' END WHEN 2 THEN 'format' ELSE NULL END AS problem FROM part")
def _(spark, sf):
    label = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN concat(' ', p_size, ' b') WHEN 2 THEN concat(p_size, 'ab') ELSE '7Ä' END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), normalise.class_label_problem(label).alias("problem"))
