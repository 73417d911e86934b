"""Privacy, routing-policy and request-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import privacy as px
from pultwerk.operators import privacy, routing
from pultwerk.plans.registry import query, quote, sql_list, values
from pultwerk.sources.tables import table, view, view_sql

# word edges for an engine whose \b is ASCII: a character that is no letter, digit or underscore
_L, _R = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
_PATTERNS = {
    "birth_date": f"(?i){_L}(?:{fv.BIRTH_WORDS}){fv.BIRTH_GAP_DATE}{_R}",
    "email": fv.EMAIL_PATTERN,
    "person_name": f"{_L}(?:{fv.NAME_LEAD_WORDS})\\s+{fv.CAPITALISED_NAME}",
    "phone": fv.PHONE_PATTERN,
    "student_context": f"(?i){_L}(?:{fv.STUDENT_WORDS}){_R}",
    "student_identifier": f"(?i){_L}{fv.STUDENT_ID}{_R}",
}


def findings_sql(col: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({col}, {quote(p)}) THEN '{n}' END" for n, p in _PATTERNS.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def redact_sql(col: str) -> str:
    masked = f"regexp_replace(regexp_replace({col}, {quote(fv.EMAIL_PATTERN)}, '[E-Mail]', 'g'), {quote(fv.PHONE_PATTERN)}, '[Telefon]', 'g')"
    return (f"CASE WHEN regexp_matches({masked}, '(?i)(geb|geboren|geburtstag|geburtsdatum)') AND regexp_matches({masked}, {quote('(?i)(geb' + _R + '|geboren|geburtstag|geburtsdatum)')}) "
            f"THEN regexp_replace({masked}, {quote(chr(92) + 'b' + fv.REDACTED_DATE + chr(92) + 'b')}, '[Datum]', 'g') ELSE {masked} END")


def skill_sql(col: str) -> str:
    rows = [(len(t), -p, t, s) for p, (s, ts) in enumerate(fv.SKILLS) for t in ts]
    rows.sort(key=lambda r: (-r[0], -r[1]))
    return "CASE " + " ".join(f"WHEN contains(lower({col}), {quote(t)}) THEN {quote(s)}" for _, _, t, s in rows) + " END"


def join_list(expr):
    return F.array_join(expr, ",")


for _name, _view, _key in (("docs", "docs", "doc_id"), ("requests", "requests", "conv_id, turn")):
    def _make(v, keys):
        def findings_query(spark, sf):
            return view(spark, sf, v).select(*keys.split(", "), join_list(px.findings(F.col("text"))).alias("findings"))

        def redact_query(spark, sf):
            return view(spark, sf, v).select(*keys.split(", "), px.redact(F.col("text")).alias("redacted"))

        def labels_query(spark, sf):
            found = px.finding_labels(px.findings(F.col("text")))
            return view(spark, sf, v).select(*keys.split(", "), F.explode(found).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
        return findings_query, redact_query, labels_query

    _f, _r, _l = _make(_view, _key)
    _with = f"WITH {view_sql(_view)} "
    query(f"sc_01_findings_{_name}", _with + f"SELECT {_key}, array_to_string({findings_sql('text')}, ',') AS findings FROM {_view}")(_f)
    query(f"sc_03_redact_{_name}", _with + f"SELECT {_key}, {redact_sql('text')} AS redacted FROM {_view}")(_r)
    query(f"sc_05_finding_labels_{_name}", _with + f", {values('labels_of', 'name, label', fv.FINDING_LABELS)}, hits AS (SELECT unnest({findings_sql('text')}) AS name FROM {_view}) SELECT label, count(*) AS n FROM hits JOIN labels_of USING (name) GROUP BY label")(_l)


@query("sc_02_string_leaves", f"WITH {view_sql('requests')} SELECT conv_id, turn, role || '|' || text || '|Bayern|Gymnasium' AS leaves, 4 AS n FROM requests")
def _(spark, sf):
    nested = view(spark, sf, "requests").withColumn("request", F.struct(
        F.array(F.struct("role", "text")).alias("messages"), F.col("turn").alias("number"),
        F.create_map(F.lit("bundesland"), F.lit("Bayern"), F.lit("schulform"), F.lit("Gymnasium")).alias("profile")))
    leaves = px.string_leaves(F.col("request"), nested.schema["request"].dataType)
    return nested.select("conv_id", "turn", F.array_join(leaves, "|").alias("leaves"), F.size(leaves).alias("n"))


_SKILL_COL = "CASE conv_id % 4 WHEN 0 THEN 'zeugnis_formulieren' WHEN 1 THEN 'lehrplan_einlesen' WHEN 2 THEN 'klassenstatistik' END"
_REQ_COL = "CASE WHEN turn % 5 = 4 THEN 'local_required' ELSE 'auto' END"
_STICKY_COL = "CASE WHEN conv_id % 6 = 5 THEN 'local_required' ELSE 'auto' END"


@query("sc_04_privacy_decision", f"""WITH {view_sql('requests')}, base AS (SELECT conv_id, turn, {_SKILL_COL} AS skill_id, {_REQ_COL} AS requested_mode, {_STICKY_COL} AS sticky_mode,
  CASE (conv_id + turn) % 4 WHEN 0 THEN ['public_curriculum'] WHEN 1 THEN ['public_curriculum', 'personal'] WHEN 2 THEN ['student_submission'] ELSE [] END AS classes, {findings_sql('text')} AS f FROM requests),
 r AS (SELECT conv_id, turn, list_sort(list_filter(list_concat([
   CASE WHEN requested_mode = 'local_required' THEN 'user_requested_local' END,
   CASE WHEN sticky_mode = 'local_required' THEN 'chat_already_local' END,
   CASE WHEN skill_id IN {tuple(fv.SENSITIVE_SKILLS)} THEN 'sensitive_skill:' || skill_id END,
   CASE WHEN len(list_filter(classes, lambda x: x <> 'public_curriculum')) > 0 THEN 'document_not_public' END,
   CASE WHEN list_contains(classes, 'student_submission') THEN 'student_submission' END], list_transform(f, lambda x: 'personal_data:' || x)), lambda x: x IS NOT NULL)) AS rs FROM base)
 SELECT conv_id, turn, CASE WHEN len(rs) > 0 THEN 'local_required' ELSE 'cloud_allowed' END AS mode, array_to_string(rs, ',') AS reasons FROM r""")
def _(spark, sf):
    base = view(spark, sf, "requests").selectExpr(
        "conv_id", "turn", "array(text) AS texts", f"{_SKILL_COL} AS skill_id", f"{_REQ_COL} AS requested_mode", f"{_STICKY_COL} AS sticky_mode",
        "CASE (conv_id + turn) % 4 WHEN 0 THEN array('public_curriculum') WHEN 1 THEN array('public_curriculum', 'personal') WHEN 2 THEN array('student_submission') ELSE cast(array() AS array<string>) END AS classifications")
    return privacy.decide(base).select("conv_id", "turn", "mode", join_list(F.col("reasons")).alias("reasons"))


@query("so_03_document_reasons", f"""WITH {view_sql('docs')} SELECT source, classification, count(*) AS n, count(*) FILTER (classification <> 'public_curriculum') AS not_public,
 count(*) FILTER (classification = 'student_submission') AS submissions FROM docs GROUP BY ALL""")
def _(spark, sf):
    reasons = privacy.document_reasons(F.array("classification"))
    return view(spark, sf, "docs").withColumn("r", reasons).groupBy("source", "classification").agg(
        F.count("*").alias("n"), F.count_if(F.array_contains("r", "document_not_public")).alias("not_public"),
        F.count_if(F.array_contains("r", "student_submission")).alias("submissions"))


_PROFILE = ["bundesland", "schulform", "faecher", "style_formality", "style_detail"]


@query("prj_06_minimal_profile", "SELECT c_custkey AS id, 'bundesland=' || c_nationkey || ',schulform=' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ',style_detail=kurz' ELSE '' END AS profile FROM customer")
def _(spark, sf):
    profile = F.create_map(F.lit("name"), F.col("c_name"), F.lit("bundesland"), F.col("c_nationkey").cast("string"),
                           F.lit("schulform"), F.col("c_mktsegment"), F.lit("guthaben"), F.col("c_acctbal").cast("string"),
                           F.when(F.col("c_custkey") % 2 == 0, "style_detail").otherwise("vorname"), F.lit("kurz"))
    kept = F.transform(F.map_entries(privacy.minimal_profile(profile)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(kept), ",").alias("profile"))


@query("prj_08_route_model", f"WITH {view_sql('requests')} SELECT conv_id, turn, CASE WHEN conv_id % 4 IN (0, 2) THEN 'ollama' ELSE 'openai/gpt-4' END AS model FROM requests")
def _(spark, sf):
    return view(spark, sf, "requests").select("conv_id", "turn", privacy.route_model(F.expr(_SKILL_COL), F.lit("openai/gpt-4")).alias("model"))


_URLSQL = f"""WITH {view_sql('urls')}, p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS auth FROM urls),
 q AS (SELECT *, regexp_extract(auth, '^(.*)@', 1) AS userinfo, regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '') AS host, regexp_extract(auth, ':([0-9]*)$', 1) AS port FROM p),
 c AS (SELECT page_id, url, host, CASE WHEN scheme <> 'https' OR host = '' THEN 'not_https' WHEN userinfo <> '' THEN 'credentials' WHEN port NOT IN ('', '80', '443') THEN 'port' END AS problem,
  host = 'localhost' OR host LIKE '127.%' AS loopback FROM q) """


@query("prj_09_endpoint_policy", _URLSQL + "SELECT page_id, problem, loopback FROM c")
def _(spark, sf):
    return view(spark, sf, "urls").select("page_id", px.endpoint_problem(F.col("url")).alias("problem"), px.loopback(F.col("url")).alias("loopback"))


@query("prj_10_cloud_guard", _URLSQL + """, k AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END AS class FROM c)
 SELECT page_id, CASE WHEN class = 'public_curriculum' OR loopback THEN NULL ELSE 'cloud_blocked:' || class END AS blocked FROM k""")
def _(spark, sf):
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END")
    return view(spark, sf, "urls").select("page_id", px.cloud_guard(kind, F.col("url")).alias("blocked"))


_TAG = "CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ':cloud') WHEN 1 THEN concat(p_name, ':7b-Cloud ') WHEN 2 THEN concat(p_name, '-cloud') WHEN 3 THEN concat(p_name, ':7b-CLOUD') ELSE concat(p_name, ':7b') END"
_META = "CASE p_size % 4 WHEN 0 THEN '{\"remote_host\": \"x.example\"}' WHEN 1 THEN '{\"a\": {\"Remote-Model\": \"m\"}}' WHEN 2 THEN '{\"remote_host\": \"\", \"b\": [1]}' ELSE '{}' END"


@query("prj_11_remote_model", "SELECT p_partkey AS id, p_partkey % 6 IN (0, 1, 2, 3) AS by_tag, p_partkey % 6 IN (0, 1, 2, 3) OR p_size % 4 IN (0, 1) AS remote FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), px.remote_model(F.expr(_TAG)).alias("by_tag"),
                                           px.remote_model(F.expr(_TAG), F.expr(_META)).alias("remote"))


# one job in eleven that is named does not exist, at every scale
_REFS_SQL = """known AS (SELECT count(*) + count(*) // 10 + 1 AS n FROM jobs), refs AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN turn % 3 = 0 THEN 'lehrplan_einlesen' ELSE 'schuelerarbeit_bewerten' END AS skill_id,
  list_transform(range(0, (conv_id + turn) % 25), lambda i: (conv_id * 7 + turn * 3 + i * 11) % n) AS job_ids FROM conversations, known),
 exploded AS (SELECT request_id, skill_id, unnest(job_ids[1:20]) AS job_id, unnest(range(0, len(job_ids[1:20]))) AS pos FROM refs)"""


def job_refs(spark, sf):
    jobs = view(spark, sf, "jobs").count()
    ids = F.expr(f"""CASE WHEN (conv_id + turn) % 25 > 0 THEN transform(sequence(0, (conv_id + turn) % 25 - 1), i -> (conv_id * 7 + turn * 3 + i * 11) % {jobs + jobs // 10 + 1}) ELSE cast(array() AS array<bigint>) END""")
    skill = F.expr("CASE WHEN turn % 3 = 0 THEN 'lehrplan_einlesen' ELSE 'schuelerarbeit_bewerten' END")
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), skill.alias("skill_id"), ids.alias("job_ids"))


@query("jn_02_job_classifications", f"WITH {view_sql('jobs')}, {_REFS_SQL} SELECT request_id, CAST(pos AS INTEGER) AS pos, e.job_id, COALESCE(classification, 'unknown') AS classification FROM exploded e LEFT JOIN jobs USING (job_id)")
def _(spark, sf):
    return privacy.resolve_jobs(job_refs(spark, sf), view(spark, sf, "jobs")).select("request_id", "pos", "job_id", "classification")


@query("jn_03_grading_gate", f"""WITH {view_sql('jobs')}, {_REFS_SQL}, why AS (SELECT request_id, pos, e.job_id, CASE WHEN status IS NULL THEN 'unknown_job' WHEN status <> 'approved' THEN 'not_approved' WHEN unresolved_critical > 0 THEN 'critical_uncertainty' END AS r
   FROM exploded e LEFT JOIN jobs USING (job_id) WHERE skill_id = 'schuelerarbeit_bewerten'),
 g AS (SELECT request_id, string_agg(r || ':' || job_id, ',' ORDER BY pos) AS reasons FROM why WHERE r IS NOT NULL GROUP BY request_id)
 SELECT request_id, skill_id, g.reasons IS NULL AS allowed, COALESCE(g.reasons, '') AS reasons FROM refs LEFT JOIN g USING (request_id)""")
def _(spark, sf):
    out = privacy.grading_gate(job_refs(spark, sf), view(spark, sf, "jobs"))
    return out.select("request_id", "skill_id", "allowed", join_list(F.col("gate_reasons")).alias("reasons"))


@query("wn_12_sticky_privacy", f"""WITH {view_sql('requests')}, f AS (SELECT conv_id, turn, len({findings_sql('text')}) > 0 AS is_local FROM requests)
 SELECT conv_id, turn, CASE WHEN bool_or(is_local) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) THEN 'local_required' ELSE 'auto' END AS sticky_mode FROM f""")
def _(spark, sf):
    turns = view(spark, sf, "requests")
    return privacy.sticky_mode(turns, F.size(px.findings(F.col("text"))) > 0).select("conv_id", "turn", "sticky_mode")


_REQ = f"WITH {view_sql('requests')} "


@query("jn_04_skill_match", _REQ + f"SELECT conv_id, turn, {skill_sql('text')} AS skill_id FROM requests")
def _(spark, sf):
    return view(spark, sf, "requests").select("conv_id", "turn", routing.match_skill(F.col("text")).alias("skill_id"))


def _index_rows(spark, sf):
    """A skill index derived from parts: names repeat, so later rows replace earlier ones."""
    name = F.expr("CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END")
    return table(spark, sf, "part").select(
        name.alias("name"), F.expr("replace(p_name, ' ', '_')").alias("folder"), F.col("p_partkey").alias("pos"),
        F.array(F.col("p_brand"), F.upper("p_type"), F.expr("concat('Teil ', p_partkey)")).alias("triggers"))


_INDEX_SQL = """WITH idx AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END AS name, p_partkey AS pos, [p_brand, upper(p_type), 'Teil ' || p_partkey] AS triggers FROM part),
 kept AS (SELECT name AS skill_id, arg_max(triggers, pos) AS triggers, min(pos) AS skill_pos FROM idx WHERE regexp_full_match(name, '[a-z_][a-z0-9_]*') GROUP BY name) """


@query("src_09_trigger_dimension", _INDEX_SQL + "SELECT skill_id, skill_pos, CAST(unnest(range(0, 3)) AS INTEGER) AS trigger_pos, lower(unnest(triggers)) AS trigger FROM kept")
def _(spark, sf):
    return routing.trigger_dimension(_index_rows(spark, sf))


@query("prj_20_public_index", _INDEX_SQL + f"SELECT skill_id, lower(array_to_string(triggers, '|')) AS triggers, skill_id IN {tuple(fv.SENSITIVE_SKILLS)} AS local_required FROM kept WHERE skill_id <> 'begleiter'")
def _(spark, sf):
    return routing.public_index(routing.trigger_dimension(_index_rows(spark, sf)))


def _any(col: str, words, fn: str = "contains") -> str:
    return "(" + " OR ".join(f"{fn}({col}, {quote(w)})" for w in words) + ")"


@query("sc_13_is_question", _REQ + f"SELECT conv_id, turn, contains(text, '?') OR {_any('lower(trim(text))', fv.QUESTION_STARTS, 'starts_with')} OR {_any('lower(text)', fv.QUESTION_MARKERS)} AS is_question FROM requests")
def _(spark, sf):
    return view(spark, sf, "requests").select("conv_id", "turn", routing.is_question(F.col("text")).alias("is_question"))


def _cases(groups) -> str:
    return "CASE " + " ".join(f"WHEN {_any('lower(text)', words)} THEN {quote(n)}" for n, words in groups) + " END"


@query("sc_14_faq_topic", _REQ + f"SELECT conv_id, turn, {_cases(fv.FAQ_KEYS)} AS topic FROM requests")
def _(spark, sf):
    return view(spark, sf, "requests").select("conv_id", "turn", routing.faq_topic(F.col("text")).alias("topic"))


@query("sc_15_mood", _REQ + f"SELECT conv_id, turn, {_cases(fv.MOOD_WORDS)} AS mood FROM requests")
def _(spark, sf):
    return view(spark, sf, "requests").select("conv_id", "turn", routing.mood(F.col("text")).alias("mood"))


@query("sc_16_exam_title_date", _REQ + f"""SELECT conv_id, turn, nullif(trim(regexp_extract(text, {quote('(?i)' + fv.EXAM_WORDS)})), '') AS title,
 CASE WHEN regexp_matches(text, {quote(fv.EXAM_DATE)}) THEN regexp_extract(text, {quote(fv.EXAM_DATE)}, 3) || '-' || lpad(regexp_extract(text, {quote(fv.EXAM_DATE)}, 2), 2, '0') || '-' || lpad(regexp_extract(text, {quote(fv.EXAM_DATE)}, 1), 2, '0') END AS due FROM requests""")
def _(spark, sf):
    return view(spark, sf, "requests").select("conv_id", "turn", routing.exam_title(F.col("text")).alias("title"), routing.exam_date(F.col("text")).alias("due"))


@query("sc_17_unresolved_marks", _REQ + r"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\[\+?[^\[\]]*\?\]|␣\?␣'), ' ') AS marks, len(regexp_extract_all(text, '\[\+?[^\[\]]*\?\]|␣\?␣')) = 0 AS gradable FROM requests")
def _(spark, sf):
    marks = routing.unresolved_marks(F.col("text"))
    return view(spark, sf, "requests").select("conv_id", "turn", F.array_join(marks, " ").alias("marks"), (F.size(marks) == 0).alias("gradable"))
