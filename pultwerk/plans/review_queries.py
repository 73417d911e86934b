"""Review state, chats, versions and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk.operators import chats, review
from pultwerk.plans.registry import query
from pultwerk.sources.tables import table, view, view_sql

_EV = f"WITH {view_sql('review_events')}"
_CAND = "cand AS (SELECT c_custkey AS job_id, r AS region_id, e AS engine, e || ' liest ' || c_custkey || '/' || r AS text FROM customer, range(0, 5) t(r), (VALUES ('htr'), ('tesseract')) v(e) WHERE c_custkey % 3 <> 2 OR e = 'htr')"
_CLS = f""", {_CAND}, cls AS (SELECT ev.*, c.text AS reader_text, CASE WHEN ev.engine IS NULL AND ev.text IS NULL THEN 'empty_patch' WHEN ev.engine IS NOT NULL AND c.text IS NULL THEN 'unknown_reader' END AS problem, COALESCE(ev.text, c.text) AS new_text
 FROM review_events ev LEFT JOIN cand c ON c.job_id = ev.job_id AND c.region_id = ev.region_id AND c.engine = ev.engine WHERE kind = 'edit')"""


def _candidates(spark, sf):
    grid = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("region_id")).select(
        "job_id", "region_id", F.explode(F.array(F.lit("htr"), F.lit("tesseract"))).alias("engine"))
    return grid.filter("job_id % 3 <> 2 or engine = 'htr'").withColumn("text", F.expr("concat(engine, ' liest ', job_id, '/', region_id)"))


def _classified(spark, sf):
    return review.classify_edits(view(spark, sf, "review_events"), _candidates(spark, sf))


def _critical(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("region_id")).filter(
        "(job_id + region_id) % 4 = 0 and job_id % 5 <> 0")


@query("wn_14_latest_edits", _EV + _CLS + " SELECT job_id, region_id, arg_max(new_text, (ts, event_id)) AS selected_text, count(*) AS edits, true AS edited FROM cls WHERE problem IS NULL GROUP BY job_id, region_id")
def _(spark, sf):
    return review.latest_edits(_classified(spark, sf))


@query("wn_14_rejected_edits", _EV + _CLS + " SELECT job_id, region_id, event_id, problem FROM cls WHERE problem IS NOT NULL")
def _(spark, sf):
    return review.rejected_edits(_classified(spark, sf))


_STATES = _EV + _CLS + """, crit AS (SELECT c_custkey AS job_id, r AS region_id FROM customer, range(0, 5) t(r) WHERE (c_custkey + r) % 4 = 0 AND c_custkey % 5 <> 0),
 born AS (SELECT job_id, min((ts, event_id)) AS born, min(ts) AS created FROM review_events WHERE kind = 'create' GROUP BY job_id),
 died AS (SELECT e.job_id, min((ts, event_id)) AS died FROM review_events e JOIN born USING (job_id) WHERE kind = 'delete' AND (ts, event_id) > born GROUP BY e.job_id),
 rd AS (SELECT e.job_id, arg_min(CASE WHEN kind = 'complete' AND completed_as = 'failed' THEN 'fail' ELSE kind END, (ts, event_id)) AS kind, arg_min(completed_as, (ts, event_id)) AS came_out, arg_min(CASE WHEN kind = 'fail' AND error_code IS NOT NULL THEN error_code ELSE '' END, (ts, event_id)) AS code, min((ts, event_id)) AS rat FROM review_events e JOIN born USING (job_id) WHERE kind IN ('complete', 'fail') AND (ts, event_id) > born GROUP BY e.job_id),
 j AS (SELECT b.job_id, created, died, CASE WHEN died IS NULL OR rat < died THEN kind END AS kind, came_out = 'approved' AS auto, code, rat FROM born b LEFT JOIN died USING (job_id) LEFT JOIN rd USING (job_id)),
 ed AS (SELECT c.job_id, c.region_id, min((ts, event_id)) AS f, max((ts, event_id)) AS l FROM cls c JOIN j USING (job_id) WHERE j.kind = 'complete' AND problem IS NULL AND (ts, event_id) > rat AND (died IS NULL OR (ts, event_id) < died) GROUP BY c.job_id, c.region_id),
 eds AS (SELECT job_id, max(l) AS last_edit, count(*) AS n FROM ed GROUP BY job_id), cr AS (SELECT c.job_id, count(*) FILTER (f IS NULL) AS open, max(f) AS done FROM crit c LEFT JOIN ed USING (job_id, region_id) GROUP BY c.job_id),
 ap AS (SELECT a.job_id, min(a.ts) AS approved_at FROM review_events a JOIN j USING (job_id) LEFT JOIN eds USING (job_id) LEFT JOIN cr USING (job_id) WHERE a.kind = 'approve' AND j.kind = 'complete' AND COALESCE(open, 0) = 0 AND (a.ts, a.event_id) > rat AND (died IS NULL OR (a.ts, a.event_id) < died)
   AND (last_edit IS NULL OR (a.ts, a.event_id) > last_edit) AND (done IS NULL OR (a.ts, a.event_id) > done) GROUP BY a.job_id),
 states AS (SELECT job_id, CASE WHEN died IS NOT NULL THEN 'deleted' WHEN j.kind IS NULL THEN 'processing' WHEN j.kind = 'fail' THEN 'failed' WHEN approved_at IS NOT NULL OR auto AND n IS NULL THEN 'approved' ELSE 'needs_review' END AS status, CASE WHEN died IS NULL AND j.kind = 'fail' THEN nullif(code, '') END AS error_code, created AS created_at, CASE WHEN died IS NULL AND NOT (auto AND n IS NULL) THEN approved_at END AS approved_at,
   COALESCE(n, 0) AS edited_regions, CASE WHEN j.kind = 'complete' THEN COALESCE(open, 0) ELSE 0 END AS unresolved_critical FROM j LEFT JOIN eds USING (job_id) LEFT JOIN cr USING (job_id) LEFT JOIN ap USING (job_id))"""
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def states(spark, sf):
    accepted = _classified(spark, sf).filter("problem is null")
    return review.job_states(view(spark, sf, "review_events"), _critical(spark, sf), accepted)


def _stamp(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("rv_01_job_states", _STATES + f" SELECT job_id, status, error_code, {_TS.format(c='created_at')}, {_TS.format(c='approved_at')}, edited_regions, unresolved_critical FROM states")
def _(spark, sf):
    return _stamp(states(spark, sf), "created_at", "approved_at")


@query("tk_01_newest_jobs", _STATES + f" SELECT job_id, status, {_TS.format(c='created_at')}, unresolved_critical FROM states ORDER BY states.created_at DESC, job_id")
def _(spark, sf):
    return _stamp(review.newest_jobs(states(spark, sf)), "created_at")


@query("rv_02_expired_jobs", _STATES + " SELECT job_id, status FROM states WHERE created_at < TIMESTAMP '2024-01-20' - INTERVAL 15 DAY")
def _(spark, sf):
    return review.expired_jobs(states(spark, sf), "2024-01-20 00:00:00", 15).select("job_id", "status")


@query("jn_11_without_deleted", _EV + " SELECT event_id, job_id, kind FROM review_events WHERE job_id NOT IN (SELECT job_id FROM review_events WHERE kind = 'delete')")
def _(spark, sf):
    e = view(spark, sf, "review_events")
    return review.without_deleted(e, e.filter("kind = 'delete'").select("job_id").distinct()).select("event_id", "job_id", "kind")


@query("jn_12_orphans", "WITH inv AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS created_at, o_orderdate + INTERVAL 400 DAY AS modified_at FROM orders) SELECT o_orderkey AS id FROM inv WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 1 AND COALESCE(created_at, modified_at) < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY")
def _(spark, sf):
    name = F.md5(F.col("o_orderkey").cast("string"))
    o = table(spark, sf, "orders").withColumn("folder", F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("tmp."), F.col("o_orderkey").cast("string"))).otherwise(name))
    inventory = o.select(F.col("o_orderkey").alias("id"), "folder", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")).alias("modified_at"))
    return review.orphans(inventory, o.filter("o_orderkey % 5 = 1").select("folder"), "1999-01-01 00:00:00", 30).select("id")


@query("wn_10_prior_versions", "WITH v AS (SELECT 'memory/' || source || '/' || doc_id % 20 || '.md' AS path, doc_id AS version_ts, md5(text) AS digest FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version_ts DESC) AS rn FROM v) SELECT path, version_ts, digest, CAST(rn - 1 AS INTEGER) AS version FROM r WHERE rn BETWEEN 2 AND 4")
def _(spark, sf):
    v = table(spark, sf, "documents").select(F.expr("concat('memory/', source, '/', doc_id % 20, '.md')").alias("path"), F.col("doc_id").alias("version_ts"), F.md5("text").alias("digest"))
    return review.prior_versions(v)


@query("wn_16_revision_checks", f"""WITH RECURSIVE a AS (SELECT CAST(user_id AS BIGINT) AS state_id, ts, event_id, CAST(event_id % 6 AS BIGINT) AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 walk AS (SELECT state_id, k, event_id, expected, expected = 0 AS accepted, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS revision FROM a WHERE k = 1
  UNION ALL SELECT a.state_id, a.k, a.event_id, a.expected, a.expected = w.revision, w.revision + CASE WHEN a.expected = w.revision THEN 1 ELSE 0 END FROM walk w JOIN a ON a.state_id = w.state_id AND a.k = w.k + 1)
 SELECT state_id, event_id, expected, accepted, CAST(revision AS BIGINT) AS revision FROM walk""")
def _(spark, sf):
    return review.check_revisions(table(spark, sf, "events").selectExpr("cast(user_id AS bigint) AS state_id", "ts", "event_id", "event_id % 6 AS expected"))


_TU = f"WITH {view_sql('turns')} "


@query("ag_22_chat_overview", _TU + "SELECT conv_id, count(*) AS messages, max(turn) AS updated_at FROM turns GROUP BY conv_id")
def _(spark, sf):
    return chats.overview(view(spark, sf, "turns"))


@query("tk_02_chats_by_update", _TU + "SELECT conv_id, count(*) AS messages, max(turn) AS updated_at FROM turns GROUP BY conv_id ORDER BY updated_at DESC, conv_id")
def _(spark, sf):
    return chats.by_last_update(chats.overview(view(spark, sf, "turns")))


@query("wn_15_latest_user_turn", _TU + "SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM turns WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    return chats.latest_user_turn(view(spark, sf, "turns"))


@query("wn_15_recent_user_texts", _TU + ", r AS (SELECT conv_id, turn, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM turns WHERE role = 'user' AND trim(text) <> '') SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS texts FROM r WHERE rn <= 20 GROUP BY conv_id")
def _(spark, sf):
    return chats.recent_user_texts(view(spark, sf, "turns"))


@query("tk_08_search_box", _TU + "SELECT conv_id, turn FROM turns WHERE contains(lower(text), 'nicht') OR contains(lower(role), 'nicht')")
def _(spark, sf):
    return chats.search(view(spark, sf, "turns"), " NICHT ", "text", "role").select("conv_id", "turn")


@query("tk_07_last_log_lines", "WITH l AS (SELECT source AS log, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY doc_id DESC, pos DESC) AS rn FROM l) SELECT log, doc_id, CAST(pos AS INTEGER) AS pos, line FROM r WHERE rn <= 300")
def _(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("source").alias("log"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return chats.last_lines(lines, "log", ["doc_id", "pos"])


@query("prj_17_chat_normalisation", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Neuer Chat' ELSE left(repeat(o_orderpriority || ' ', 20), 100) END AS title, CASE WHEN o_orderstatus = 'F' THEN 'local_required' ELSE 'auto' END AS privacy_mode,
 o_orderkey % 3 <> 0 AS id_kept, CASE WHEN o_orderkey % 1000 = 7 THEN 0 WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS n_messages FROM orders""")
def _(spark, sf):
    uuid = F.regexp_replace(F.md5(F.col("o_orderkey").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    big = F.transform(F.sequence(F.lit(1), F.lit(10_001)), lambda i: F.lit("x"))
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("chat-1")).otherwise(uuid).alias("chat_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.repeat(F.concat("o_orderpriority", F.lit(" ")), 20)).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "local_required").otherwise(F.col("o_orderstatus")).alias("privacy_mode"),
        F.when(F.col("o_orderkey") % 1000 == 7, big).when(F.col("o_orderkey") % 5 != 0, F.array(F.lit("a"), F.lit("b"))).alias("messages"), uuid.alias("_u"))
    out = chats.normalise(base)
    return out.select("id", "title", "privacy_mode", (F.col("chat_id") == F.col("_u")).alias("id_kept"), F.size("messages").alias("n_messages"))
