"""Chunking, search, context and whole-turn queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions.text import strip, words
from pultwerk.operators import retrieval
from pultwerk.plans import chat
from pultwerk.plans.privacy_queries import _REFS_SQL, findings_sql, job_refs, skill_sql
from pultwerk.plans.registry import query
from pultwerk.session import cut_lineage
from pultwerk.sources.tables import table, view, view_sql

_CUT = "least(start + 900, n)"


def _cut_sql() -> str:
    """End of the chunk at ``start``: just past the last occurrence of the first separator found."""
    seps = [("chr(10) || '.'", None), ("' .'", None), ("chr(10) || chr(10)", None), ("chr(10)", None)]
    win = f"reverse(substring(text, start + 151, {_CUT} - start - 150))"
    tests = " ".join(f"WHEN instr({win}, {s}) > 0 THEN {_CUT} - instr({win}, {s}) + 1" for s, _ in seps)
    return f"CASE WHEN {_CUT} >= n THEN {_CUT} {tests} ELSE {_CUT} END"


_CHUNKS = f"""WITH RECURSIVE {view_sql('docs')}, walk AS (
  SELECT doc_id, text, n, start, {_cut_sql()} AS stop FROM (SELECT doc_id, text, length(text) AS n, 0::BIGINT AS start FROM docs)
  UNION ALL
  SELECT doc_id, text, n, start, {_cut_sql()} AS stop FROM (SELECT doc_id, text, n, greatest(stop - 150, start + 1) AS start FROM walk WHERE stop < n)),
 pieces AS (SELECT doc_id, start, trim(substring(text, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(13)) AS chunk FROM walk),
 chunk_rows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_no, chunk FROM pieces WHERE length(chunk) > 60)
"""


@query("sc_09_chunks", _CHUNKS + "SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM chunk_rows")
def _(spark, sf):
    return retrieval.chunk_rows(view(spark, sf, "docs")).select("doc_id", "chunk_no", "chunk")


_INGEST = _CHUNKS + ", ingested AS (SELECT c.doc_id || ':' || chunk_no AS chunk_id, c.doc_id AS document_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk, left(source, 200) AS source, classification FROM chunk_rows c JOIN docs USING (doc_id)) "


@query("src_11_chunk_table", _INGEST + "SELECT * FROM ingested")
def _(spark, sf):
    return retrieval.ingest(view(spark, sf, "docs"))


@query("rt_01_ingest_report", _CHUNKS + ", k AS (SELECT doc_id, count(*) AS c FROM chunk_rows GROUP BY doc_id) SELECT d.doc_id, CAST(COALESCE(c, 0) AS INTEGER) AS chunks, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words, CASE WHEN trim(text) = '' THEN 'empty' WHEN c IS NULL THEN 'too_short' WHEN classification = 'student_submission' THEN 'invalid_classification' END AS rejected FROM docs d LEFT JOIN k USING (doc_id)")
def _(spark, sf):
    return retrieval.ingest_report(view(spark, sf, "docs"))


@query("ag_21_collection_stats", _INGEST + "SELECT source, classification, count(*) AS chunks, count(DISTINCT document_id) AS documents, CAST(sum(len(list_filter(string_split_regex(chunk, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM ingested GROUP BY ALL")
def _(spark, sf):
    c = retrieval.ingest(view(spark, sf, "docs")).withColumn("w", F.size(words(F.col("chunk"))))
    return c.groupBy("source", "classification").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.sum("w").alias("words"))


@query("prj_19_needs_reading", f"WITH {view_sql('docs')} SELECT doc_id, length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10))) < 100 AS needs_reading FROM docs")
def _(spark, sf):
    return view(spark, sf, "docs").select("doc_id", retrieval.needs_reading(F.split("text", "\n")).alias("needs_reading"))


_PAIRS = f"WITH {view_sql('chunks')}, pairs AS (SELECT q.chunk_id AS query_id, c.chunk_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) ** 2, 9) AS d FROM chunks q JOIN chunks c ON q.chunk_id <> c.chunk_id), ranked AS (SELECT query_id, chunk_id, round(d, 3) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INTEGER) AS rank FROM pairs WHERE {{cut}})"


def _queries(spark, sf):
    return view(spark, sf, "chunks").select(F.col("chunk_id").alias("query_id"), "embedding")


@query("rt_02_search_cutoff", _PAIRS.format(cut="d < 1.3") + " SELECT * FROM ranked WHERE rank <= 4")
def _(spark, sf):
    """Every stored passage as a query against all others, with the usual cutoff."""
    return retrieval.search(_queries(spark, sf), view(spark, sf, "chunks"), skip_equal_ids=True)


@query("wn_09_search_top_k", _PAIRS.format(cut="true") + " SELECT * FROM ranked WHERE rank <= 8")
def _(spark, sf):
    """The same without a cutoff; a k of twenty is clamped to eight."""
    return retrieval.search(_queries(spark, sf), view(spark, sf, "chunks"), k=20, cutoff=None, skip_equal_ids=True)


def stored_chunks(spark, sf):
    """The ingested chunks of all documents, each with a vector of the embeddings table."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    chunks = retrieval.ingest(view(spark, sf, "docs")).withColumn("vec_id", (F.col("document_id") * 31 + F.col("chunk_no") * 7) % n)
    # stands for a stored chunk table, which several steps of a search read
    return cut_lineage(chunks.join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id"))


_TABLE = _INGEST + ", stored AS (SELECT i.*, e.embedding FROM ingested i JOIN embeddings e ON e.vec_id = (document_id * 31 + chunk_no * 7) % (SELECT count(*) FROM embeddings))"
_HEAD = "chr(10) || chr(10) || '## Relevante Lehrplaninhalte (automatisch eingeblendet)' || chr(10)"
_DISTANCE = "round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) ** 2, 9)"
_CTX = f"""hits AS (SELECT query_id, r.chunk_id, rank, '[Quelle: ' || c.source || ']' || chr(10) || c.chunk AS block, classification FROM ranked r JOIN stored c ON c.chunk_id = r.chunk_id WHERE rank <= 4),
 ctx AS (SELECT query_id, {_HEAD} || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, list(classification ORDER BY rank) AS classes FROM hits GROUP BY query_id)"""
_RANKED = f"pairs AS (SELECT q.query_id, c.chunk_id, {_DISTANCE} AS d FROM asks q JOIN stored c ON true), ranked AS (SELECT query_id, chunk_id, d, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INTEGER) AS rank FROM pairs WHERE d < 1.3)"


@query("ud_03_stored_chunk_search", _TABLE + f", asks AS (SELECT vec_id AS query_id, embedding FROM embeddings), {_RANKED} SELECT query_id, chunk_id, round(d, 3) AS distance, rank FROM ranked WHERE rank <= 4")
def _(spark, sf):
    """Every vector against the ingested table, whose chunk ids are strings."""
    return retrieval.search(_queries(spark, sf), stored_chunks(spark, sf))


@query("rt_03_context", _TABLE + f", asks AS (SELECT vec_id AS query_id, embedding FROM embeddings), {_RANKED}, {_CTX} SELECT query_id, context, array_to_string(classes, ',') AS classifications FROM ctx")
def _(spark, sf):
    chunks = stored_chunks(spark, sf)
    return retrieval.context(retrieval.search(_queries(spark, sf), chunks), chunks).select("query_id", "context", F.array_join("classifications", ",").alias("classifications"))


@query("rt_04_chat_turns", _TABLE + f""", {view_sql('jobs', 'requests')}, {_REFS_SQL},
 req AS (SELECT r.conv_id * 1000 + r.turn AS request_id, r.text, {skill_sql('r.text')} AS skill_id, e.embedding, CASE WHEN r.turn % 5 = 4 THEN 'local_required' ELSE 'auto' END AS requested_mode, refs.job_ids[1:20] AS job_ids
   FROM requests r JOIN embeddings e ON e.vec_id = (r.conv_id * 31 + r.turn * 7) % (SELECT count(*) FROM embeddings) JOIN refs ON refs.request_id = r.conv_id * 1000 + r.turn WHERE r.role = 'user'),
 refrows AS (SELECT request_id, skill_id, unnest(job_ids) AS job_id, unnest(range(0, len(job_ids))) AS pos FROM req),
 why AS (SELECT request_id, pos, w.job_id, COALESCE(classification, 'unknown') AS class, CASE WHEN skill_id <> 'schuelerarbeit_bewerten' OR skill_id IS NULL THEN NULL WHEN status IS NULL THEN 'unknown_job' WHEN status <> 'approved' THEN 'not_approved' WHEN unresolved_critical > 0 THEN 'critical_uncertainty' END AS reason FROM refrows w LEFT JOIN jobs USING (job_id)),
 gate AS (SELECT request_id, string_agg(reason || ':' || job_id, ',' ORDER BY pos) FILTER (reason IS NOT NULL) AS gate_reasons, list(DISTINCT class) AS job_classes FROM why GROUP BY request_id),
 asks AS (SELECT request_id AS query_id, embedding FROM req), {_RANKED}, {_CTX},
 full_rows AS (SELECT r.*, g.gate_reasons, COALESCE(x.classes, []) AS found, list_concat(COALESCE(x.classes, []), COALESCE(g.job_classes, [])) AS classes, list_distinct(list_concat({findings_sql('r.text')}, {findings_sql("COALESCE(x.context, '')")})) AS f
   FROM req r LEFT JOIN gate g USING (request_id) LEFT JOIN ctx x ON x.query_id = r.request_id),
 final AS (SELECT *, list_sort(list_filter(list_concat([CASE WHEN requested_mode = 'local_required' THEN 'user_requested_local' END, CASE WHEN skill_id IN {tuple(fv.SENSITIVE_SKILLS)} THEN 'sensitive_skill:' || skill_id END,
   CASE WHEN len(list_filter(classes, lambda x: x <> 'public_curriculum')) > 0 THEN 'document_not_public' END, CASE WHEN list_contains(classes, 'student_submission') THEN 'student_submission' END], list_transform(f, lambda x: 'personal_data:' || x)), lambda x: x IS NOT NULL)) AS rs FROM full_rows)
 SELECT request_id, skill_id, gate_reasons IS NULL AS allowed, COALESCE(gate_reasons, '') AS gate_reasons, CAST(CASE WHEN gate_reasons IS NULL THEN len(found) ELSE 0 END AS INTEGER) AS hits,
  CASE WHEN gate_reasons IS NULL THEN CASE WHEN len(rs) > 0 THEN 'local_required' ELSE 'cloud_allowed' END END AS mode, CASE WHEN gate_reasons IS NULL THEN array_to_string(rs, ',') END AS reasons FROM final""")
def _(spark, sf):
    """All user turns of all chats."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    n = vectors.count()
    refs = job_refs(spark, sf).select("request_id", "job_ids")
    reqs = (view(spark, sf, "requests").filter("role = 'user'").withColumn("request_id", F.col("conv_id") * 1000 + F.col("turn"))
            .withColumn("_v", (F.col("conv_id") * 31 + F.col("turn") * 7) % n).join(vectors, "_v").join(refs, "request_id")
            .selectExpr("request_id", "text", "job_ids", "embedding", "CASE WHEN turn % 5 = 4 THEN 'local_required' ELSE 'auto' END AS requested_mode", "'auto' AS sticky_mode"))
    out = chat.chat_turns(reqs, view(spark, sf, "jobs"), stored_chunks(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("gate_reasons", "reasons")})
