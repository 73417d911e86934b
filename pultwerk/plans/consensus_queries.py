"""Transcription: text rules, consensus, page and document decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import arrow, reading
from pultwerk.functions.text import words
from pultwerk.operators import consensus, pages, pseudonym, segmentation, vocabulary
from pultwerk.plans import transcription
from pultwerk.plans.privacy_queries import _L
from pultwerk.plans.registry import query, quote, sql_list, values
from pultwerk.sources import readings
from pultwerk.sources.tables import table, view, view_sql

_DOCS = f"WITH {view_sql('docs')} "
_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_TOKENS = f"flatten(list_transform({_WORDS}, lambda w: CASE WHEN length(w) > 1 AND right(w, 1) IN ('.', '!', '?', ':') THEN [left(w, -1), right(w, 1)] ELSE [w] END))"


@query("sc_23_tokens", _DOCS + f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM docs")
def _(spark, sf):
    t = reading.tokens(F.col("text"))
    return view(spark, sf, "docs").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


_NORM = "trim(replace(replace(replace(replace(lower(token), 'ß', 'ss'), '’', ''''), '“', ''''), '\"', ''''), '()[]{}<>*_~')"


@query("sc_22_normal_forms", _DOCS + f", t AS (SELECT unnest({_TOKENS}) AS token FROM docs) SELECT token, {_NORM} AS normal, count(*) AS n FROM t GROUP BY token")
def _(spark, sf):
    """Normal form of every distinct token of all documents."""
    t = view(spark, sf, "docs").select(F.explode(reading.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", reading.normal_form(arrow.fold("token")).alias("normal"), "n")


_RAW = r"regexp_replace(regexp_replace(regexp_replace(text, ' (the|de|die) ', ' <uncertain>{g}|x</uncertain> '{f}), ' (of|la|und) ', ' <deleted>{g}</deleted> '{f}), '\$\$\$', '<unclear/>'{f})"


@query("sc_24_markup", _DOCS + r""", m AS (SELECT doc_id, text, len(regexp_extract_all(text, ' (the|de|die) ')) AS n_alt, regexp_replace(text, ' (the|de|die) ', ' ~\1 ', 'g') AS t1 FROM docs),
 k AS (SELECT doc_id, n_alt, len(regexp_extract_all(t1, ' (of|la|und) ')) AS n_del, replace(replace(regexp_replace(t1, ' (of|la|und) ', '  ', 'g'), '~', ''), '$$$', '␣?␣') AS plain, (length(text) - length(replace(text, '$$$', ''))) // 3 AS n_unclear, contains(text, '~') AS odd FROM m)
 SELECT doc_id, md5(plain) AS digest, CAST(n_alt AS INTEGER) AS n_alternatives, CAST(n_del AS INTEGER) AS n_deleted, CAST(n_unclear AS INTEGER) AS n_unclear FROM k""")
def _(spark, sf):
    raw = view(spark, sf, "docs").select("doc_id", F.expr(_RAW.format(g="$1", f="").replace("\\", "\\\\")).alias("raw_text"), F.lit("").alias("text"))
    out = consensus.read_markup(raw)
    return out.select("doc_id", F.md5("text").alias("digest"), F.size("alternatives").alias("n_alternatives"), F.size("deleted").alias("n_deleted"), F.col("unclear").alias("n_unclear"))


_PLAIN = "CASE WHEN contains(r, ',') THEN replace(regexp_extract(ltrim(r, '+-'), '^(.*),([^,]*)$', 1), '.', '') || '.' || regexp_extract(r, '^(.*),([^,]*)$', 2) WHEN length(r) - length(replace(r, '.', '')) = 1 THEN ltrim(r, '+-') ELSE replace(ltrim(r, '+-'), '.', '') END"


@query("sc_25_numbers", _DOCS + f", runs AS (SELECT doc_id, unnest(regexp_extract_all(text, {quote(fv.NUMBER_RUN)})) AS r FROM docs) SELECT doc_id, r AS run, CAST(CASE WHEN starts_with(r, '-') THEN -1 ELSE 1 END * COALESCE(TRY_CAST({_PLAIN} AS DECIMAL(38,10)), 0) AS DOUBLE) AS number, count(*) AS n FROM runs GROUP BY ALL")
def _(spark, sf):
    runs = view(spark, sf, "docs").select("doc_id", F.explode(reading.number_runs(F.col("text"))).alias("run"))
    number = F.col("c").try_cast("decimal(38,10)").cast("double")
    return runs.withColumn("c", reading.canonical_number(F.col("run"))).select("doc_id", "run", (number + 0.0).alias("number")).groupBy("doc_id", "run", "number").agg(F.count("*").alias("n"))


_UNIT_TEXT = "concat(CAST(p_size AS VARCHAR(10)), CASE p_partkey % 5 WHEN 0 THEN 'mV, (3 km/h) xy ' WHEN 1 THEN ' MV; 3,5kg und m.' WHEN 2 THEN ' Ω 7 µm / 20 °C' WHEN 3 THEN 'ohm ml-3 l' ELSE ' Äpfel' END, ' ', p_name)"


@query("sc_26_units", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'mv|km/h' WHEN 1 THEN 'mv|kg|m' WHEN 2 THEN 'ω|μm|°c' WHEN 3 THEN 'ohm|l' ELSE '' END AS units FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(reading.units(F.expr(_UNIT_TEXT)), "|").alias("units"))


_UNITS2 = [*fv.UNITS, "MV", "Kg", "KM", "PA"]
_PRE = "CASE WHEN length({c}) >= 2 AND contains('mkµcndhMGpTP', {c}[1]) THEN {c}[1] ELSE '' END"


@query("sc_27_prefix_confusion", f"WITH u AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, {sql_list(_UNITS2)}[1 + l_partkey % {len(_UNITS2)}] AS a, {sql_list(_UNITS2)}[1 + l_orderkey % {len(_UNITS2)}] AS b FROM lineitem), p AS (SELECT *, {_PRE.format(c='a')} AS pa, {_PRE.format(c='b')} AS pb FROM u) SELECT a, b, lower(CASE WHEN pa = '' THEN a ELSE a[2:] END) = lower(CASE WHEN pb = '' THEN b ELSE b[2:] END) AND a <> b AND pa <> pb AS confused, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf):
    pick = lambda c: F.element_at(F.array(*[F.lit(u) for u in _UNITS2]), (F.col(c) % len(_UNITS2)).cast("int") + 1)
    u = table(spark, sf, "lineitem").select(pick("l_partkey").alias("a"), pick("l_orderkey").alias("b"))
    return u.select("a", "b", reading.prefix_confusion(F.col("a"), F.col("b")).alias("confused")).groupBy("a", "b", "confused").agg(F.count("*").alias("n"))


_CANON = "replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'ö', 'oe'), 'ü', 'ue'), 'ä', 'ae')"
_KNOWN = sql_list(reading.Vocabulary().canonical_words)
_BLOCKED = sql_list(sorted({reading.canonical_word(w) for w in fv.FUNCTION_WORDS}))


@query("sc_28_critical_words", f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), i AS (SELECT conv_id, turn, w, unnest(range(0, (len(w) + 1) // 2)) AS i FROM w),
 s AS (SELECT conv_id, turn, i, {_CANON.format(c="array_to_string(w[2 * i + 1 : 2 * i + 2], ' ')")} AS t, {_CANON.format(c="COALESCE(CASE WHEN i > 0 THEN w[2 * i] END, '')")} AS l, {_CANON.format(c="COALESCE(w[2 * i + 3], '')")} AS r FROM i),
 k AS (SELECT *, regexp_extract_all(t, '\\pL+') AS plain, regexp_extract_all(regexp_replace(t, '[\\s-]+', '', 'g'), '\\pL+') AS glued, CASE WHEN l <> '' THEN regexp_extract_all(regexp_replace(l || t, '[\\s-]+', '', 'g'), '\\pL+') ELSE [] END AS gl, CASE WHEN r <> '' THEN regexp_extract_all(regexp_replace(t || r, '[\\s-]+', '', 'g'), '\\pL+') ELSE [] END AS gr FROM s),
 b AS (SELECT *, len(list_filter(plain, lambda x: list_contains({_BLOCKED}, x))) = 0 AS free FROM k),
 x AS (SELECT *, CASE WHEN free AND len(plain) > 0 THEN list_filter(list_concat(CASE WHEN gl <> plain THEN gl ELSE [] END, CASE WHEN gr <> plain THEN gr ELSE [] END), lambda x: list_contains({_KNOWN}, x)) ELSE [] END AS beside FROM b),
 h AS (SELECT conv_id, turn, i, list_concat(list_filter(plain, lambda x: list_contains({_KNOWN}, x)), CASE WHEN free AND glued <> plain THEN list_filter(glued, lambda x: list_contains({_KNOWN}, x)) ELSE [] END,
   list_filter(beside, lambda v, j: list_position(beside, v) = j)) AS hits FROM x)
 SELECT conv_id, turn, CAST(i AS INTEGER) AS span, array_to_string(hits, '|') AS critical FROM h WHERE len(hits) > 0""")
def _(spark, sf):
    """Every text of every chat as spans of two words with one neighbour on each side."""
    w = view(spark, sf, "turns").select("conv_id", "turn", words(F.col("text")).alias("w"))
    spans = w.select("conv_id", "turn", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 2).cast("int")))).alias("i"))
    texts = F.array(F.array_join(F.slice("w", F.col("i") * 2 + 1, 2), " "), F.coalesce(F.get("w", F.col("i") * 2 - 1), F.lit("")), F.coalesce(F.get("w", F.col("i") * 2 + 2), F.lit("")))
    folded = spans.select("conv_id", "turn", "i", F.transform(F.split(arrow.fold(reading.joined(texts)), arrow.SEPARATOR), reading.canonical_text).alias("c"))
    hits = reading.critical_sequence(F.col("c")[0], F.col("c")[1], F.col("c")[2])
    return folded.select("conv_id", "turn", F.col("i").alias("span"), F.array_join(hits, "|").alias("critical")).filter("critical <> ''")


_SYMS = sql_list(sorted(set(fv.CRITICAL_SYMBOLS)))


@query("so_04_symbol_difference", _DOCS + f", o AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN replace(text, '-', '+') ELSE regexp_replace(text, '=', '≠') END AS other FROM docs) SELECT doc_id, list_filter({_SYMS}, lambda s: length(text) - length(replace(text, s, '')) <> length(other) - length(replace(other, s, '')))[1] AS symbol FROM o")
def _(spark, sf):
    other = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("-"), F.lit("+"))).otherwise(F.regexp_replace("text", "(?s)^([^=]*)=", "$1≠"))
    d = view(spark, sf, "docs").withColumn("other", other)
    return d.select("doc_id", reading.symbol_difference(F.col("text"), F.col("other"), reading.symbols_in(F.array("text", "other"))).alias("symbol"))


@query("so_06_same_variant", f"WITH w AS (SELECT unnest({_WORDS}) AS w, conv_id + turn AS k FROM conversations) SELECT k % 3 AS kind, count(*) AS n, count(*) FILTER (k % 3 <> 2 OR replace(lower(w), 'ß', 'ss') = replace(lower(w || 'e'), 'ß', 'ss')) AS same FROM w GROUP BY ALL")
def _(spark, sf):
    """Readings that differ only in case and edge signs are one variant; a letter more is not."""
    w = view(spark, sf, "turns").select((F.col("conv_id") + F.col("turn")).alias("k"), F.explode(words(F.col("text"))).alias("w"))
    other = F.when(F.col("k") % 3 == 0, F.upper("w")).when(F.col("k") % 3 == 1, F.concat(F.lit("("), "w", F.lit(")"))).otherwise(F.concat("w", F.lit("e")))
    norm = w.select("k", F.split(reading.normal_form(arrow.fold(reading.joined(F.array("w", other)))), arrow.SEPARATOR).alias("n"))
    return norm.groupBy((F.col("k") % 3).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.size(F.array_distinct("n")) <= 1).alias("same"))


_OVER = "over AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'words' WHEN 1 THEN 'units' WHEN 2 THEN 'symbols' ELSE 'subjects' END AS kind, CASE WHEN p_partkey % 4 = 3 THEN CASE p_size % 2 WHEN 0 THEN 'physik' ELSE 'chemie' END END AS subject, split_part(p_name, ' ', CAST(1 + p_partkey % 2 AS INT)) AS value FROM part)"


@query("so_01_vocabulary", f"WITH {values('base', 'kind, value', [('words', w) for w in fv.CRITICAL_WORDS] + [('units', u) for u in fv.UNITS] + [('symbols', s) for s in fv.CRITICAL_SYMBOLS])}, {_OVER} SELECT kind, value FROM base UNION SELECT kind, value FROM over WHERE kind <> 'subjects' UNION SELECT 'extra_words', value FROM over WHERE kind = 'subjects' AND subject = 'physik'")
def _(spark, sf):
    over = table(spark, sf, "part").selectExpr(
        "CASE p_partkey % 4 WHEN 0 THEN 'words' WHEN 1 THEN 'units' WHEN 2 THEN 'symbols' ELSE 'subjects' END AS kind",
        "CASE WHEN p_partkey % 4 = 3 THEN CASE p_size % 2 WHEN 0 THEN 'physik' ELSE 'chemie' END END AS subject",
        "split_part(p_name, ' ', cast(1 + p_partkey % 2 AS int)) AS value")
    return vocabulary.merged(spark, over, "physik")


_FIELDS = f"regexp_extract_all(text, {quote('(?im)^[ ]*(?:' + fv.NAME_FIELD_WORDS + ')[ ]*[:–-][ ]*(.{2,60})$')}, 1)"
_PHRASES = f"regexp_extract_all(text, {quote(_L + '(?:' + fv.NAME_LEAD_WORDS + ')' + chr(92) + 's+(' + fv.CAPITALISED_NAME + ')')}, 1)"
_CAND = f"list_filter(list_transform(list_concat({_FIELDS}, [list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]], {_PHRASES}), lambda x: trim(x)), lambda x: x <> '')"


_CAND_SQL = _DOCS + f", c AS (SELECT doc_id, {_CAND} AS c FROM docs) SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS candidates FROM c"


@query("sc_06_name_candidates", _CAND_SQL)
@query("so_02_name_candidates", _CAND_SQL)
def _(spark, sf):
    """Candidates of three detectors (sc_06) as their ordered union (so_02)."""
    return view(spark, sf, "docs").select("doc_id", F.array_join(pseudonym.name_candidates(F.col("text")), "|").alias("candidates"))


# --- readers and regions over whole documents ------------------------------------------

_REG = f"""WITH w AS (SELECT doc_id AS job_id, {_WORDS} AS w FROM documents), r AS (SELECT job_id, w, unnest(range(0, greatest((len(w) + 39) // 40, 1))) AS i FROM w),
 regions AS (SELECT job_id, CAST(i // 10 AS INTEGER) AS page, CAST(i AS INTEGER) AS region_id, w[i * 40 + 1 : i * 40 + 40] AS w FROM r),
 bulk AS (SELECT job_id, page, region_id, 'htr' AS engine, 0.5::DOUBLE + (job_id % 50) / 100.0::DOUBLE AS confidence, w FROM regions WHERE (job_id + region_id) % 29 <> 0
  UNION ALL SELECT job_id, page, region_id, 'tesseract', 0.5::DOUBLE + (job_id % 37) / 80.0::DOUBLE, list_filter(list_transform(w, lambda x: regexp_replace(x, '[37]', '8', 'g')), lambda x, j: j % 17 <> 0) FROM regions WHERE (job_id + region_id) % 29 <> 0 AND (job_id + page) % 7 <> 0) """


@query("wn_02_reference_reader", _REG + "SELECT job_id, page, region_id, arg_min(engine, CASE engine WHEN 'htr' THEN 0 ELSE 3 END) AS reference_engine, count(*) AS readers FROM bulk GROUP BY job_id, page, region_id")
def _(spark, sf):
    return consensus.pick_reference(readings.bulk(spark, sf))


@query("ud_01_candidate_table", _REG + "SELECT job_id, page, region_id, engine, confidence, md5(array_to_string(w, ' ')) AS digest FROM bulk")
def _(spark, sf):
    """Any table with the candidate columns can be a reader's output."""
    return readings.bulk(spark, sf).select("job_id", "page", "region_id", "engine", "confidence", F.md5("text").alias("digest"))


# the readers of ``readings.distinct``: disagreements by place
_DISTINCT = r"""WITH words AS (SELECT doc_id AS job_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
 reg AS (SELECT job_id, unnest(range(0, greatest((len(ws) - 1) // 40, 0) + 1)) AS region_id, ws FROM words),
 cut AS (SELECT job_id, CAST(region_id // 10 AS INTEGER) AS page, CAST(region_id AS INTEGER) AS region_id, ws[region_id * 40 + 1:region_id * 40 + 40] AS t,
   (job_id + region_id // 10) % 7 <> 0 AS two, (job_id + region_id) % 3 = 0 AS three FROM reg WHERE (job_id + region_id) % 29 <> 0),
 tok AS (SELECT job_id, page, region_id, two, three, len(t) AS n, j, CASE j WHEN 9 THEN '3,5' WHEN 12 THEN 'nicht'
   ELSE 'q' || lower(regexp_replace(t[j + 1], '[^A-Za-z]', '', 'g')) || 'x' || chr(CAST(97 + j // 6 AS INTEGER)) || chr(CAST(97 + j % 6 AS INTEGER)) END AS tok
   FROM (SELECT *, unnest(range(0, len(t))) AS j FROM cut)),
 spot AS (SELECT job_id, page, region_id, j AS s, j + 1 AS e, CASE WHEN j = 9 THEN ['3,5', '35'] WHEN j = 22 THEN list_concat([tok], CASE WHEN two THEN ['z' || tok] ELSE [] END, CASE WHEN three THEN ['y' || tok] ELSE [] END) ELSE [tok, ''] END AS variants,
   CASE j WHEN 9 THEN 'number' WHEN 12 THEN 'critical_word:nicht' ELSE '' END AS reason FROM tok WHERE two AND j IN (5, 9, 12, 18, 22, 31) OR three AND j = 22
   UNION ALL SELECT job_id, page, region_id, 28, 28, ['', 'einschub'], '' FROM cut WHERE two AND len(t) >= 28)"""


@query("cn_01_ranges", _DISTINCT + " SELECT job_id, page, region_id, CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token FROM spot")
def _(spark, sf):
    """Disputed ranges after alignment and merging, over readings with one alignment."""
    a = consensus.align_regions(readings.distinct(spark, sf))
    return a.select(*consensus.KEYS, F.inline("ranges")).withColumnsRenamed({"s": "start_token", "e": "end_token"})


def _flat(d):
    return d.select(*consensus.KEYS, F.col("start").alias("start_token"), F.col("end").alias("end_token"), "critical", "reason", F.array_join(F.transform("variants", lambda v: v["text"]), "|").alias("variants"))


@query("cn_02_distinct_readings", _DISTINCT + " SELECT job_id, page, region_id, CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token, reason <> '' AS critical, reason, array_to_string(variants, '|') AS variants FROM spot")
def _(spark, sf):
    return _flat(consensus.disagreements(consensus.align_regions(readings.distinct(spark, sf))))


_MARKED = _DISTINCT + """, marked AS (SELECT * FROM spot UNION ALL SELECT job_id, page, region_id, j, j + 1, [tok, CASE j WHEN 15 THEN 'w' ELSE 'v' END || tok], '' FROM tok WHERE j = 15 OR two AND j = 34) """


@query("cn_02_marked_readings", _MARKED + "SELECT job_id, page, region_id, CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token, reason <> '' AS critical, reason, array_to_string(variants, '|') AS variants FROM marked")
def _(spark, sf):
    """Readings with markup: what a reader itself is unsure of is a disagreement too."""
    return _flat(consensus.disagreements(consensus.align_regions(consensus.read_markup(readings.marked(spark, sf)))))


@query("cn_03_marked_text", _MARKED + """, piece AS (SELECT t.job_id, t.region_id, j * 2 + 1 AS o, CASE WHEN variants IS NULL THEN t.tok WHEN j = 9 THEN '[3,5|35?]' WHEN j IN (15, 22, 34) THEN '[' || array_to_string(variants, '|') || '?]' ELSE '[' || t.tok || '?]' END AS text
   FROM tok t LEFT JOIN marked m ON m.job_id = t.job_id AND m.region_id = t.region_id AND s = j AND e = j + 1
   UNION ALL SELECT job_id, region_id, 56, '[+einschub?]' FROM marked WHERE s = 28 AND e = 28),
 body AS (SELECT job_id, region_id, string_agg(text, ' ' ORDER BY o) AS consensus_text FROM piece GROUP BY job_id, region_id),
 number AS (SELECT job_id, region_id, count(*) AS k FROM marked GROUP BY job_id, region_id)
 SELECT job_id, page, region_id, coalesce(consensus_text, '') AS consensus_text, CAST(coalesce(k, 0) AS INTEGER) AS n_disagreements FROM cut LEFT JOIN body USING (job_id, region_id) LEFT JOIN number USING (job_id, region_id)""")
def _(spark, sf):
    return consensus.build_regions(consensus.read_markup(readings.marked(spark, sf))).select(*consensus.KEYS, "consensus_text", "n_disagreements")


_PUT_IN = "CASE WHEN s = 28 THEN 'critical_word:einschub' ELSE reason END"


@query("ud_02_vocabulary_overrides", _DISTINCT + f" SELECT job_id, page, region_id, CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token, {_PUT_IN} <> '' AS critical, {_PUT_IN} AS reason, array_to_string(variants, '|') AS variants FROM spot")
def _(spark, sf):
    """A school's own critical word, and one of another subject that must not count."""
    own = spark.createDataFrame([("words", None, "einschub"), ("subjects", "physik", "qq")], "kind string, subject string, value string")
    words = vocabulary.to_vocabulary(vocabulary.merged(spark, own, "chemie"), None)
    return _flat(consensus.disagreements(consensus.align_regions(readings.distinct(spark, sf)), words))


@query("sc_29_span_reasons", _DISTINCT + ", near AS (SELECT s.*, coalesce(l.tok, '') AS l, coalesce(r.tok, '') AS r FROM spot s LEFT JOIN tok l ON l.job_id = s.job_id AND l.region_id = s.region_id AND l.j = s - 1 LEFT JOIN tok r ON r.job_id = s.job_id AND r.region_id = s.region_id AND r.j = e) SELECT job_id, region_id, CAST(s AS INTEGER) AS start_token, reason, l AS left_token, r AS right_token FROM near")
def _(spark, sf):
    """Reasons of a table of spans with their neighbours."""
    found = consensus.disagreements(consensus.align_regions(readings.distinct(spark, sf)))
    tokens = readings.distinct(spark, sf).filter("engine = 'htr'").select("job_id", "region_id", F.split("text", " ").alias("t"))
    at = F.col("start")
    spans = found.join(tokens, ["job_id", "region_id"]).select(
        "job_id", "region_id", "start", F.transform("variants", lambda v: v["text"]).alias("texts"),
        F.coalesce(F.get("t", at - 1), F.lit("")).alias("left"), F.coalesce(F.get("t", F.col("end")), F.lit("")).alias("right"))
    judged = consensus.classify_spans(spans)
    return judged.select("job_id", "region_id", F.col("start").alias("start_token"), F.coalesce("reason", F.lit("")).alias("reason"), F.col("left").alias("left_token"), F.col("right").alias("right_token"))


@query("cn_03_distinct_readings", _DISTINCT + """, piece AS (SELECT t.job_id, t.page, t.region_id, j * 2 + 1 AS o, coalesce(CASE WHEN variants IS NULL THEN NULL WHEN j = 9 THEN '[3,5|35?]' WHEN j = 22 THEN '[' || array_to_string(variants, '|') || '?]' ELSE '[' || t.tok || '?]' END, t.tok) AS text, variants IS NOT NULL AS mark
   FROM tok t LEFT JOIN spot ON spot.job_id = t.job_id AND spot.region_id = t.region_id AND s = j AND e = j + 1
   UNION ALL SELECT job_id, page, region_id, 56, '[+einschub?]', true FROM spot WHERE s = 28 AND e = 28),
 placed AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY job_id, region_id ORDER BY o) AS BIGINT) - 1 AS stop FROM piece),
 body AS (SELECT job_id, region_id, string_agg(text, ' ' ORDER BY o) AS consensus_text, string_agg((stop - length(text)) || '-' || stop, ',' ORDER BY o) FILTER (mark) AS offsets FROM placed GROUP BY job_id, region_id),
 width AS (SELECT job_id, region_id, sum(greatest(e - s, 1)) AS w, count(*) AS k, bool_or(reason <> '') AS critical FROM spot GROUP BY job_id, region_id)
 SELECT c.job_id, c.page, c.region_id, coalesce(consensus_text, '') AS consensus_text, CASE WHEN two OR three THEN round(1 - coalesce(w, 0) / CAST(greatest(len(t), 1) AS DOUBLE), 6) ELSE 0 END AS agreement, CAST(coalesce(k, 0) AS INTEGER) AS n_disagreements, coalesce(critical, false) AS critical, coalesce(offsets, '') AS offsets
 FROM cut c LEFT JOIN body USING (job_id, region_id) LEFT JOIN width USING (job_id, region_id)""")
def _(spark, sf):
    return _consensus_columns(consensus.build_regions(readings.distinct(spark, sf))).drop("reference_engine")


def _consensus_columns(r):
    return r.select(*consensus.KEYS, "reference_engine", "consensus_text", F.round("agreement", 6).alias("agreement"), "n_disagreements", "critical",
                    F.array_join(F.transform("disagreements", lambda d: F.concat_ws("-", d["char_start"].cast("string"), d["char_end"].cast("string"))), ",").alias("offsets"))


@query("cn_01_alignment")
def _(spark, sf):
    """Edit operations of every second reading against its reference."""
    a = consensus.align_regions(readings.bulk(spark, sf))
    return a.select(*consensus.KEYS, F.explode("ops").alias("ops")).select(
        *consensus.KEYS, F.size(F.filter("ops", lambda o: o["equal"])).alias("equal"), F.size(F.filter("ops", lambda o: ~o["equal"])).alias("changed"))


@query("cn_02_disagreements")
def _(spark, sf):
    d = consensus.disagreements(consensus.align_regions(readings.bulk(spark, sf)))
    return d.select(*consensus.KEYS, "start", "end", "critical", "reason", F.array_join(F.transform("variants", lambda v: v["text"]), "|").alias("variants"))


@query("cn_03_consensus_text")
def _(spark, sf):
    return _consensus_columns(consensus.build_regions(readings.bulk(spark, sf)))


@query("cn_09_second_reading")
def _(spark, sf):
    """Whole run: consensus, selection within budget, second reading, page decisions."""
    return decided_pages(spark, sf)


# the whole run over the readings of ``distinct``: the third reader is the second reading
_RUN = _DISTINCT + """, every AS (SELECT job_id, CAST(region_id // 10 AS INTEGER) AS page, CAST(region_id AS INTEGER) AS region_id FROM reg),
 paged AS (SELECT job_id, page, CASE job_id % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END AS classification, job_id % 2 = 0 AS auto_approve, (job_id + page) % 13 = 0 AS blocked, (job_id + page) % 7 = 0 AS broken FROM every WHERE region_id % 10 = 0),
 first_spot AS (SELECT s.* FROM spot s JOIN cut c USING (job_id, region_id) WHERE c.two),
 sums AS (SELECT job_id, region_id, count(*) AS k, sum(greatest(e - s, 1)) AS w, bool_or(reason <> '') AS critical FROM first_spot GROUP BY ALL), sums2 AS (SELECT job_id, region_id, count(*) AS k, sum(greatest(e - s, 1)) AS w, bool_or(reason <> '') AS critical FROM spot GROUP BY ALL),
 built AS (SELECT e.job_id, e.page, e.region_id, c.job_id IS NOT NULL AS is_read, coalesce(c.three, false) AS three, CASE WHEN c.job_id IS NULL THEN 0 WHEN c.two THEN 2 ELSE 1 END AS n_readers, coalesce(a.k, 0) AS k, coalesce(a.critical, false) AS critical,
   CASE WHEN c.two THEN greatest(0, least(1, 1 - coalesce(a.w, 0) / CAST(greatest(len(c.t), 1) AS DOUBLE))) ELSE 0 END AS agreement, coalesce(b.critical, false) AS critical2, CASE WHEN c.job_id IS NOT NULL THEN greatest(0, least(1, 1 - coalesce(b.w, 0) / CAST(greatest(len(c.t), 1) AS DOUBLE))) ELSE 0 END AS agreement2
   FROM every e JOIN paged p ON p.job_id = e.job_id AND p.page = e.page AND NOT p.blocked LEFT JOIN cut c ON c.job_id = e.job_id AND c.region_id = e.region_id LEFT JOIN sums a ON a.job_id = e.job_id AND a.region_id = e.region_id LEFT JOIN sums2 b ON b.job_id = e.job_id AND b.region_id = e.region_id),
 flagged AS (SELECT *, n_readers < 2 OR k > 0 OR agreement < 0.98 OR (job_id + page) % 7 = 0 AS suspicious FROM built),
 ranked AS (SELECT *, CASE WHEN suspicious THEN row_number() OVER (PARTITION BY job_id, page, suspicious ORDER BY critical DESC, agreement, region_id) END AS place FROM flagged),
 final AS (SELECT *, coalesce(place <= 6, false) AND three AS redone FROM ranked),
 facts AS (SELECT job_id, page, bool_or(is_read) AS any_reading, bool_or(CASE WHEN redone THEN critical2 ELSE critical END) AS critical, min(CASE WHEN redone THEN agreement2 ELSE agreement END) AS agreement, max(CASE WHEN is_read THEN 1 ELSE 0 END) + max(CASE WHEN n_readers = 2 THEN 1 ELSE 0 END) + max(CASE WHEN redone THEN 1 ELSE 0 END) AS engines, count(*) FILTER (suspicious) > 6 AS exhausted FROM final GROUP BY ALL),
 why AS (SELECT p.*, coalesce(any_reading, false) AS any_reading, CASE WHEN blocked THEN ['image_quality'] ELSE list_filter([CASE WHEN broken THEN 'engine_unavailable:tesseract' END, CASE WHEN NOT any_reading THEN 'no_candidates' END, CASE WHEN any_reading AND critical THEN 'critical_uncertainty' END,
   CASE WHEN any_reading AND agreement < 0.98 THEN 'low_agreement' END, CASE WHEN any_reading AND engines < 2 THEN 'single_engine' END, CASE WHEN exhausted THEN 'verify_budget_exhausted' END], lambda r: r IS NOT NULL) END AS reasons FROM paged p LEFT JOIN facts f USING (job_id, page)) """


@query("cn_09_distinct_run", _RUN + """SELECT job_id, page, classification, CASE WHEN blocked THEN 'needs_review' WHEN NOT any_reading THEN 'failed' WHEN len(reasons) = 0 AND auto_approve AND classification <> 'student_submission' THEN 'approved' ELSE 'needs_review' END AS status, len(reasons) = 0 AS auto_clean, array_to_string(reasons, ',') AS reasons FROM why""")
def _(spark, sf):
    """The whole run where every alignment is known: consensus, budget, second reading, decision."""
    blocked = readings.pages(spark, sf).filter("quality_blocking").select("job_id", "page")
    seen = lambda df: df.join(blocked, ["job_id", "page"], "left_anti")
    every = readings.distinct(spark, sf)
    out = transcription.review_pages(
        readings.pages(spark, sf), seen(readings.regions(spark, sf)), seen(every.filter("pos < 2")), seen(every.filter("pos = 2")),
        readings.failures(spark, sf), required=["tesseract"], budget=6)
    return out.withColumn("reasons", F.array_join("reasons", ","))


def decided_pages(spark, sf):
    blocked = readings.pages(spark, sf).filter("quality_blocking").select("job_id", "page")
    seen = lambda df: df.join(blocked, ["job_id", "page"], "left_anti")
    out = transcription.review_pages(
        readings.pages(spark, sf), seen(readings.regions(spark, sf)), seen(readings.bulk(spark, sf)), seen(readings.second(spark, sf)),
        readings.failures(spark, sf), required=["tesseract"], budget=6)
    return out.withColumn("reasons", F.array_join("reasons", ","))


_FOUND = "f AS (SELECT l_orderkey AS id, CAST(l_partkey % 50 AS INTEGER) AS s, CAST(l_partkey % 50 + l_linenumber % 3 AS INTEGER) AS e FROM lineitem)"


@query("cn_04_agreement", f"WITH {_FOUND} SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE round(greatest(0, least(1, 1 - sum(greatest(1, e - s)) / 40.0::DOUBLE)), 6) END AS agreement FROM f GROUP BY id")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).cast("int").alias("s"), (F.col("l_partkey") % 50 + F.col("l_linenumber") % 3).cast("int").alias("e"))
    found = rows.groupBy("id").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("found"))
    return found.select("id", F.round(consensus.agreement(F.col("found"), F.lit(40), F.when(F.col("id") % 5 == 0, 1).otherwise(2)), 6).alias("agreement"))


@query("cn_04_region_agreement", _DISTINCT + """, width AS (SELECT job_id, region_id, sum(greatest(e - s, 1)) AS w FROM spot GROUP BY job_id, region_id)
 SELECT c.job_id, c.page, c.region_id, CASE WHEN two OR three THEN round(1 - coalesce(w, 0) / CAST(greatest(len(t), 1) AS DOUBLE), 6) ELSE 0 END AS agreement FROM cut c LEFT JOIN width USING (job_id, region_id)""")
def _(spark, sf):
    """Agreement of the regions that the consensus makes of the readings."""
    return consensus.build_regions(readings.distinct(spark, sf)).select(*consensus.KEYS, F.round("agreement", 6).alias("agreement"))


# --- segmentation ------------------------------------------------------------------------

@query("wn_04_merged_ranges", f"""WITH {_FOUND}, m AS (SELECT id, s, e, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT * FROM f)),
 n AS (SELECT id, s, e, sum(CASE WHEN s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT id, min(s) AS start, max(e) AS "end" FROM n GROUP BY id, g""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_partkey") % 50 + F.col("l_linenumber") % 3).cast("int").alias("end"))
    return segmentation.merge_range_rows(rows, ["id"])


_BOX = f"WITH RECURSIVE {view_sql('word_boxes')}"


@query("wn_05_paragraphs", _BOX + """, m AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS gap FROM word_boxes),
 g AS (SELECT *, sum(CASE WHEN gap > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y0, x0, box_id ROWS UNBOUNDED PRECEDING) AS n FROM m)
 SELECT page_id, 'p' || page_id || '-r' || CAST(n AS BIGINT) AS region_id, CASE WHEN count(*) <= 1 THEN 'text_line' ELSE 'paragraph' END AS region_type, CAST(min(x0) AS BIGINT) AS x0, CAST(min(y0) AS BIGINT) AS y0, CAST(max(x1) AS BIGINT) AS x1, CAST(max(y1) AS BIGINT) AS y1, count(*) AS lines FROM g GROUP BY page_id, n""")
def _(spark, sf):
    """Every box taken as a line of its page."""
    rows = view(spark, sf, "word_boxes").select("page_id", F.col("box_id").alias("line"), *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return segmentation.paragraphs(rows).drop("n")


_LINES = _BOX + """, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, box_id) AS k FROM word_boxes),
 walk AS (SELECT page_id, k, box_id, 0 AS line, y0 AS top, y1 AS bottom FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, o.box_id, CASE WHEN hit THEN line ELSE line + 1 END, CASE WHEN hit THEN least(top, o.y0) ELSE o.y0 END, CASE WHEN hit THEN greatest(bottom, o.y1) ELSE o.y1 END
   FROM (SELECT w.page_id, w.line, w.top, w.bottom, w.k + 1 AS nk, n.k, n.box_id, n.y0, n.y1, least(bottom - top, n.y1 - n.y0) > 0 AND least(bottom, n.y1) - greatest(top, n.y0) >= 0.4 * least(bottom - top, n.y1 - n.y0) AS hit FROM walk w JOIN o n ON n.page_id = w.page_id AND n.k = w.k + 1) o)
 """


@query("wn_06_word_lines", _LINES + "SELECT page_id, box_id, CAST(line AS INTEGER) AS line FROM walk")
def _(spark, sf):
    return segmentation.word_lines(view(spark, sf, "word_boxes")).select("page_id", "box_id", "line")


@query("wn_06_line_boxes", _LINES + "SELECT page_id, CAST(line AS INTEGER) AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS words FROM walk JOIN word_boxes USING (page_id, box_id) GROUP BY page_id, line")
def _(spark, sf):
    """Lines as boxes, from which paragraphs are made."""
    return segmentation.line_boxes(segmentation.word_lines(view(spark, sf, "word_boxes")))


# --- regions, pages and documents as rows ---------------------------------------------------

_RR = f"WITH {view_sql('region_rows', 'page_rows')}"


def _regions(spark, sf):
    return view(spark, sf, "region_rows")


def _with_engines(df):
    names = F.array(*[F.lit(n) for n in ("htr", "tesseract", "ollama_vlm")])
    return df.withColumn("engines", F.slice(names, F.lit(1), F.col("n_readers")))


_FAIL = "fails AS (SELECT job_id, page, region_id, CASE WHEN region_id % 2 = 0 THEN 'tesseract' ELSE 'htr' END AS engine, CASE WHEN region_id % 3 = 0 THEN 'timeout' ELSE 'recognize_failed' END AS reason, region_id AS pos FROM region_rows WHERE n_readers = 1)"


def _fails(spark, sf):
    return _regions(spark, sf).filter("n_readers = 1").selectExpr(
        "job_id", "page", "region_id", "CASE WHEN region_id % 2 = 0 THEN 'tesseract' ELSE 'htr' END AS engine",
        "CASE WHEN region_id % 3 = 0 THEN 'timeout' ELSE 'recognize_failed' END AS reason", "region_id AS pos")


_SUS = ", sus AS (SELECT r.*, n_readers < 2 OR n_disagreements > 0 OR agreement < 0.98 OR mean_confidence < 0.75 OR EXISTS (SELECT 1 FROM fails f WHERE f.job_id = r.job_id AND f.page = r.page AND f.region_id = r.region_id AND f.engine = 'tesseract') AS suspicious FROM region_rows r)"


@query("jn_13_failed_required_readers", _RR + f", {_FAIL} SELECT DISTINCT job_id, page, engine FROM fails WHERE engine IN ('tesseract', 'paddleocr_vl')")
def _(spark, sf):
    required = spark.createDataFrame([("tesseract",), ("paddleocr_vl",)], "engine string")
    return _fails(spark, sf).join(F.broadcast(required), "engine", "left_semi").select("job_id", "page", "engine").distinct()


@query("cn_05_needs_second_reading", _RR + f", {_FAIL}{_SUS} SELECT job_id, page, region_id, suspicious FROM sus")
def _(spark, sf):
    return pages.needs_second_reading(_regions(spark, sf), _fails(spark, sf), ["tesseract"]).select("job_id", "page", "region_id", "suspicious")


@query("wn_03_second_reading_budget", _RR + f", {_FAIL}{_SUS}, k AS (SELECT job_id, page, region_id, CAST(row_number() OVER (PARTITION BY job_id, page ORDER BY critical DESC, agreement, region_id) AS INTEGER) AS rank FROM sus WHERE suspicious) SELECT * FROM k WHERE rank <= 2")
def _(spark, sf):
    flagged = pages.needs_second_reading(_regions(spark, sf), _fails(spark, sf), ["tesseract"])
    return pages.second_reading_selection(flagged, 2).select("job_id", "page", "region_id", "rank")


@query("wn_03_exhausted_pages", _RR + f", {_FAIL}{_SUS} SELECT job_id, page FROM sus WHERE suspicious GROUP BY ALL HAVING count(*) > 2")
def _(spark, sf):
    return pages.exhausted_pages(pages.needs_second_reading(_regions(spark, sf), _fails(spark, sf), ["tesseract"]), 2)


@query("so_05_combined_readings", _REG + "SELECT job_id, page, region_id, count(*) + CASE WHEN job_id % 11 <> 0 THEN 1 ELSE 0 END AS readings FROM bulk WHERE region_id % 3 = 0 GROUP BY job_id, page, region_id")
def _(spark, sf):
    chosen = readings.regions(spark, sf).filter("region_id % 3 = 0")
    both = pages.with_second_readings(readings.bulk(spark, sf), readings.second(spark, sf), chosen)
    return both.groupBy("job_id", "page", "region_id").agg(F.count("*").alias("readings"))


_PG = f""", keys AS (SELECT DISTINCT job_id, page FROM region_rows), pg AS (SELECT p.*, k.page FROM page_rows p JOIN keys k USING (job_id)),
 facts AS (SELECT job_id, page, max(n_readers) > 0 AS any_reading, bool_or(critical) AS any_critical, min(agreement) AS a, min(mean_confidence) FILTER (n_readers > 0) AS c, max(n_readers) AS engines FROM region_rows GROUP BY ALL),
 ex AS (SELECT job_id, page, true AS x FROM sus WHERE suspicious GROUP BY ALL HAVING count(*) > 2), ff AS (SELECT job_id, page, bool_or(engine = 'htr') AS h, bool_or(engine = 'tesseract') AS t FROM fails GROUP BY ALL),
 rs AS (SELECT pg.*, any_reading, CASE WHEN quality_blocking THEN ['image_quality'] ELSE list_filter([CASE WHEN h THEN 'engine_unavailable:htr' END, CASE WHEN t THEN 'engine_unavailable:tesseract' END, CASE WHEN NOT any_reading THEN 'no_candidates' END,
   CASE WHEN any_reading AND any_critical THEN 'critical_uncertainty' END, CASE WHEN any_reading AND a < 0.98 THEN 'low_agreement' END, CASE WHEN any_reading AND c < 0.75 THEN 'low_confidence' END, CASE WHEN any_reading AND engines < 2 THEN 'single_engine' END, CASE WHEN x THEN 'verify_budget_exhausted' END], lambda r: r IS NOT NULL) END AS reasons
  FROM pg JOIN facts USING (job_id, page) LEFT JOIN ex USING (job_id, page) LEFT JOIN ff USING (job_id, page)),
 decided AS (SELECT job_id, page, classification, len(reasons) = 0 AS auto_clean, array_to_string(reasons, ',') AS reasons, CASE WHEN quality_blocking THEN 'needs_review' WHEN NOT any_reading THEN 'failed' WHEN len(reasons) = 0 AND auto_approve AND classification <> 'student_submission' THEN 'approved' ELSE 'needs_review' END AS status FROM rs)"""


def _decided(spark, sf):
    regions = _regions(spark, sf)
    keys = regions.select("job_id", "page").distinct()
    flagged = pages.needs_second_reading(regions, _fails(spark, sf), ["tesseract"])
    return pages.decide_pages(view(spark, sf, "page_rows").join(keys, "job_id"), _with_engines(regions), _fails(spark, sf), ["htr", "tesseract"], pages.exhausted_pages(flagged, 2))


@query("cn_06_page_decision", _RR + f", {_FAIL}{_SUS}{_PG} SELECT job_id, page, classification, status, auto_clean, reasons FROM decided")
def _(spark, sf):
    return _decided(spark, sf).withColumn("reasons", F.array_join("reasons", ","))


@query("cn_08_blocked_pages", _RR + f", {_FAIL}{_SUS}{_PG} SELECT job_id, page, status, reasons FROM decided WHERE reasons = 'image_quality'")
def _(spark, sf):
    return _decided(spark, sf).withColumn("reasons", F.array_join("reasons", ",")).filter("reasons = 'image_quality'").select("job_id", "page", "status", "reasons")


@query("ag_12_document_status", _RR + f", {_FAIL}{_SUS}{_PG} SELECT job_id, CASE WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_or(status = 'needs_review') THEN 'needs_review' WHEN bool_and(status = 'approved') THEN 'approved' ELSE 'needs_review' END AS status, count(*) AS pages FROM decided GROUP BY job_id")
def _(spark, sf):
    return pages.document_status(_decided(spark, sf))


@query("cn_07_unread_regions", _RR + ", built AS (SELECT * FROM region_rows WHERE n_readers > 0) SELECT a.job_id, a.page, a.region_id, COALESCE(b.n_readers, 0) AS n_readers, COALESCE(b.agreement, 0) AS agreement, COALESCE(b.selected_text, '') AS selected_text FROM region_rows a LEFT JOIN built b ON a.job_id = b.job_id AND a.page = b.page AND a.region_id = b.region_id")
def _(spark, sf):
    r = _regions(spark, sf)
    return pages.keep_unread(r, r.filter("n_readers > 0")).select("job_id", "page", "region_id", "n_readers", "agreement", "selected_text")


@query("cn_10_page_text", _RR + "SELECT job_id, page, string_agg(selected_text, chr(10) ORDER BY region_id) AS text, string_agg(consensus_text, chr(10) ORDER BY region_id) AS consensus_text FROM region_rows GROUP BY ALL")
def _(spark, sf):
    return pages.page_text(_regions(spark, sf))


@query("prj_07_withheld_text", _RR + f", {_FAIL}{_SUS}{_PG} SELECT r.job_id, r.page, region_id, status, CASE WHEN status = 'approved' THEN selected_text END AS selected_text, consensus_text FROM region_rows r JOIN decided USING (job_id, page)")
def _(spark, sf):
    joined = _regions(spark, sf).join(_decided(spark, sf).select("job_id", "page", "status"), ["job_id", "page"])
    return pages.withhold_text(joined, text="selected_text").select("job_id", "page", "region_id", "status", "selected_text", "consensus_text")


@query("ag_08_critical_counts", _RR + "SELECT job_id, count(*) FILTER (critical) AS critical, count(*) FILTER (critical AND NOT edited) AS unresolved_critical FROM region_rows GROUP BY job_id")
def _(spark, sf):
    return pages.critical_counts(_regions(spark, sf))


@query("ag_09_lowest_confidence", _RR + "SELECT job_id, page, min(mean_confidence) FILTER (n_readers > 0) AS min_confidence, count(*) AS n_regions FROM region_rows GROUP BY ALL")
def _(spark, sf):
    return pages.page_facts(_with_engines(_regions(spark, sf))).select("job_id", "page", "min_confidence", "n_regions")


_WORDROWS = "w AS (SELECT l_orderkey AS region_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 3 THEN '  ' ELSE ' w' || l_partkey END AS word, CASE WHEN l_linenumber = 5 THEN -1 ELSE l_quantity * 2 END AS conf FROM lineitem)"


@query("ag_10_reader_confidence", f"WITH {_WORDROWS}, k AS (SELECT region_id, string_agg(trim(word), ' ' ORDER BY pos) AS text, round(avg(conf / 100.0::DOUBLE), 6) AS confidence, count(*) AS tokens FROM w WHERE trim(word) <> '' AND conf >= 0 GROUP BY region_id) SELECT region_id, COALESCE(text, '') AS text, COALESCE(confidence, 0) AS confidence, COALESCE(tokens, 0) AS tokens FROM (SELECT DISTINCT region_id FROM w) LEFT JOIN k USING (region_id)")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS region_id", "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos",
        "CASE WHEN l_linenumber = 3 THEN '  ' ELSE concat(' w', l_partkey) END AS word", "CASE WHEN l_linenumber = 5 THEN -1 ELSE l_quantity * 2 END AS conf")
    return pages.reading_from_words(rows, ["region_id"]).withColumn("confidence", F.round("confidence", 6))


@query("ag_10_logprob_confidence", "SELECT l_orderkey AS region_id, round(COALESCE(avg(exp(-l_discount)) FILTER (l_linenumber <> 4), 0), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("region_id"), F.when(F.col("l_linenumber") == 4, F.lit(float("-inf"))).otherwise(-F.col("l_discount")).alias("logprob"))
    return pages.confidence_from_logprobs(rows, ["region_id"]).withColumn("confidence", F.round("confidence", 6))


@query("ag_11_reader_failures", _RR + f", {_FAIL} SELECT job_id, engine, arg_min(reason, pos) AS first_reason, count(*) AS failures FROM fails GROUP BY ALL")
def _(spark, sf):
    return pages.reader_summary(_fails(spark, sf))


_U = "greatest(0::DOUBLE, least(1::DOUBLE, {x}))"


@query("prj_18_image_quality", f"""WITH {view_sql('image_metrics')}, q AS (SELECT *, list_filter([CASE WHEN width < 300 OR height < 300 THEN 'too_small' END, CASE WHEN blur_score < 80 THEN 'too_blurry' END, CASE WHEN brightness < 0.25 THEN 'too_dark' WHEN brightness > 0.85 THEN 'too_bright' END,
  CASE WHEN contrast < 0.2 THEN 'low_contrast' END, CASE WHEN glare_ratio > 0.02 AND glare_ratio <= 0.45 THEN 'glare' END, CASE WHEN abs(skew_degrees) > 2 THEN 'skewed' END], lambda x: x IS NOT NULL) AS i,
  ({_U.format(x='blur_score / 240')} + {_U.format(x='contrast / 0.4')} + {_U.format(x='1 - abs(brightness - 0.5) * 2')} + {_U.format(x='1 - abs(skew_degrees) / 8')} + {_U.format(x='1 - glare_ratio / 0.1')}) / 5 AS mean FROM image_metrics)
 SELECT image_id, order_id, array_to_string(i, ',') AS issues, list_contains(i, 'too_blurry') OR list_contains(i, 'too_small') AS blocking, round(CASE WHEN list_contains(i, 'too_blurry') OR list_contains(i, 'too_small') THEN least(mean, 0.2) ELSE mean END, 6) AS score FROM q""")
def _(spark, sf):
    out = pages.assess_quality(view(spark, sf, "image_metrics"))
    return out.select("image_id", "order_id", F.array_join("issues", ",").alias("issues"), "blocking", F.round("score", 6).alias("score"))
