"""The registered queries of this package and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.llm import alignment, line_dedup, main_text, merkle, near_dedup, nearest, packing, piece_coding, quality_model, quality_rules, sharding, url_filter, winnowing
from pultwerk.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # target proportions: the square roots of the sources' token counts, so a hot source leaves room
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")), temper=0.5)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.scored(docs.withColumn("held_out", quality_model.fold_of(F.col("doc_id")) == 0), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judged(pages, url_filter.trained(url_filter.seed_table(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_coding.coded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


# words, their repeats and lines as in the Python counts; the other rules as conditions
_OP5_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT row_no, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), grams AS (
  SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), often AS (
  SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, gram) AS n FROM grams) WHERE n > 1
), marked AS (
  SELECT row_no, count(DISTINCT p) AS n FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY row_no
), base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks
  FROM split LEFT JOIN marked USING (row_no)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_capitals <= 30 * word_chars AND 10 * n_marks <= 3 * n_words
    AND 100 * n_dup_lines <= 60 * n_lines AND word_chars BETWEEN 2 * n_words AND 20 * n_words AS kept
FROM failed
"""


@query("op5_quality_rules", _OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judged(docs.select("doc_id", "text"), quality_rules.plan(quality_rules.measure(docs)), counts=True)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )


_OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.doc_id
), named AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t LEFT JOIN sized USING (doc_id) JOIN named USING (doc_id)
"""


@query("op6_minhash_dedup", _OP6_SQL)
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"), 85)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_gone").cast("long").alias("n_gone"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = winnowing.next_compared(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


# levels from the bottom up, then every row's way to the root with its siblings
_OP11_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT row_number() OVER () AS row_no, *, CAST(doc_id AS VARCHAR) AS id FROM documents
), fields AS (
  SELECT row_no, doc_id, source, text, id,
    coalesce(octet_length(encode(id)) || ':' || id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM bytes
), leaves AS (
  SELECT row_no, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS edited
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM leaves
), nodes(level, source, place, total, digest) AS (
  SELECT 0, source, place, total, leaf FROM placed
  UNION ALL
  SELECT level + 1, source, place // 16, (total + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE total > 1 GROUP BY level, source, place // 16, total
), tops AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total, source, level, digest FROM nodes WHERE total = 1
), upper(level, place, total, digest) AS (
  SELECT 0, place, total, digest FROM tops
  UNION ALL
  SELECT level + 1, place // 16, (total + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM upper WHERE total > 1 GROUP BY level, place // 16, total
), root AS (SELECT digest AS root FROM upper WHERE total = 1
), steps AS (
  SELECT p.row_no, n.level, n.place, p.place // CAST(pow(16, n.level) AS BIGINT) AS own, n.digest
  FROM placed p JOIN nodes n ON n.source IS NOT DISTINCT FROM p.source AND n.total > 1
    AND n.place // 16 = p.place // CAST(pow(16, n.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.row_no, 1000 + u.level, u.place, t.place // CAST(pow(16, u.level) AS BIGINT), u.digest
  FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN upper u ON u.total > 1
    AND u.place // 16 = t.place // CAST(pow(16, u.level + 1) AS BIGINT)
), runs AS (
  SELECT row_no, level, row_number() OVER (PARTITION BY row_no ORDER BY level) AS step,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before_own, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS after_own
  FROM steps GROUP BY row_no, level
), folded(row_no, step, digest) AS (
  SELECT row_no, 0, coalesce(edited, leaf) FROM placed
  UNION ALL
  SELECT f.row_no, f.step + 1, sha256(r.before_own || f.digest || r.after_own) FROM folded f JOIN runs r ON r.row_no = f.row_no AND r.step = f.step + 1
), proofs AS (SELECT row_no, sha256(string_agg(before_own || after_own, '' ORDER BY step)) AS proof FROM runs GROUP BY row_no
), ends AS (SELECT row_no, arg_max(digest, step) AS folded_root FROM folded GROUP BY row_no)
SELECT p.doc_id, p.leaf, t.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source CROSS JOIN root JOIN ends USING (row_no) LEFT JOIN proofs USING (row_no)
"""


@query("op11_merkle_manifest", _OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.lower_cased_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_nearest_vectors", _OP12_SQL)
def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest.nearest(nearest.indexed(rows), rows.where("id % 100 = 0"), 10, factor=1.0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned_and_scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
