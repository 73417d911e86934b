"""Every operator over tables whose further columns have the names used inside."""

import public_tokenizers
import pytest

from pultwerk.llm import alignment, line_dedup, main_text, merkle, near_dedup, nearest, packing, piece_coding, quality_model, quality_rules, sharding, url_filter, winnowing

ODD = ["_whole", "whole", "_page", "page", "gone", "_doc", "doc", "_row", "row", "_row2", "d", "parts", "n_lines", "n_gone", "node", "band", "component", "part", "queue", "n_tokens", "place", "grp", "leaf", "shard", "pos", "radius", "pair", "times", "x", "y", "_range", "_copy"]
LINE = "a line that is long enough to be compared with others"
TEXTS = [(1, f"{LINE}\nfirst of all"), (2, f"{LINE}\nsecond to none"), (2, f"{LINE}\nsecond to none"), (3, None), (4, ""), (None, "no key"), (5, "word " * 3000)]
RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" if i != 4 else None, None if t is None else len(t), f"<p>{t}</p>", [float(i or 0), 1.0], "http://a.b/c", *("odd",) * len(ODD)) for i, t in TEXTS]
    odd = ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, html string, vector array<double>, url string, {odd}")


OPERATORS = {
    "packing": lambda d: packing.pack(d, RANKS),
    "quality_model": lambda d: quality_model.scored(d, quality_model.fit(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))),
    "url_filter": lambda d: url_filter.judged(d, [0.0] * (url_filter.BUCKETS + 1)),
    "piece_coding": lambda d: piece_coding.coded(d, MODEL),
    "quality_rules": lambda d: quality_rules.judged(d, list(quality_rules.RULES), counts=True),
    "near_dedup": lambda d: near_dedup.kept_documents(d),
    "line_dedup": lambda d: line_dedup.deduplicated(d),
    "winnowing": lambda d: winnowing.next_compared(d),
    "main_text": lambda d: main_text.extracted(d),
    "sharding": lambda d: sharding.shard_documents(d, 3),
    "merkle": lambda d: merkle.lower_cased_copies(d),
    "nearest": lambda d: nearest.nearest(nearest.indexed(d.withColumnRenamed("doc_id", "id")), d.withColumnRenamed("doc_id", "id"), 2),
    "alignment": lambda d: alignment.aligned_and_scored(d, RANKS, MODEL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_empty_tables(spark, docs, name):
    assert OPERATORS[name](docs).collect()
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_kept_documents_leave_other_columns_alone(spark, docs):
    for kept in (line_dedup.kept_documents(docs), near_dedup.kept_documents(docs)):
        assert kept.columns == docs.columns
        assert {(r["n_lines"], r["n_gone"], r["gone"]) for r in kept.collect()} == {("odd", "odd", "odd")}


def test_a_key_without_order_is_an_error(docs):
    with pytest.raises(TypeError):
        winnowing.next_compared(docs.withColumnRenamed("doc_id", "number").withColumnRenamed("x", "doc_id"))


def test_weights_fit_the_sum_of_many_long_queues():
    mixture = packing.Mixture([float(i + 1) for i in range(200)], [2 * 10**12] * 200)
    taken = mixture.taken([10**14, 3 * 10**14])
    assert (taken.sum(axis=1) == [10**14, 3 * 10**14]).all() and (taken >= 0).all() and (taken <= 2 * 10**12).all()
