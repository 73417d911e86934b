"""The corpus pipeline: quality rules, quality classifier, line dedup, near dedup, packing.

Every stage works on all documents that its predecessor kept. Each result is written and
read again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.llm import line_dedup, near_dedup, packing, quality_model, quality_rules
from pultwerk.llm.common import short_batches, stored
from pultwerk.sources.tables import table


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return quality_rules.kept_documents(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return quality_model.kept_documents(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return line_dedup.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return near_dedup.kept_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), special=packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_copies),
    ("packing", packed),
]

# tokenising, fuzzy lines and the classifier have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
