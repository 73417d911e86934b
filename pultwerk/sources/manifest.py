"""Backup manifests: what is stored, and whether it is still the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STUDENT_AREA = "students"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Notes and their backups below a folder, outside the student area.

    Name and folder are tested on the file listing, so no other file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],bak1,bak2,bak3}").load(path)
    return files.filter(~F.col("_metadata.file_path").contains(f"/{STUDENT_AREA}/")).select("path", "content")


def manifest(files: DataFrame) -> DataFrame:
    """files(path, content binary) → path, size and SHA-256 of notes and their backups."""
    parts = F.split("path", "/")
    kept = F.lower("path").endswith(".md") | F.col("path").rlike(r"\.bak[123]\z")
    return files.filter(kept & ~F.array_contains(parts, STUDENT_AREA)).select(
        "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(listed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Status per path: ok, missing, size_mismatch, hash_mismatch or unlisted."""
    l, i = listed.select("path", F.col("size").alias("ls"), F.col("sha256").alias("lh")), inventory.select("path", F.col("size").alias("fs"), F.col("sha256").alias("fh"))
    status = (F.when(F.col("fh").isNull(), "missing").when(F.col("lh").isNull(), "unlisted")
              .when(F.col("ls") != F.col("fs"), "size_mismatch").when(F.col("lh") != F.col("fh"), "hash_mismatch").otherwise("ok"))
    return l.join(i, "path", "full").select("path", status.alias("status"))
