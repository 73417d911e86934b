"""Learner tables in one folder, cut into buckets by key, changed bucket by bucket.

Every table that holds anything on a learner is registered with the column that leads to
them. An erasure first writes tombstones for all tables (hashes of the keys, so they are no
trace themselves), from then on nobody reads the rows any more; then the buckets that hold
such rows, and no others, are rewritten without them. A run that was cut short is taken up
by ``settle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.operators import records
from pultwerk.sources import folders

BUCKETS = 32
# files that a bucket is written to at most, so that a learner with very many rows is not one task
BUCKET_FILES = 8


@dataclass(frozen=True)
class Kept:
    """A registered table and its key. ``via`` names the tables and columns in which a
    learner's keys stand if the rows themselves don't hold the learner's id."""

    name: str
    key: str = "student_id"
    via: tuple[tuple[str, str], ...] = ()


LEARNER_TABLES = (
    Kept("records"), Kept("index"), Kept("observations"), Kept("versions"),
    # names that a learner had before count as well
    Kept("aliases", "real", (("records", "name"), ("versions", "name"))), Kept("chunks", "document_id", (("observations", "obs_id"),)),
)


def _text(key: Column) -> Column:
    return key.cast("string")


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(_text(key)), F.lit(BUCKETS)).cast("int")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(BUCKET_FILES))
    return rows.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket", spread)


def write(rows: DataFrame, root: str, kept: Kept) -> None:
    # a table may have no rows and so no files of its own
    rows.limit(0).write.mode("overwrite").parquet(f"{root}/_schemas/{kept.name}")
    _dealt(rows, kept.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{kept.name}")


def raw(spark: SparkSession, root: str, kept: Kept) -> DataFrame:
    """Everything that lies in the table's files, with its bucket."""
    schema = spark.read.parquet(f"{root}/_schemas/{kept.name}").schema.add("bucket", "integer")
    return spark.read.schema(schema).parquet(f"{root}/{kept.name}")


def _tombstones(spark: SparkSession, root: str) -> DataFrame | None:
    folder = f"{root}/_tombstones"
    return spark.read.schema("table string, hashed string, bucket int, erasure string").parquet(folder) if folders.exists(spark, folder) else None


def read(spark: SparkSession, root: str, kept: Kept, buckets: list[int] | None = None) -> DataFrame:
    """The table (or some of its buckets) without erased rows, rewritten yet or not."""
    rows, stones = raw(spark, root, kept), _tombstones(spark, root)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    if stones is not None:
        gone = stones.filter(F.col("table") == kept.name).select("hashed")
        rows = rows.withColumn("hashed", F.sha2(_text(F.col(kept.key)), 256)).join(gone, "hashed", "left_anti").drop("hashed")
    return rows.drop("bucket")


def _replace(spark: SparkSession, root: str, change: str, name: str, rows: DataFrame, buckets: Iterable[int]) -> None:
    """Puts new buckets in place of old ones; ``rows`` is all that the buckets are to hold."""
    staged, aside = f"{root}/_staged/{change}/{name}", f"{root}/_aside/{change}/{name}"
    rows.write.mode("overwrite").partitionBy("bucket").parquet(staged)
    for bucket in buckets:
        here, before, new = (f"{base}/bucket={bucket}" for base in (f"{root}/{name}", aside, staged))
        if folders.exists(spark, here):
            folders.move(spark, here, before)
        if folders.exists(spark, new):
            folders.move(spark, new, here)
    for folder in (aside, staged):
        folders.remove(spark, folder)


def _touched(rows: DataFrame) -> list[int]:
    """At most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


def _keys(spark: SparkSession, root: str, kept: Kept, erasures: DataFrame, tables: dict[str, Kept]) -> DataFrame:
    """Keys of the table's rows on the erased learners; a key that others use as well stays."""
    if not kept.via:
        return erasures.select(F.col("student_id").alias("key")).distinct()
    held = reduce(DataFrame.unionByName, [read(spark, root, tables[t]).select("student_id", F.col(c).alias("key")) for t, c in kept.via]).filter("key is not null")
    theirs = held.join(erasures, "student_id", "left_semi").select("key").distinct()
    others = held.join(erasures, "student_id", "left_anti").select("key").distinct()
    return theirs.join(others, "key", "left_anti")


def erase(spark: SparkSession, root: str, erasures: DataFrame, tables: Iterable[Kept] = LEARNER_TABLES) -> None:
    """Removes everything on the learners of ``erasures(student_id)`` from every table."""
    tables, erasure = {t.name: t for t in tables}, uuid.uuid4().hex
    wanted = erasures.select("student_id").filter("student_id is not null").distinct()
    stones = [_keys(spark, root, t, wanted, tables).select(F.lit(name).alias("table"), F.sha2(_text(F.col("key")), 256).alias("hashed"), bucket_of(F.col("key")).alias("bucket"))
              for name, t in tables.items()]
    # all tombstones at once, before the first row goes: some tables lead to others
    reduce(DataFrame.unionByName, stones).write.parquet(f"{root}/_tombstones/erasure={erasure}")
    _settle(spark, root, erasure, tables)


def _settle(spark: SparkSession, root: str, erasure: str, tables: dict[str, Kept]) -> None:
    stones = spark.read.schema("table string, hashed string, bucket int").parquet(f"{root}/_tombstones/erasure={erasure}")
    for name, kept in tables.items():
        aside = f"{root}/_aside/{erasure}/{name}"
        for bucket in range(BUCKETS) if folders.exists(spark, aside) else ():
            # an earlier run stopped between taking the old bucket away and putting the new one
            here, before = f"{root}/{name}/bucket={bucket}", f"{aside}/bucket={bucket}"
            if folders.exists(spark, before) and not folders.exists(spark, here):
                folders.move(spark, before, here)
        mine = stones.filter(F.col("table") == name)
        touched = _touched(mine)
        if touched:
            left = raw(spark, root, kept).filter(F.col("bucket").isin(touched)).withColumn("hashed", F.sha2(_text(F.col(kept.key)), 256))
            _replace(spark, root, erasure, name, left.join(mine.select("hashed"), "hashed", "left_anti").drop("hashed"), touched)
    spark.range(0).write.mode("overwrite").parquet(f"{root}/_settled/{erasure}")


def settle(spark: SparkSession, root: str, tables: Iterable[Kept] = LEARNER_TABLES) -> int:
    """Finishes erasures that stopped half way; returns how many there were."""
    stones, open_ones = _tombstones(spark, root), []
    for (erasure,) in stones.select("erasure").distinct().collect() if stones is not None else ():
        if not folders.exists(spark, f"{root}/_settled/{erasure}"):
            open_ones.append(erasure)
            _settle(spark, root, erasure, {t.name: t for t in tables})
    return len(open_ones)


def upsert(spark: SparkSession, root: str, patches: DataFrame, columns: list[str]) -> None:
    """Patches records; the index and the prior versions follow in the same step.

    Only the buckets of the patched learners are read and written.
    """
    change = uuid.uuid4().hex
    touched = _touched(patches.select(bucket_of(F.col("student_id")).alias("bucket")))
    if not touched:
        return
    table = {name: Kept(name) for name in ("records", "index", "versions")}
    part = lambda name: read(spark, root, table[name], touched)
    new = _named(records.upsert(part("records"), patches, "student_id", columns))
    before = part("records").join(patches.select("student_id"), "student_id", "left_semi")
    old = before.select("student_id", F.lit(change).alias("change"), "name", F.to_json(F.struct(*columns)).alias("payload"))
    for name, rows in (("versions", part("versions").unionByName(old)), ("index", records.index_of(new)), ("records", new)):
        _replace(spark, root, change, name, _dealt(rows, "student_id"), touched)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", F.concat_ws(" ", "given_name", "family_name"))


def create(root: str, students: DataFrame, observations: DataFrame, aliases: DataFrame, chunks: DataFrame) -> None:
    """Writes the learner tables anew: records with their index, no prior versions yet."""
    named = _named(students)
    versions = students.sparkSession.createDataFrame([], f"student_id {students.schema['student_id'].dataType.simpleString()}, change string, name string, payload string")
    for kept, rows in zip(LEARNER_TABLES, (named, records.index_of(students), observations, versions, aliases, chunks)):
        write(rows, root, kept)
