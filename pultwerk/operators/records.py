"""Student records: upsert, ratings, access and erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk.functions.text import strip

RECORD_SCHEMA = (
    "struct<id:bigint,schema_version:int,identity:struct<vorname:string,nachname:string,pronomen:string>,"
    "klasse:bigint,competencies:map<string,map<string,struct<rating:string,scale:string>>>>"
)


def upsert(current: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Patched fields win where they are given; unknown keys are added."""
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return current.join(p, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def index_of(records: DataFrame) -> DataFrame:
    """The small list view kept in step with the records."""
    return records.select("student_id", "class_id", F.concat_ws(" ", "given_name", "family_name").alias("name"))


def in_class(records: DataFrame, class_id=None) -> DataFrame:
    return records if class_id is None else records.filter(F.col("class_id") == class_id)


def latest_ratings(observations: DataFrame) -> DataFrame:
    """Latest rating per student, subject and competency, as a combined maximum."""
    newest = F.max_by(F.struct("rating", "scale", "obs_date"), F.struct("obs_date", "obs_id")).alias("_l")
    return observations.groupBy("student_id", "subject", "competency").agg(newest).select(
        "student_id", "subject", "competency", "_l.rating", "_l.scale", "_l.obs_date")


def rating_label(rating: Column, scale: Column) -> Column:
    top = strip(F.element_at(F.split(scale, "-"), -1))
    return (F.when(rating.isNull(), "").when(F.coalesce(scale, F.lit("")).contains("-"), F.concat_ws(" / ", rating, top))
            .otherwise(rating))


def competency_rows(ratings: DataFrame) -> DataFrame:
    return ratings.select("student_id", "subject", "competency", rating_label(F.col("rating"), F.col("scale")).alias("label")).orderBy(
        "student_id", "subject", "competency")


def nested_records(students: DataFrame, ratings: DataFrame) -> DataFrame:
    """One JSON document per student. Ratings are already one per competency, so a document
    is as long as the list of competencies; observations stay rows of their own."""
    by_subject = ratings.groupBy("student_id", "subject").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("competency", F.struct("rating", "scale"))))).alias("c"))
    nested = by_subject.groupBy("student_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "c"))).alias("competencies"))
    record = F.struct(
        F.col("student_id").alias("id"), F.lit(1).alias("schema_version"),
        F.struct(F.col("given_name").alias("vorname"), F.col("family_name").alias("nachname"), F.col("pronoun").alias("pronomen")).alias("identity"),
        F.col("class_id").alias("klasse"), "competencies")
    return students.join(nested, "student_id", "left").select("student_id", F.to_json(record).alias("value"))


def parse_records(json_rows: DataFrame) -> DataFrame:
    """Documents that do not parse are dropped; a missing version counts as 1."""
    parsed = json_rows.select(F.from_json("value", RECORD_SCHEMA).alias("r")).filter("r.id is not null").select("r.*")
    return parsed.withColumn("schema_version", F.coalesce("schema_version", F.lit(1)))


def erase(table: DataFrame, erasures: DataFrame, key: str = "student_id") -> DataFrame:
    """Rows of the erased subjects removed; run over every table that holds the key."""
    return table.join(erasures.select(key), key, "left_anti")


def access_rows(requests: DataFrame, tables: dict[str, DataFrame], key: str = "student_id") -> DataFrame:
    """Everything held on the requested subjects, as (key, kind, payload) rows.

    Rows, not one document per subject: a subject with very many rows stays spread out.
    """
    wanted = requests.select(key).distinct()
    parts = [t.join(wanted, key, "left_semi").select(key, F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in t.columns if c != key])).alias("payload"))
             for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def shared_difficulties(observations: DataFrame) -> DataFrame:
    """Difficulties named by more than one learner."""
    return observations.groupBy("competency").agg(F.countDistinct("student_id").alias("learners")).filter("learners > 1")


def school_year(day: Column) -> Column:
    start = F.year(day) - F.when(F.month(day) >= 8, 0).otherwise(1)
    return F.concat(start.cast("string"), F.lit("/"), F.substring((start + 1).cast("string"), -2, 2))
