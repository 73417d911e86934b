"""Usage events in, usage reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "request_id string, ts string, user_id long, model string, provider string, "
    "input_tokens long, output_tokens long, skill_name string, _corrupt string"
)


def _local_time(text: Column) -> Column:
    """Timestamps keep their own wall clock: the offset is dropped, never applied."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")).cast("timestamp_ntz")


def _typed(raw: DataFrame) -> DataFrame:
    return raw.filter("_corrupt is null").drop("_corrupt").withColumn("ts", _local_time(F.col("ts")))


def event_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, reason) of lines that are no event, or have no time that can be read.

    Lines of the first kind are left out by ``read_events``; the others come without a time.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter("trim(value) <> ''")
    event = F.from_json("value", EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    read = lines.withColumn("_e", event)
    reason = F.when(F.col("_e._corrupt").isNotNull(), "not_json").when(F.col("_e.ts").isNull(), "no_time").when(_local_time(F.col("_e.ts")).isNull(), "unreadable_time")
    return read.select("path", "value", reason.alias("reason")).filter("reason is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(EVENT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt")
    return _typed(reader.json(path))


def stream_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive; all that are there in one batch unless a number is named."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _typed(reader.json(path))


def write_json_report(rollups: DataFrame, path: str) -> None:
    """Partitioned by period: one directory per summary, each written in parallel."""
    rollups.write.mode("overwrite").partitionBy("period").json(path)


def monthly_csv(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        F.col("month").alias("Month"), F.col("total_tokens").alias("Total Tokens"),
        F.col("input_tokens").alias("Input Tokens"), F.col("output_tokens").alias("Output Tokens"),
        F.format_string("%.2f", "cost_usd").alias("Cost (USD)"), F.col("requests").alias("Requests"))


def skill_csv(by_skill: DataFrame) -> DataFrame:
    return by_skill.select(
        F.col("name").alias("Skill Name"), F.col("executions").alias("Executions"),
        F.col("total_tokens").alias("Total Tokens"), F.col("input_tokens").alias("Input Tokens"),
        F.col("output_tokens").alias("Output Tokens"), F.format_string("%.2f", "cost_usd").alias("Cost (USD)"),
        F.col("first_used").cast("string").alias("First Used"), F.col("last_used").cast("string").alias("Last Used"))


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def write_text(lines: DataFrame, path: str) -> None:
    """The text report is at most eighteen lines, so one file is right for it."""
    ordered = lines.orderBy("section", F.when(F.col("section") == 2, F.col("sort_key")).desc(), "sort_key")
    ordered.select("line").coalesce(1).write.mode("overwrite").text(path)
