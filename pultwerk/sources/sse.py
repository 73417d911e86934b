"""Streamed model output (``data: {json}`` lines) put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.functions.text import strip

EVENT = "choices array<struct<delta:struct<content:string>>>, usage struct<prompt_tokens:long,completion_tokens:long>"


def reassemble(lines: DataFrame, key: list[str]) -> DataFrame:
    """lines(key…, pos, value) → text and usage per response.

    Only lines before the end mark count, and lines that are not JSON are skipped. The
    pieces gathered are those of one response.
    """
    data = lines.withColumn("value", strip(F.col("value"))).filter("startswith(value, 'data: ')").withColumn("body", strip(F.substr("value", F.lit(7))))
    end = data.filter("body = '[DONE]'").groupBy(*key).agg(F.min("pos").alias("_end"))
    parsed = data.join(end, key, "left").filter("_end is null or pos < _end").withColumn("event", F.from_json("body", EVENT))
    piece = F.get("event.choices", F.lit(0))["delta"]["content"]
    rows = parsed.withColumn("piece", piece)
    out = rows.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("pos", "piece")))), lambda s: s["piece"]), "").alias("text"),
        F.max_by("event.usage", F.when(F.col("event.usage").isNotNull(), F.col("pos"))).alias("usage"))
    return out.select(*key, "text", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"))
