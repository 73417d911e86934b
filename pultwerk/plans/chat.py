"""A whole chat turn as one batch job: skill, gate, retrieval, privacy decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.operators import privacy, retrieval, routing
from pultwerk.session import cut_lineage


def chat_turns(requests: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests(request_id, text, job_ids, embedding, requested_mode, sticky_mode) → one row each.

    Requests stopped by the gate never reach the search. Context text counts as request
    text for the privacy decision, and the classes of hits and jobs count alike.
    """
    routed = requests.withColumn("skill_id", routing.match_skill(F.col("text")))
    # four branches start here, so the gated requests are kept once instead of recomputed
    gated = cut_lineage(privacy.grading_gate(routed, jobs))
    passed = gated.filter("allowed")
    hits = retrieval.search(passed.select(F.col("request_id").alias("query_id"), "embedding"), chunks)
    found = retrieval.context(hits, chunks).select(F.col("query_id").alias("request_id"), "context", F.col("classifications").alias("_found"))
    referenced = privacy.resolve_jobs(passed, jobs).groupBy("request_id").agg(F.collect_set("classification").alias("_jobs"))
    none = F.array().cast("array<string>")
    ready = (gated.join(found, "request_id", "left").join(referenced, "request_id", "left")
             .withColumn("classifications", F.concat(F.coalesce("_found", none), F.coalesce("_jobs", none)))
             .withColumn("texts", F.array_compact(F.array("text", "context"))))
    decided = privacy.decide(ready)
    return decided.select(
        "request_id", "skill_id", "allowed", "gate_reasons", F.size(F.coalesce("_found", none)).alias("hits"),
        F.when(F.col("allowed"), F.col("mode")).alias("mode"), F.when(F.col("allowed"), F.col("reasons")).alias("reasons"))
