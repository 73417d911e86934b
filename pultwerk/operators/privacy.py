"""Routing decisions over tables of requests, documents and endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import privacy as px


def minimal_profile(profile: Column) -> Column:
    """Only the fields that may leave the machine."""
    return F.map_filter(profile, lambda key, _: key.isin(fv.CLOUD_PROFILE_FIELDS))


def route_model(skill: Column, preferred: Column) -> Column:
    return F.when(skill.isin(fv.SENSITIVE_SKILLS), F.lit("ollama")).otherwise(preferred)


def document_reasons(classes: Column) -> Column:
    """Reasons that come from the classes of the referenced documents."""
    forbidden = F.array(*[F.lit(c) for c in fv.CLOUD_FORBIDDEN])
    return F.array_compact(F.array(
        F.when(F.exists(classes, lambda c: c != "public_curriculum"), "document_not_public"),
        F.when(F.arrays_overlap(classes, forbidden), "student_submission")))


def decide(requests: DataFrame, texts: str = "texts", classes: str = "classifications",
           skill: str = "skill_id", requested: str = "requested_mode", sticky: str = "sticky_mode") -> DataFrame:
    """Adds ``mode`` and the sorted ``reasons``; any reason at all keeps the request local."""
    c = {k: F.col(v) for k, v in dict(t=texts, d=classes, s=skill, r=requested, k=sticky).items()}
    plain = F.array_compact(F.array(
        F.when(c["r"] == "local_required", "user_requested_local"),
        F.when(c["k"] == "local_required", "chat_already_local"),
        F.when(c["s"].isin(fv.SENSITIVE_SKILLS), F.concat(F.lit("sensitive_skill:"), c["s"]))))
    personal = F.transform(px.findings_in(c["t"]), lambda f: F.concat(F.lit("personal_data:"), f))
    reasons = F.array_sort(F.array_distinct(F.concat(plain, document_reasons(c["d"]), personal)))
    return requests.withColumn("reasons", reasons).withColumn(
        "mode", F.when(F.size("reasons") > 0, "local_required").otherwise("cloud_allowed"))


def sticky_mode(turns: DataFrame, local: Column) -> DataFrame:
    """Once a turn is local, every later turn of the chat is.

    The first local turn per chat is a map-side combined minimum, so no chat has to fit
    into one window; chats without a local turn do not even reach the join.
    """
    first = turns.filter(local).groupBy("conv_id").agg(F.min("turn").alias("_first_local"))
    return turns.join(first, "conv_id", "left").withColumn(
        "sticky_mode", F.when(F.col("turn") >= F.col("_first_local"), "local_required").otherwise("auto")).drop("_first_local")


def resolve_jobs(requests: DataFrame, jobs: DataFrame, limit: int = 20) -> DataFrame:
    """One row per referenced job (the first ``limit`` of each request), unknown if missing."""
    refs = requests.select("request_id", F.posexplode(F.slice("job_ids", 1, limit)).alias("pos", "job_id"))
    return refs.join(jobs.select("job_id", "classification"), "job_id", "left").withColumn(
        "classification", F.coalesce("classification", F.lit("unknown")))


def grading_gate(requests: DataFrame, jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Gate per request with its ordered reasons; at most ``limit`` jobs per request exist."""
    refs = requests.filter(F.col("skill_id").isin(fv.GRADING_SKILLS)).select(
        "request_id", F.posexplode(F.slice("job_ids", 1, limit)).alias("pos", "job_id"))
    known = jobs.select("job_id", "status", "unresolved_critical")
    reason = (F.when(F.col("status").isNull(), "unknown_job").when(F.col("status") != "approved", "not_approved")
              .when(F.col("unresolved_critical") > 0, "critical_uncertainty"))
    blocked = (refs.join(known, "job_id", "left").withColumn("reason", reason).filter("reason is not null")
               .groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(
                   "pos", F.concat_ws(":", "reason", F.col("job_id").cast("string")).alias("reason")))).alias("_r")))
    return (requests.join(blocked, "request_id", "left")
            .withColumn("gate_reasons", F.coalesce(F.col("_r.reason"), F.array().cast("array<string>")))
            .withColumn("allowed", F.size("gate_reasons") == 0).drop("_r"))
