"""Page and document decisions over region rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.operators import consensus
from pultwerk.functions.reading import Vocabulary

PAGE = ["job_id", "page"]
REGION = [*PAGE, "region_id"]


# --- image quality -------------------------------------------------------------------

def quality_issues() -> Column:
    q, c = fv.QUALITY, F.col
    return F.array_compact(F.array(
        F.when((c("width") < q["min_width"]) | (c("height") < q["min_height"]), "too_small"),
        F.when(c("blur_score") < q["blur_min"], "too_blurry"),
        F.when(c("brightness") < q["dark_max"], "too_dark").when(c("brightness") > q["bright_min"], "too_bright"),
        F.when(c("contrast") < q["contrast_min"], "low_contrast"),
        F.when((c("glare_ratio") > q["glare_warn"]) & (c("glare_ratio") <= q["glare_max"]), "glare"),
        F.when(F.abs("skew_degrees") > q["skew_warn"], "skewed")))


def assess_quality(metrics: DataFrame) -> DataFrame:
    """Issues, blocking flag and a 0–1 score from the metric columns of an image."""
    q, c = fv.QUALITY, F.col
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = [unit(c("blur_score") / (q["blur_min"] * 3)), unit(c("contrast") / (q["contrast_min"] * 2)), unit(1 - F.abs(c("brightness") - 0.5) * 2),
             unit(1 - F.abs("skew_degrees") / q["skew_search"]), unit(1 - c("glare_ratio") / (q["glare_warn"] * 5))]
    mean = (parts[0] + parts[1] + parts[2] + parts[3] + parts[4]) / 5
    out = metrics.withColumn("issues", quality_issues())
    out = out.withColumn("blocking", F.arrays_overlap("issues", F.array(F.lit("too_blurry"), F.lit("too_small"))))
    return out.withColumn("score", F.when(c("blocking"), F.least(mean, F.lit(q["blocked_score"]))).otherwise(mean))


# --- regions -------------------------------------------------------------------------

def keep_unread(all_regions: DataFrame, built: DataFrame) -> DataFrame:
    """Every segmented region, also those no reader returned anything for."""
    out = all_regions.select(*REGION).join(built, REGION, "left")
    fill = {"selected_text": "", "consensus_text": "", "agreement": 0.0, "n_readers": 0, "n_disagreements": 0, "critical": False}
    return out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in fill.items() if k in built.columns})


def needs_second_reading(regions: DataFrame, failures: DataFrame | None = None, required: list[str] = (),
                         min_agreement: float = fv.MIN_AGREEMENT, min_confidence: float = fv.MIN_CONFIDENCE) -> DataFrame:
    """Flags regions that deserve another reader."""
    flagged = regions.withColumn("_failed", F.lit(False))
    if failures is not None and required:
        failed = failures.filter(F.col("engine").isin(list(required))).select(*REGION).distinct().withColumn("_f", F.lit(True))
        flagged = regions.join(failed, REGION, "left").withColumn("_failed", F.coalesce("_f", F.lit(False))).drop("_f")
    suspicious = ((F.col("n_readers") < 2) | (F.col("n_disagreements") > 0) | (F.col("agreement") < min_agreement)
                  | (F.col("mean_confidence") < min_confidence) | F.col("_failed"))
    return flagged.withColumn("suspicious", suspicious).drop("_failed")


def second_reading_selection(flagged: DataFrame, budget: int = fv.SECOND_READINGS_PER_PAGE) -> DataFrame:
    """Suspicious regions within the page's budget: critical first, then least agreement."""
    order = W.partitionBy(*PAGE).orderBy(F.desc("critical"), "agreement", "region_id")
    return flagged.filter("suspicious").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget)


def exhausted_pages(flagged: DataFrame, budget: int = fv.SECOND_READINGS_PER_PAGE) -> DataFrame:
    return flagged.filter("suspicious").groupBy(*PAGE).agg(F.count("*").alias("n")).filter(F.col("n") > budget).select(*PAGE)


def with_second_readings(bulk: DataFrame, extra: DataFrame, selected: DataFrame) -> DataFrame:
    """Readings of the selected regions with the second readers' added."""
    chosen = selected.select(*REGION)
    return bulk.join(chosen, REGION, "left_semi").unionByName(extra.join(chosen, REGION, "left_semi"))


def second_reading(built: DataFrame, bulk: DataFrame, extra: DataFrame, flagged: DataFrame,
                   vocabulary: Vocabulary = Vocabulary(), budget: int = fv.SECOND_READINGS_PER_PAGE) -> DataFrame:
    """Regions after the second reading; only regions that got one are worked out again.

    A selected region for which every second reader failed keeps its first result and is
    marked ``verify_failed``.
    """
    selected = second_reading_selection(flagged, budget).select(*REGION)
    answered = extra.select(*REGION).distinct()
    again = selected.join(answered, REGION, "left_semi")
    redone = consensus.build_regions(with_second_readings(bulk, extra, again), vocabulary).withColumn("verify_failed", F.lit(False))
    failed = selected.join(answered, REGION, "left_anti").withColumn("_vf", F.lit(True))
    kept = built.join(again, REGION, "left_anti").join(failed, REGION, "left").withColumn("verify_failed", F.coalesce("_vf", F.lit(False))).drop("_vf")
    return kept.unionByName(redone.select(*kept.columns))


# --- pages ---------------------------------------------------------------------------

def page_facts(regions: DataFrame) -> DataFrame:
    """What a page decision needs, from one aggregation over its regions."""
    read = F.col("n_readers") > 0
    return regions.groupBy(*PAGE).agg(
        F.count("*").alias("n_regions"), F.max(read).alias("any_reading"), F.max("critical").alias("any_critical"),
        F.min("agreement").alias("min_agreement"), F.min(F.when(read, F.col("mean_confidence"))).alias("min_confidence"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.coalesce("engines", F.array().cast("array<string>")))))).alias("n_engines"))


def decide_pages(pages: DataFrame, regions: DataFrame, failures: DataFrame, required: list[str] = (),
                 exhausted: DataFrame | None = None, min_agreement: float = fv.MIN_AGREEMENT, min_confidence: float = fv.MIN_CONFIDENCE) -> DataFrame:
    """pages(job_id, page, classification, auto_approve, quality_blocking) → status and reasons.

    Blocked images need a new picture: they get their reason without any reading being
    looked at. Student work is never approved by itself.
    """
    failed = failures.groupBy(*PAGE).agg(F.collect_set("engine").alias("failed"))
    joined = pages.join(page_facts(regions), PAGE, "left").join(failed, PAGE, "left")
    if exhausted is not None:
        joined = joined.join(exhausted.withColumn("_x", F.lit(True)), PAGE, "left")
    else:
        joined = joined.withColumn("_x", F.lit(None).cast("boolean"))
    c = F.col
    missing = [F.when(F.array_contains("failed", e), f"engine_unavailable:{e}") for e in required]
    unread = ~F.coalesce(c("any_reading"), F.lit(False))
    found = F.array_compact(F.array(
        *missing, F.when(unread, "no_candidates"), F.when(~unread & c("any_critical"), "critical_uncertainty"),
        F.when(~unread & (c("min_agreement") < min_agreement), "low_agreement"), F.when(~unread & (c("min_confidence") < min_confidence), "low_confidence"),
        F.when(~unread & (c("n_engines") < 2), "single_engine"), F.when(c("_x"), "verify_budget_exhausted")))
    reasons = F.when(c("quality_blocking"), F.array(F.lit("image_quality"))).otherwise(found)
    clean = F.size("reasons") == 0
    status = (F.when(c("quality_blocking"), "needs_review").when(unread, "failed")
              .when(clean & c("auto_approve") & (c("classification") != "student_submission"), "approved").otherwise("needs_review"))
    return joined.withColumn("reasons", reasons).withColumn("auto_clean", clean).withColumn("status", status).select(
        *PAGE, "classification", "status", "auto_clean", "reasons")


def page_text(regions: DataFrame, order: str = "region_id") -> DataFrame:
    """Regions of a page joined by newline in reading order."""
    ordered = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda s: s[col]), "\n")
    return regions.groupBy(*PAGE).agg(ordered("selected_text").alias("text"), ordered("consensus_text").alias("consensus_text"))


def withhold_text(rows: DataFrame, status: str = "status", text: str = "text") -> DataFrame:
    """Full text only once approved; the consensus text stays visible."""
    return rows.withColumn(text, F.when(F.col(status) == "approved", F.col(text)))


# --- documents -----------------------------------------------------------------------

def document_status(statuses: DataFrame) -> DataFrame:
    s = F.col("status")
    return statuses.groupBy("job_id").agg(
        F.when(F.every(s == "failed"), "failed").when(F.some(s == "needs_review"), "needs_review")
        .when(F.every(s == "approved"), "approved").otherwise("needs_review").alias("status"), F.count("*").alias("pages"))


def critical_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("job_id").agg(F.count_if(F.col("critical")).alias("critical"), F.count_if(F.col("critical") & ~F.col("edited")).alias("unresolved_critical"))


def reader_summary(failures: DataFrame) -> DataFrame:
    """First failure reason per reader of a document."""
    return failures.groupBy("job_id", "engine").agg(F.min_by("reason", "pos").alias("first_reason"), F.count("*").alias("failures"))


def reading_from_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Word-level output of a reader → its text and confidence; blanks and negatives drop out.

    ``keys`` name one region reading, so the words gathered are those of a region.
    """
    kept = words.filter((F.trim("word") != "") & (F.col("conf") >= 0))
    per = kept.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("word").alias("w")))), lambda s: s["w"]), " ").alias("text"),
        F.avg(F.col("conf") / 100.0).alias("confidence"), F.count("*").alias("tokens"))
    return words.select(*keys).distinct().join(per, keys, "left").withColumns(
        {"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "tokens": F.coalesce("tokens", F.lit(0))})


def confidence_from_logprobs(scores: DataFrame, keys: list[str]) -> DataFrame:
    finite = ~F.col("logprob").isin(float("inf"), float("-inf")) & ~F.isnan("logprob")
    return scores.groupBy(*keys).agg(F.coalesce(F.avg(F.when(finite, F.exp("logprob"))), F.lit(0.0)).alias("confidence"))
