"""Result documents: one JSON per job, pages and regions nested inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DISAGREEMENT = "start:int,end:int,variants:array<string>,critical:boolean,reason:string,charStart:int,charEnd:int"
CANDIDATE = "engine:string,text:string,rawText:string,confidence:double,tokens:array<string>,tokenConfidences:array<double>,durationMs:bigint,markers:array<string>"
REGION = (f"id:string,type:string,bbox:array<int>,candidates:array<struct<{CANDIDATE}>>,referenceEngine:string,consensusText:string,selectedText:string,"
          f"disagreements:array<struct<{DISAGREEMENT}>>,agreement:double,status:string,editedByTeacher:boolean,verifyFailed:boolean")
PAGE = f"index:int,width:int,height:int,regions:array<struct<{REGION}>>,status:string,autoClean:boolean,statusReasons:array<string>"
DOCUMENT = (f"struct<jobId:string,sourceName:string,classification:string,createdAt:double,status:string,approvedAt:double,error:string,errorCode:string,"
            f"scanCleanupStatus:string,pages:array<struct<{PAGE}>>,_corrupt:string>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.text(path, wholetext=True))


def document_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files below a path that ``read_documents`` leaves out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    known = files.select("path", parsed.alias("d"), F.try_parse_json("value").isNull().alias("_broken"))
    reason = (F.when(F.col("_broken"), "not_json").when(F.col("d._corrupt").isNotNull(), "wrong_type")
              .when(F.col("d.jobId").isNull(), "no_job_id").when(F.col("d.pages").isNull(), "no_pages"))
    return known.select("path", reason.alias("reason")).filter("reason is not null")


def parse_documents(json_rows: DataFrame) -> DataFrame:
    """Documents that do not parse as a whole or lack a required field are left out.

    One field of the wrong type makes a document unreadable; defaults fill old files.
    """
    parsed = F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    whole = json_rows.select(parsed.alias("d")).filter("d._corrupt is null and d.jobId is not null and d.pages is not null")
    d = whole.select("d.*").drop("_corrupt")
    return d.withColumn("scanCleanupStatus", F.coalesce("scanCleanupStatus", F.lit("retained")))


def region_rows(documents: DataFrame) -> DataFrame:
    pages = documents.select("jobId", F.explode_outer("pages").alias("p"))
    return pages.select("jobId", F.col("p.index").alias("page"), F.posexplode_outer("p.regions").alias("pos", "r")).select(
        "jobId", "page", "pos", F.col("r.id").alias("region_id"), F.col("r.referenceEngine").alias("reference_engine"), F.col("r.selectedText").alias("selected_text"),
        F.col("r.agreement").alias("agreement"), F.coalesce("r.editedByTeacher", F.lit(False)).alias("edited"), F.coalesce("r.verifyFailed", F.lit(False)).alias("verify_failed"),
        F.col("r.candidates").alias("candidates"), F.col("r.disagreements").alias("disagreements"))


def candidate_rows(regions: DataFrame) -> DataFrame:
    return regions.select("jobId", "page", "region_id", F.explode_outer("candidates").alias("c")).select(
        "jobId", "page", "region_id", "c.engine", "c.text", "c.confidence", F.coalesce("c.durationMs", F.lit(0)).alias("duration_ms"))


def disagreement_rows(regions: DataFrame) -> DataFrame:
    return regions.select("jobId", "page", "region_id", F.explode_outer("disagreements").alias("d")).select(
        "jobId", "page", "region_id", "d.start", "d.end", "d.critical", "d.reason",
        F.coalesce("d.charStart", F.lit(-1)).alias("char_start"), F.coalesce("d.charEnd", F.lit(-1)).alias("char_end"))
