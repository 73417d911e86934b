"""Machine readings derived from the documents table: whole texts, cut into regions.

Every document is a job. Its words lie in regions of forty, ten regions to a page, so a
region stays small however long the document is and no word is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.functions.text import words
from pultwerk.sources.tables import texts

WORDS_PER_REGION = 40
REGIONS_PER_PAGE = 10


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / WORDS_PER_REGION), F.lit(0)).cast("int"))
    cut = docs.select("job_id", F.posexplode(F.transform(starts, lambda i: F.slice("w", i * WORDS_PER_REGION + 1, WORDS_PER_REGION))).alias("region_id", "w"))
    return cut.withColumn("page", F.floor(F.col("region_id") / REGIONS_PER_PAGE).cast("int"))


def _conf(divisor: int, scale: int):
    return F.lit(0.5) + (F.col("job_id") % divisor) / F.lit(float(scale))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers: one exact, one that misreads digits and loses every 17th word.

    Some regions have no reading at all, some pages only one reader.
    """
    misread = F.filter(F.transform("w", lambda x: F.regexp_replace(x, "[37]", "8")), lambda x, j: (j + 1) % 17 != 0)
    both = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("htr").alias("engine"), F.array_join("w", " ").alias("text"), _conf(50, 100).alias("confidence")),
        F.when((F.col("job_id") + F.col("page")) % 7 != 0, F.struct(
            F.lit(1).alias("pos"), F.lit("tesseract").alias("engine"), F.array_join(misread, " ").alias("text"), _conf(37, 80).alias("confidence"))))
    rows = regions(spark, sf_dir).filter((F.col("job_id") + F.col("region_id")) % 29 != 0)
    return rows.select("job_id", "page", "region_id", F.explode(F.array_compact(both)).alias("r")).select("job_id", "page", "region_id", "r.*")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third reader for doubtful regions; it fails on every eleventh job."""
    text = F.regexp_replace(F.array_join("w", " "), "nicht", "")
    return regions(spark, sf_dir).filter((F.col("job_id") % 11 != 0) & ((F.col("job_id") + F.col("region_id")) % 29 != 0)).select(
        "job_id", "page", "region_id", F.lit(2).alias("pos"), F.lit("ollama_vlm").alias("engine"), text.alias("text"), F.lit(0.8).alias("confidence"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).filter((F.col("job_id") + F.col("page")) % 7 == 0)
    return rows.select("job_id", "page", "region_id", F.lit("tesseract").alias("engine"), F.lit("timeout").alias("reason"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).filter(F.col("region_id") % REGIONS_PER_PAGE == 0)
    kind = F.expr("CASE job_id % 4 WHEN 0 THEN 'public_curriculum' WHEN 1 THEN 'personal' WHEN 2 THEN 'unknown' ELSE 'student_submission' END")
    return rows.select("job_id", "page", kind.alias("classification"), (F.col("job_id") % 2 == 0).alias("auto_approve"),
                       ((F.col("job_id") + F.col("page")) % 13 == 0).alias("quality_blocking"))


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three readers over tokens that are unique within their region.

    So there is only one alignment, and every disagreement follows from the token's place:
    places 5, 18 and 31 are lost by the second reader, 9 loses its comma, 12 is a lost
    "nicht", 22 is misread by the second and third reader, and the second one puts a word
    in behind place 27.
    """
    plain = lambda w, j: F.concat(F.lit("q"), F.lower(F.regexp_replace(w, "[^A-Za-z]", "")), F.lit("x"), F.chr(97 + F.floor(j / 6)), F.chr(97 + j % 6))
    token = lambda w, j: F.when(j == 9, "3,5").when(j == 12, "nicht").otherwise(plain(w, j))
    lost = lambda j: j.isin(5, 12, 18, 31)
    misread = lambda t, j: F.when(j == 9, "35").when(j == 22, F.concat(F.lit("z"), t)).when(j == 27, F.concat(t, F.lit(" einschub"))).otherwise(t)
    rows = regions(spark, sf_dir).filter((F.col("job_id") + F.col("region_id")) % 29 != 0).withColumn("t", F.transform("w", token))
    second_reader = F.array_join(F.filter(F.transform("t", lambda t, j: F.when(~lost(j), misread(t, j))), lambda t: t.isNotNull()), " ")
    third_reader = F.array_join(F.transform("t", lambda t, j: F.when(j == 22, F.concat(F.lit("y"), t)).otherwise(t)), " ")
    reader = lambda pos, engine, text: F.struct(F.lit(pos).alias("pos"), F.lit(engine).alias("engine"), text.alias("text"), F.lit(0.9).alias("confidence"))
    all_readers = F.array_compact(F.array(
        reader(0, "htr", F.array_join("t", " ")),
        F.when((F.col("job_id") + F.col("page")) % 7 != 0, reader(1, "tesseract", second_reader)),
        F.when((F.col("job_id") + F.col("region_id")) % 3 == 0, reader(2, "ollama_vlm", third_reader))))
    return rows.select("job_id", "page", "region_id", F.explode(all_readers).alias("r")).select("job_id", "page", "region_id", "r.*")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of ``distinct`` as raw output with markup.

    The first reader struck a word out before the text and is unsure at place 15, the second
    one at place 34; both give a second reading there.
    """
    unsure = lambda t, letter: F.concat(F.lit("<uncertain>"), t, F.lit(f"|{letter}"), t, F.lit("</uncertain>"))
    place = lambda j: "x" + chr(97 + j // 6) + chr(97 + j % 6)
    tokens = F.transform(F.split("text", " "), lambda t: F.when((F.col("engine") == "htr") & t.endswith(place(15)), unsure(t, "w")).when(
        (F.col("engine") == "tesseract") & t.endswith(place(34)), unsure(t, "v")).otherwise(t))
    struck = F.when(F.col("engine") == "htr", "<deleted>weg</deleted> ").otherwise("")
    return distinct(spark, sf_dir).withColumn("raw_text", F.concat(struck, F.array_join(tokens, " "))).drop("text")
