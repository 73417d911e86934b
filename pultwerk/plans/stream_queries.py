"""Streams run over the tables' files until nothing is left, next to their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.functions import privacy as px
from pultwerk.operators import review
from pultwerk.plans.privacy_queries import findings_sql
from pultwerk.plans.record_queries import _ALIAS, _MAP, _STU
from pultwerk.plans.registry import query
from pultwerk.plans.retrieval_queries import _INGEST
from pultwerk.plans.review_queries import _STATES, _candidates, _critical
from pultwerk.plans.usage_queries import _EV, r6
from pultwerk.session import shared_dir
from pultwerk.sources import folders, usage_files
from pultwerk.sources.tables import VIEWS, table, view, view_sql
from pultwerk.streaming import jobs


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a stream over the table's files: one file or a folder of them."""
    base, columns = VIEWS[name]
    # a pattern, because a stream takes a plain path for a folder
    source = spark.readStream.schema(table(spark, sf_dir, base).schema).parquet(f"{sf_dir.rstrip('/')}/{base}.parque[t]")
    return source.selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])


def in_batches(spark: SparkSession, sf_dir: str, name: str, order: str, late: str = "false", batches: int = 3) -> DataFrame:
    """The same, its rows written as one arrival after the other and read one a batch.

    Arrivals follow ``order``; rows for which ``late`` holds come with the last one. All have
    as many files, so that a batch is a whole arrival however many files the table has.
    """
    rows = table(spark, sf_dir, VIEWS[name][0]).withColumn("_o", F.col(order).cast("timestamp").cast("double") if order == "ts" else F.col(order).cast("double"))
    borders = rows.approxQuantile("_o", [i / batches for i in range(1, batches)], 0.001)
    arrival = F.when(F.expr(late), batches - 1).otherwise(sum((F.col("_o") > b).cast("int") for b in borders))
    dealt, folder = rows.withColumn("_a", arrival), _folder(spark)
    files = max(dealt.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    for i in range(batches):
        arrived, here = dealt.filter(F.col("_a") == i).drop("_o", "_a").repartition(files), f"{folder}/arrivals/{i}"
        arrived.write.parquet(here)
        # a part without rows has no file
        for _ in range(files - sum(n.endswith(".parquet") for n in folders.names(spark, here))):
            spark.createDataFrame([], arrived.schema).coalesce(1).write.mode("append").parquet(here)
    source = spark.readStream.schema(rows.drop("_o").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{folder}/arrivals")
    return source.selectExpr(*[f"{expr} AS {col}" for col, expr in VIEWS[name][1].items()])


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def to_table(df: DataFrame) -> DataFrame:
    """Append sink: the stream's rows as written files."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    jobs.run_to_end(df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out")


def by_batch(df: DataFrame, writer, mode: str = "append") -> str:
    folder = _folder(df.sparkSession)
    jobs.run_to_end(df.writeStream.outputMode(mode).foreachBatch(writer(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return f"{folder}/out"


_DAYMODEL = f"SELECT day, model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {r6('sum(cost)')} AS cost_usd, count(*) AS requests FROM priced GROUP BY day, model"


@query("st_01_usage_rollups", _EV + _DAYMODEL)
def _(spark, sf):
    """Update mode: the last row written per key is its current value."""
    def writer(path):
        return lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/b={i}")

    out = spark.read.parquet(by_batch(jobs.usage_by_day_model(in_batches(spark, sf, "usage_events", "ts")), writer, "update"))
    last = F.max_by(F.struct("total_tokens", "cost", "requests"), "batch").alias("v")
    return out.groupBy("day", "model").agg(last).select("day", "model", "v.total_tokens", F.round("v.cost", 6).cast("double").alias("cost_usd"), "v.requests")


@query("st_01_usage_files", _EV + _DAYMODEL)
def _(spark, sf):
    """Usage files as the tracker writes them, read as a stream in three arrivals."""
    folder, events = _folder(spark), view(spark, sf, "usage_events")
    for i in range(3):
        mine = events.filter(F.pmod("request_id", F.lit(3)) == i)
        mine.select(F.col("request_id").cast("string").alias("request_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
                    "user_id", "model", "provider", "input_tokens", "output_tokens", "skill_name").write.json(f"{folder}/arrivals/{i}")
    return jobs.from_partials(spark, by_batch(usage_files.stream_events(spark, f"{folder}/arrivals", 1), jobs.write_partials))


@query("st_02_late_events", _EV + _DAYMODEL)
def _(spark, sf):
    return jobs.from_partials(spark, by_batch(in_batches(spark, sf, "usage_events", "ts", late="event_id % 50 = 7"), jobs.write_partials))


@query("st_03_review_machine", _STATES + " SELECT job_id, status FROM states")
def _(spark, sf):
    """Status after each job's last event."""
    texts = _candidates(spark, sf).select("job_id", "region_id", "engine", F.lit(True).alias("known"))
    critical = _critical(spark, sf).groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("region_id")), ",").alias("critical_regions"))
    # both grow with the jobs but look small to the planner
    events = in_batches(spark, sf, "review_events", "ts").join(texts.hint("merge"), ["job_id", "region_id", "engine"], "left").join(critical.hint("merge"), "job_id", "left")
    problem = F.when(F.col("kind") == "edit", review.edit_problem(F.coalesce("known", F.lit(False))))
    done = jobs.review_outcomes(spark, by_batch(events.withColumn("problem", problem), jobs.write_review_outcomes))
    return done.groupBy("job_id").agg(F.max_by("status", "event_id").alias("status")).filter("status is not null")


@query("st_04_budget_alerts", _EV + f""", run AS (SELECT month, request_id, cost, sum(cost) OVER (PARTITION BY month ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS mtd FROM priced)
 SELECT month, CAST(request_id AS VARCHAR) AS request_id, {r6('mtd')} AS month_to_date_usd, CASE WHEN mtd >= 90 THEN 'budget_90' WHEN mtd >= 75 THEN 'budget_75' END AS budget_alert, cost > 50 AS request_alert FROM run""")
def _(spark, sf):
    folder = by_batch(in_batches(spark, sf, "usage_events", "ts"), jobs.write_budget_alerts)
    return spark.read.parquet(f"{folder}/alerts").drop("batch").withColumn("request_id", F.col("request_id").cast("string"))


@query("st_05_sticky_privacy", f"""WITH {view_sql('requests')}, f AS (SELECT conv_id, turn, len({findings_sql('text')}) > 0 AS is_local FROM requests)
 SELECT conv_id, turn, CASE WHEN bool_or(is_local) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) THEN 'local_required' ELSE 'auto' END AS sticky_mode FROM f""")
def _(spark, sf):
    turns = in_batches(spark, sf, "requests", "turn").withColumn("is_local", F.size(px.findings(F.col("text"))) > 0)
    return spark.read.parquet(f"{by_batch(turns, jobs.write_sticky_privacy)}/modes").drop("batch")


@query("st_06_alias_map", _STU + f", {_MAP} SELECT real, {_ALIAS.format(i='idx')} AS alias FROM amap")
def _(spark, sf):
    names = in_batches(spark, sf, "students", "c_custkey").select(F.col("family_name").alias("name"), F.col("student_id").alias("seen"))
    return jobs.alias_store(by_batch(names, jobs.grow_alias_map)).read(spark).select("real", "alias")


@query("st_07_chunk_stream", _INGEST + "SELECT chunk_id, document_id, chunk_no, chunk, source, classification FROM ingested")
def _(spark, sf):
    return to_table(jobs.chunk_stream(stream(spark, sf, "docs")))
