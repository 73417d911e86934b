"""Structured Streaming twins of the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pultwerk.operators import pseudonym, retrieval, usage
from pultwerk.session import cut_lineage
from pultwerk.streaming.keyed_state import KeyedState


def as_event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Event time must be a timestamp with zone; the session runs in UTC."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


# --- usage -----------------------------------------------------------------------------

def usage_by_day_model(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Running sums per day and requested model. The watermark bounds the state."""
    priced = as_event_time(usage.with_cost(stream)).withWatermark("ts", delay)
    return priced.groupBy(F.window("ts", "1 day").alias("w"), "model").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("cost"), F.count("*").alias("requests")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "model", "total_tokens", "cost", "requests")


def write_partials(path: str):
    """foreachBatch writer of per-batch sums: any event counts on its own day, however late.

    A batch that runs again overwrites its own folder, so nothing is counted twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sums = usage.period_keys(usage.with_cost(batch)).groupBy("day", "model").agg(
            F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("cost"), F.count("*").alias("requests"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def from_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("day", "model").agg(
        F.sum("total_tokens").alias("total_tokens"), usage.usd(F.sum("cost")).alias("cost_usd"), F.sum("requests").alias("requests"))


def write_budget_alerts(path: str):
    """foreachBatch writer of month-to-date alerts.

    A month may hold most of a batch, so each batch is the parallel batch job; between
    batches one sum per month is carried. Every batch writes the sums of all months beside
    its alerts and reads only those of the batch before, so history is never read again
    and a repeated batch gives the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/spent/batch={batch_id - 1}"
        schema = "month string, spent decimal(38,8)"
        spent = spark.read.schema(schema).parquet(before) if batch_id else spark.createDataFrame([], schema)
        priced = usage.with_cost(batch)
        usage.budget_alerts(priced, spent=spent).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        new = usage.period_keys(priced).groupBy("month").agg(F.sum("cost").alias("spent"))
        both = spent.unionByName(new).groupBy("month").agg(F.sum("spent").cast("decimal(38,8)").alias("spent"))
        both.coalesce(1).write.mode("overwrite").parquet(f"{path}/spent/batch={batch_id}")

    return write


# --- chats -------------------------------------------------------------------------------

def write_sticky_privacy(path: str):
    """foreachBatch writer: turns(conv_id, turn, is_local) → mode per turn below ``path``/modes.

    State is the first local turn of a chat. A batch is a minimum per chat and a join, so a
    chat with most of the turns is combined before the shuffle and no task holds it; only the
    buckets of the batch's own chats are read and written.
    """
    state = KeyedState(f"{path}/chats", "conv_id", "conv_id long, first long")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # several steps read the turns; what makes them local is worked out once
        batch = batch.select("conv_id", "turn", "is_local").persist()
        local = batch.filter("is_local").groupBy("conv_id").agg(F.min("turn").alias("first"))
        touched = state.touched(batch)
        before = state.read(spark, touched, batch_id)
        first = before.unionByName(local).groupBy("conv_id").agg(F.min("first").alias("first"))
        sticky = F.coalesce(F.col("turn") >= F.col("first"), F.lit(False))
        modes = batch.select("conv_id", "turn").join(first, "conv_id", "left").select("conv_id", "turn", F.when(sticky, "local_required").otherwise("auto").alias("sticky_mode"))
        modes.write.mode("overwrite").parquet(f"{path}/modes/batch={batch_id}")
        changed = state.touched(local)
        state.write(first.filter(state.bucket().isin(changed)), changed, batch_id)
        batch.unpersist()

    return write


# --- review ------------------------------------------------------------------------------

def review_step(status: str | None, edited: set[int], row) -> tuple[str | None, str]:
    """One event of a job: created, read, edited, approved, reopened, deleted.

    ``edited`` holds the regions edited so far and grows. Rows carry the job's critical
    regions and, for edits, the reason a refused edit was refused for.
    """
    kind = row.kind
    if status is None:
        return ("processing", "created") if kind == "create" else (None, "not_found")
    if status == "deleted":
        return status, "not_found"
    if kind == "delete":
        return "deleted", "deleted"
    if kind in ("complete", "fail"):
        if status != "processing":
            return status, "ignored"
        came_out = (row.completed_as or "needs_review") if kind == "complete" else "failed"
        return came_out, "failed" if came_out == "failed" else "completed"
    if kind == "edit":
        if status not in ("needs_review", "approved"):
            return status, "not_ready"
        if row.problem:
            return status, row.problem
        edited.add(int(row.region_id))
        return "needs_review", "edited"
    if kind == "approve":
        if status == "approved":
            return status, "unchanged"
        if status != "needs_review":
            return status, "not_ready"
        open_regions = {int(r) for r in str(row.critical_regions or "").split(",") if r} - edited
        return (status, "critical_uncertainty") if open_regions else ("approved", "approved")
    return status, "ignored"


_REVIEW = ["job_id", "ts", "event_id", "kind", "region_id", "problem", "critical_regions", "completed_as"]
_WALKED = "job_id long, event_id long, kind string, outcome string, status string, edited array<long>, row string"


def _review_walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted events and, behind each job's last one, a row with its new state.

    A task holds one batch and the state of one job, however many events the job has.
    """
    columns = ["job_id", "event_id", "kind", "outcome", "status", "edited", "row"]
    job, status, edited = None, None, set()
    end = lambda: (job, None, None, None, status, sorted(edited), "state")
    for batch in batches:
        out = []
        for row in batch.astype(object).where(batch.notna(), None).itertuples():
            if row.job_id != job:
                if status is not None:
                    out.append(end())
                job, status, edited = row.job_id, row.status, {int(r) for r in (() if row.edited is None else row.edited)}
            status, outcome = review_step(status, edited, row)
            out.append((job, row.event_id, row.kind, outcome, status, None, "outcome"))
        yield pd.DataFrame(out, columns=columns)
    if status is not None:
        yield pd.DataFrame([end()], columns=columns)


def write_review_outcomes(path: str):
    """foreachBatch writer: events → outcome per event below ``path``/walked.

    Spark sorts a batch by job and time, so events are taken in order, batch by batch of
    rows, and a job with very many events is streamed, never gathered. State per job is its
    status and the regions edited so far, in the buckets of the batch's own jobs.
    """
    state = KeyedState(f"{path}/jobs", "job_id", "job_id long, status string, edited array<long>")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, events = batch.sparkSession, batch.select(*_REVIEW).filter("job_id is not null")
        touched = state.touched(events)
        before = state.read(spark, touched, batch_id)
        # compressed lists of regions look smaller than they are
        ready = events.join(before.hint("merge"), "job_id", "left").repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id")
        folder = f"{path}/walked/batch={batch_id}"
        ready.mapInPandas(_review_walk, _WALKED).write.mode("overwrite").partitionBy("row").parquet(folder)
        walked = spark.read.schema(_WALKED).parquet(folder)
        new = walked.filter("row = 'state'").select("job_id", "status", "edited")
        state.write(before.join(new.hint("merge"), "job_id", "left_anti").unionByName(new), touched, batch_id)

    return write


def review_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, event_id, kind, outcome, status) of all batches so far."""
    walked = spark.read.schema(f"{_WALKED}, batch int").parquet(f"{path}/walked")
    return walked.filter("row = 'outcome'").select("job_id", "event_id", "kind", "outcome", "status")


# --- pseudonyms and documents ----------------------------------------------------------------

def alias_store(path: str) -> KeyedState:
    return KeyedState(path, "real", "real string, alias string, first_seen long, idx long")


def grow_alias_map(path: str):
    """foreachBatch writer: names not seen before get the next free aliases.

    The map lies in buckets by name; a batch reads those of its own names, and the next free
    index is handed on from batch to batch, so its time does not grow with their number. A
    repeated batch starts from what lay there before it and assigns the same aliases again.
    """
    store = alias_store(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, counter = batch.sparkSession, "next long"
        # batch numbers start at 0, so a later batch has one before it
        last = spark.read.schema(counter).parquet(f"{path}/_next/{batch_id - 1}").first()["next"] if batch_id else 0
        seen = pseudonym.first_seen(batch).withColumn("bucket", store.bucket())
        touched = store.touched(seen)
        known = store.read(spark, touched, batch_id)
        fresh = cut_lineage(seen.drop("bucket").join(known.select("real"), "real", "left_anti"))
        idx = F.col("place") + last
        numbered = pseudonym.in_order(fresh).select("real", pseudonym.alias_text(idx).alias("alias"), "first_seen", idx.cast("long").alias("idx"))
        store.write(known.unionByName(numbered), touched, batch_id)
        spark.createDataFrame([(last + fresh.count(),)], counter).coalesce(1).write.mode("overwrite").parquet(f"{path}/_next/{batch_id}")

    return write


def chunk_stream(stream: DataFrame) -> DataFrame:
    """Arriving documents as chunks; no state, so it scales with the number of files."""
    return retrieval.ingest(stream)


def run_to_end(query) -> None:
    """Runs what is there and stops, for scheduled and test runs."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
