"""Review state from events: edits, approval, deletion, retention, versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pultwerk.operators import ordered
from pultwerk.session import cut_lineage

# name of a job folder; anything else is left alone
JOB_FOLDER = r"\A[A-Za-z0-9_-]{1,64}\z"


def _at() -> Column:
    return F.struct("ts", "event_id")


def edit_problem(known_reader: Column) -> Column:
    """Why an edit is refused: nothing to set, or a reader the region does not have.

    An empty text is an edit: it clears the region.
    """
    chosen = F.col("engine").isNotNull()
    return F.when(~chosen & F.col("text").isNull(), "empty_patch").when(chosen & ~known_reader, "unknown_reader")


def classify_edits(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edit events with the text they set and, for refused ones, the reason.

    A chosen reader's text is taken over unless the edit brings its own text. Both sides are
    large, but what a table of keys is exploded into looks small to the planner.
    """
    edits = events.filter("kind = 'edit'")
    texts = candidates.select("job_id", "region_id", "engine", F.col("text").alias("reader_text"))
    joined = edits.join(texts.hint("merge"), ["job_id", "region_id", "engine"], "left")
    return joined.withColumn("problem", edit_problem(F.col("reader_text").isNotNull())).withColumn("new_text", F.coalesce("text", "reader_text"))


def latest_edits(classified: DataFrame) -> DataFrame:
    """Last accepted edit per region; a combined maximum, no window."""
    return classified.filter("problem is null").groupBy("job_id", "region_id").agg(
        F.max_by("new_text", _at()).alias("selected_text"), F.count("*").alias("edits")).withColumn("edited", F.lit(True))


def rejected_edits(classified: DataFrame) -> DataFrame:
    return classified.filter("problem is not null").select("job_id", "region_id", "event_id", "problem")


def job_states(events: DataFrame, critical_regions: DataFrame, accepted_edits: DataFrame) -> DataFrame:
    """Final state of every created job.

    A completed job takes the status its document came out with (``completed_as``:
    needs_review, approved without a teacher's act, or failed), needs_review where the
    events have none; a failed one keeps its ``error_code``. An automatic approval has no
    date and ends with the first accepted edit.

    The state machine is worked out from a few minima and maxima per job instead of a walk
    through its events, so a job with very many events is combined before the shuffle:
    created, then deleted or read (completed or failed), then the first edit of every
    critical region, and an approval that comes after all of those and after the last edit.
    """
    at = _at()
    for name in ("completed_as", "error_code"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    came_out = F.coalesce("completed_as", F.lit("needs_review"))
    outcome = F.when((F.col("kind") == "complete") & (came_out == "failed"), "fail").otherwise(F.col("kind"))
    born = events.groupBy("job_id").agg(F.min(F.when(F.col("kind") == "create", at)).alias("born")).filter("born is not null")
    # a row per job: too many to be broadcast, however small the planner takes them to be
    alive = events.join(born.hint("merge"), "job_id").filter(at > F.col("born"))
    ends = alive.groupBy("job_id").agg(
        F.min(F.when(F.col("kind") == "delete", at)).alias("died"),
        F.min(F.when(F.col("kind").isin("complete", "fail"), F.struct(at.alias("at"), outcome.alias("kind"), came_out.alias("came_out"), F.when(F.col("kind") == "fail", F.col("error_code")).alias("code")))).alias("read"))
    # read by every step below: written once, so that the plan stays small and events are not read for each
    jobs = cut_lineage(born.join(ends.hint("merge"), "job_id", "left").withColumn("read", F.when(F.col("died").isNull() | (F.col("read.at") < F.col("died")), F.col("read"))))
    open_jobs = jobs.filter("read.kind = 'complete'").select("job_id", F.col("read.at").alias("read_at"), "died")
    during = lambda df: df.join(open_jobs.hint("merge"), "job_id").filter((at > F.col("read_at")) & (F.col("died").isNull() | (at < F.col("died"))))
    per_region = cut_lineage(during(accepted_edits.select("job_id", "region_id", "ts", "event_id")).groupBy("job_id", "region_id").agg(
        F.min(at).alias("first"), F.max(at).alias("last")))
    edited = per_region.groupBy("job_id").agg(F.max("last").alias("last_edit"), F.count("*").alias("edited_regions"))
    critical = critical_regions.select("job_id", "region_id").distinct().join(per_region, ["job_id", "region_id"], "left").groupBy("job_id").agg(
        F.count_if(F.col("first").isNull()).alias("unresolved"), F.max("first").alias("resolved_at"))
    ready = open_jobs.join(edited, "job_id", "left").join(critical, "job_id", "left").select(
        "job_id", "read_at", "died", F.coalesce("edited_regions", F.lit(0)).alias("edited_regions"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
        F.greatest("read_at", "last_edit", "resolved_at").alias("ready_at"))
    approvals = during(events.filter("kind = 'approve'").select("job_id", "ts", "event_id")).join(
        ready.filter("unresolved = 0").select("job_id", "ready_at"), "job_id").filter(at > F.col("ready_at")).groupBy("job_id").agg(F.min(at).alias("approved"))
    out = jobs.join(ready.select("job_id", "edited_regions", "unresolved"), "job_id", "left").join(approvals, "job_id", "left")
    untouched = (F.col("read.came_out") == "approved") & (F.coalesce("edited_regions", F.lit(0)) == 0)
    status = (F.when(F.col("died").isNotNull(), "deleted").when(F.col("read").isNull(), "processing").when(F.col("read.kind") == "fail", "failed")
              .when(F.col("approved").isNotNull() | untouched, "approved").otherwise("needs_review"))
    gone = F.col("died").isNotNull()
    return out.select(
        "job_id", status.alias("status"), F.when(~gone & (F.col("read.kind") == "fail"), F.col("read.code")).alias("error_code"),
        F.col("born.ts").alias("created_at"), F.when(~gone & ~F.coalesce(untouched, F.lit(False)), F.col("approved.ts")).alias("approved_at"),
        F.coalesce("edited_regions", F.lit(0)).alias("edited_regions"), F.coalesce("unresolved", F.lit(0)).alias("unresolved_critical"))


def newest_jobs(jobs: DataFrame) -> DataFrame:
    """Job list without any text, newest first."""
    return jobs.select("job_id", "status", "created_at", "unresolved_critical").orderBy(F.desc("created_at"), "job_id")


def without_deleted(results: DataFrame, tombstones: DataFrame) -> DataFrame:
    return results.join(tombstones.select("job_id"), "job_id", "left_anti")


def expired_jobs(jobs: DataFrame, now: str, days: int) -> DataFrame:
    return jobs.filter(F.col("created_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def orphans(inventory: DataFrame, jobs: DataFrame, now: str, days: int) -> DataFrame:
    """Well-named folders without a job, older than the cutoff by their own time or mtime."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    named = inventory.filter(F.col("folder").rlike(JOB_FOLDER))
    return named.join(jobs.select("folder"), "folder", "left_anti").filter(F.coalesce("created_at", "modified_at") < cutoff)


def prior_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """The newest versions before the current one. The rank is capped before the shuffle."""
    newest = W.partitionBy("path").orderBy(F.desc("version_ts"))
    ranked = versions.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= keep + 1)
    return ranked.filter("rn > 1").withColumn("version", F.col("rn") - 1).drop("rn")


def _part_steps(rows: DataFrame) -> DataFrame:
    """(part, state_id, r, s): what a part makes of the revision r that it is entered with.

    A row is the step "r becomes r + 1 if the row expects r". A part is the composition of
    its steps, worked out from its last row to its first; revisions that none of its rows
    expects pass through and are not listed. A task holds the table of one part.
    """
    def run(batches):
        held, steps = None, {}

        def out():
            part, state = held
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(steps), pa.int32()), pa.array([state] * len(steps), pa.int64()), pa.array(list(steps), pa.int64()), pa.array(list(steps.values()), pa.int64()),
            ], names=["part", "state_id", "r", "s"])

        for batch in batches:
            for part, state, expected in zip(*[batch.column(c).to_pylist() for c in (ordered.PART, "state_id", "expected")]):
                if (part, state) != held:
                    if steps:
                        yield from out()
                    held, steps = (part, state), {}
                if expected is not None:
                    steps[expected] = steps.get(expected + 1, expected + 1)
        if steps:
            yield from out()

    latest = [F.desc_nulls_last("ts"), F.desc_nulls_last("event_id")]
    dealt = rows.repartition(ordered.PART).sortWithinPartitions(ordered.PART, "state_id", *latest)
    return dealt.select(ordered.PART, "state_id", "expected").mapInArrow(run, "part int, state_id long, r long, s long")


def _composed(steps: DataFrame) -> DataFrame:
    """Two neighbouring parts become one: the left table, continued by the right one."""
    left, right = (steps.filter(F.col("part") % 2 == side).withColumn("part", F.floor(F.col("part") / 2).cast("int")) for side in (0, 1))
    keys = ["part", "state_id"]
    onward = right.select(*keys, F.col("r").alias("s"), F.col("s").alias("_on"))
    through = left.join(onward, [*keys, "s"], "left").select(*keys, "r", F.coalesce("_on", "s").alias("s"))
    return through.unionByName(right.join(left.select(*keys, "r"), [*keys, "r"], "left_anti"))


def _entered(spans: DataFrame, steps: DataFrame, parts: int) -> DataFrame:
    """(part, state_id, revision): the revision at the start of every listed part.

    Tables are composed two by two up to one for all parts, then the starting revision is
    handed down: to a left half as it is, to a right half through the left one's table.
    """
    levels = [steps]
    for _ in range((parts - 1).bit_length()):
        levels.append(cut_lineage(_composed(levels[-1])))
    at = spans.select("state_id").distinct().select(F.lit(0).alias("part"), "state_id", F.lit(0).cast("long").alias("revision"))
    for width, below in reversed(list(enumerate(levels[:-1]))):
        lefts = at.select((F.col("part") * 2).alias("part"), "state_id", "revision")
        known = below.select("part", "state_id", F.col("r").alias("revision"), F.col("s").alias("_on"))
        rights = lefts.join(known, ["part", "state_id", "revision"], "left").select(
            (F.col("part") + 1).alias("part"), "state_id", F.coalesce("_on", "revision").alias("revision"))
        # only what leads to a listed part: at most as many rows as there are
        needed = spans.select(F.shiftright("part", width).alias("part"), "state_id").distinct()
        at = cut_lineage(lefts.unionByName(rights).join(F.broadcast(needed), ["part", "state_id"], "left_semi"))
    return at


def check_revisions(attempts: DataFrame) -> DataFrame:
    """attempts(state_id, ts, event_id, expected) → accepted flag and the revision after it.

    A write counts only if it expects the current revision, so each answer depends on the
    ones before. Rows are cut into ranges of (state, time). A state inside one range is
    walked there; for one that spans ranges, each range is first summed up as a table of
    steps, the tables are composed in pairs, and every range then starts from the revision
    that the ones before it lead to. So a state with most of the rows is spread over all
    tasks. An attempt without an expectation, or on no state, is refused.
    """
    order = ["ts", "event_id"]
    rows = attempts.select(F.col("state_id").cast("long").alias("state_id"), *order, F.col("expected").cast("long").alias("expected"))
    split = ordered.range_split(rows.filter("state_id is not null"), ["state_id"], order)
    lost = rows.filter("state_id is null").select("state_id", F.col("event_id").cast("long").alias("event_id"), "expected", F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("revision"))
    # a part shares at most its first and its last state with other parts
    seen = split.groupBy(F.col(ordered.PART).alias("part"), "state_id").agg(F.lit(1).alias("_one"))
    several = seen.groupBy("state_id").agg(F.count("*").alias("n"), F.max("part").alias("last")).filter("n > 1").select("state_id", "last")
    spans = cut_lineage(seen.join(several, "state_id").select("part", "state_id"))
    last = spans.agg(F.max("part")).first()[0]
    if last is None:
        return _walked(split.withColumn("_start", F.lit(0).cast("long"))).unionByName(lost)
    # at most two rows per part
    some = F.broadcast(spans.withColumnsRenamed({"part": ordered.PART}))
    steps = cut_lineage(_part_steps(split.join(some, [ordered.PART, "state_id"], "left_semi")))
    starts = F.broadcast(_entered(spans, steps, last + 1).select(F.col("part").alias(ordered.PART), "state_id", F.col("revision").alias("_start")))
    return _walked(split.join(starts, [ordered.PART, "state_id"], "left").withColumn("_start", F.coalesce("_start", F.lit(0).cast("long")))).unionByName(lost)


def _walked(rows: DataFrame) -> DataFrame:
    """Sorted rows stream through; a task keeps one number of the state in work."""
    schema = "state_id long, event_id long, expected long, accepted boolean, revision long"

    def walk(batches):
        held, revision = None, 0
        for batch in batches:
            accepted, after = [], []
            for part, state, expected, start in zip(*[batch.column(c).to_pylist() for c in (ordered.PART, "state_id", "expected", "_start")]):
                if (part, state) != held:
                    held, revision = (part, state), start
                hit = expected == revision
                revision += hit
                accepted.append(hit)
                after.append(revision)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("state_id", "event_id", "expected")], pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], names=["state_id", "event_id", "expected", "accepted", "revision"])

    keyed = rows.select("state_id", "ts", F.col("event_id").cast("long").alias("event_id"), "expected", "_start", ordered.PART)
    return keyed.repartition(ordered.PART).sortWithinPartitions(ordered.PART, "state_id", "ts", "event_id").mapInArrow(walk, schema)
