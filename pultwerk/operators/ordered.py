"""Running totals, previous values and positions that survive a hot group.

A plain window sends a whole group to one task. Here rows are numbered by ranges of
(group, order), so a group may span many parts; each part is worked on alone and carries
over one small value. A part continues at most one group from the part before it, so the
carry-over table has at most one row per part, which is what makes broadcasting it safe
whatever the data size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


# rows that each task hands over for the borders; they place borders and nothing else
BORDER_ROWS = 128
_WEIGHT = "_stands_for"


def _sampled(keys: DataFrame) -> DataFrame:
    """Up to ``BORDER_ROWS`` random rows of each task, with the number of rows each stands for.

    One pass: a task keeps the rows with the smallest of its random numbers.
    """
    def run(batches):
        rng, kept, best, total = np.random.default_rng([11, TaskContext.get().partitionId()]), None, np.zeros(0), 0
        for batch in batches:
            drawn = rng.random(batch.num_rows)
            low = np.argsort(drawn, kind="stable")[:BORDER_ROWS]
            part = pa.Table.from_batches([batch]).take(pa.array(low))
            kept = part if kept is None else pa.concat_tables([kept, part])
            best, total = np.concatenate([best, drawn[low]]), total + batch.num_rows
            if len(best) > BORDER_ROWS:
                low = np.argsort(best, kind="stable")[:BORDER_ROWS]
                kept, best = kept.take(pa.array(low)), best[low]
        if total:
            yield from kept.append_column(_WEIGHT, pa.array(np.full(len(best), total / len(best)))).combine_chunks().to_batches()

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField(_WEIGHT, T.DoubleType())]))


def _borders(keys: DataFrame, n: int) -> list[tuple]:
    """Up to n - 1 key tuples that cut the rows into parts of about equal size."""
    rows = [(tuple((v is not None, v) for v in r[:-1]), r[-1]) for r in _sampled(keys).collect()]
    rows.sort(key=lambda r: tuple(x if x[0] else (False,) for x in r[0]))
    reached, total, cuts = 0.0, sum(w for _, w in rows), []
    for key, weight in rows:
        if reached >= total * (len(cuts) + 1) / n and len(cuts) < n - 1:
            cuts.append(key)
            while len(cuts) < n - 1 and reached >= total * (len(cuts) + 1) / n:
                cuts.append(key)
        reached += weight
    return [tuple(v for _, v in c) for c in dict.fromkeys(cuts)]


def range_split(df: DataFrame, group: list[str], order: list[str], like: DataFrame | None = None) -> DataFrame:
    """Rows with the number of their range of (group, order) as data.

    The rows are read once for the borders, or those of ``like``: a cheaper table with the
    same key columns and about the same keys, so that a costly ``df`` runs only once.

    The borders are constants of the plan, found once, so a row's number depends on the row
    alone: a lost executor computes the same one again, and nothing has to be written.
    ``order`` should end in a unique column so that ties can be split.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*group, *order)
    borders = _borders(keys if like is None else like.select(*keys.columns), n)
    if not borders:
        return df.withColumn(PART, F.lit(0))
    kinds = [f.dataType for f in keys.schema]
    table = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(row, kinds))]) for row in borders])
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys.columns)])
    # binary search for the number of borders below the key, which is put together once a row
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    below = F.get(F.transform(F.array(key), lambda own: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(borders)) & (F.get(table, at + step - 1) < own), at + step).otherwise(at))), F.lit(0))
    return df.withColumn(PART, below)


def _carry(per_part: DataFrame, group: list[str], carried: Column, name: str) -> DataFrame:
    """Value carried into each partition; at most one row per partition has one."""
    before = W.partitionBy(*group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return per_part.select(PART, *group, carried.over(before).alias(name)).filter(F.col(name).isNotNull())


def _attach(df: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    """Joins null-safely: rows without a group are a group too."""
    named = {c: f"_carry_{c}" for c in (PART, *group)}
    match = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    return df.join(F.broadcast(carry.withColumnsRenamed(named)), match, "left").drop(*named.values())


def running(split: DataFrame, group: list[str], order: list[str], value: Column, out: str,
            how: str = "sum", include_current: bool = True) -> DataFrame:
    """Running sum, max or min per group over a ``range_split`` frame."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    totals = split.groupBy(PART, *group).agg(agg(value).alias("_total"))
    carry = _carry(totals, group, agg("_total"), "_carried")
    frame = W.partitionBy(PART, *group).orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow if include_current else -1)
    joined = _attach(split.withColumn("_local", agg(value).over(frame)), carry, group)
    if how == "sum":
        kind = joined.schema["_local"].dataType
        if isinstance(kind, T.DecimalType):
            # adding two 38-digit decimals would cost a digit after the point; 37 + 37 fits
            kind = T.DecimalType(min(kind.precision, 37), kind.scale)
        local, carried = (F.coalesce(F.col(c), F.lit(0)).cast(kind) for c in ("_local", "_carried"))
        both = F.when(F.coalesce("_local", "_carried").isNotNull(), local + carried)
    else:
        both = F.greatest("_local", "_carried") if how == "max" else F.least("_local", "_carried")
    return joined.withColumn(out, both).drop("_local", "_carried")


def previous(split: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Value of the row before, also when that row lies in another partition."""
    last = split.groupBy(PART, *group).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carry = _carry(last, group, F.last("_last"), "_carried")
    rows = W.partitionBy(PART, *group).orderBy(*order)
    local = split.withColumn("_lagged", F.lag(F.struct(F.col(value).alias("v"))).over(rows))
    joined = _attach(local, carry, group)
    return joined.withColumn(out, F.coalesce("_lagged", "_carried")["v"]).drop("_lagged", "_carried")


def position(split: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """1, 2, 3 … within each group."""
    return running(split, group, order, F.lit(1).cast("long"), out)
