"""Nearest neighbours by vantage-point trees, one per shard of the table.

A shard is a run of at most ``SHARD`` rows that one scan task meets, so every row is
indexed, nothing is shuffled for it and no key can make a shard large. A tree is the order
of its shard's rows: the vantage point of a range comes first, then the nearer half of the
rest, then the farther one; the vantage point's row holds the radius between them.

A query goes to every shard. Half the way is saved in two rounds: the first sends it to
about the root of the number of shards, the k-th distance found there is its cutoff in all
others. A subtree is left out if the triangle inequality puts it beyond the cutoff times
``factor``: a factor of one is exact search, a smaller one prunes more and may lose some.
Distances are double-precision sums in the order of the components.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
do rows without an id. Vectors meet those of their own length only. Rows with the query's
id are its own; a repeated row is a candidate (and a query) of its own. Ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pultwerk.llm.common import stored

SHARD = 32768
# rows of a range that is not split further
LEAF = 128
# queries searched together
TOGETHER = 512
# a radius that marks no vantage point
NONE = -1.0
# place of a list that is not taken yet
NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each query to the point beside it, summed component by component."""
    gaps = queries - points
    return np.sqrt(np.cumsum(gaps * gaps, axis=1)[:, -1])


def tree_order(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, radius) of a vantage-point tree; the radius is ``NONE`` inside leaves.

    The vantage point of a range is the row farthest from the range's first one.
    """
    order, radius = np.arange(len(points)), np.full(len(points), NONE)
    ranges = [(0, len(points))]
    while ranges:
        lo, hi = ranges.pop()
        if hi - lo <= LEAF:
            continue
        rows = order[lo:hi]
        far = lo + int(np.argmax(distances(points[rows], points[rows[:1]])))
        order[lo], order[far] = order[far], order[lo]
        rest = order[lo + 1: hi]
        away = distances(points[rest], points[order[lo: lo + 1]])
        half = len(rest) // 2
        by = np.argpartition(away, half)
        order[lo + 1: hi] = rest[by]
        # all before the border are at most as far as the radius, all after at least
        radius[lo] = away[by[half]]
        ranges += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
    return order, radius


class Found:
    """The k nearest so far of each query of a block, by (distance, id)."""

    def __init__(self, ids: np.ndarray, cutoff: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.cutoff = cutoff.copy()
        self.far = np.full((len(ids), k), np.inf)
        self.rows = np.full((len(ids), k), NO_ID)

    def add(self, q: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        """Candidates (q ascending) join the lists; the k-th distance becomes the cutoff."""
        if not len(q):
            return
        who, first, counts = np.unique(q, return_index=True, return_counts=True)
        row, col = np.repeat(np.arange(len(who)), counts), np.arange(len(q)) - np.repeat(first, counts)
        new_far = np.full((len(who), counts.max()), np.inf)
        new_ids = np.full(new_far.shape, NO_ID)
        new_far[row, col], new_ids[row, col] = far, ids
        all_far, all_ids = np.hstack([self.far[who], new_far]), np.hstack([self.rows[who], new_ids])
        best = np.lexsort((all_ids, all_far), axis=1)[:, : self.k]
        self.far[who], self.rows[who] = np.take_along_axis(all_far, best, 1), np.take_along_axis(all_ids, best, 1)
        self.cutoff[who] = np.minimum(self.cutoff[who], self.far[who, -1])


def search(ids: np.ndarray, points: np.ndarray, radius: np.ndarray, queries: np.ndarray, found: Found, factor: float) -> int:
    """Walks a block of queries through a tree; returns the number of distances taken.

    All queries that need a range go through it together, those on a vantage point's own
    side first, so that their cutoffs are small when the other side is looked at.
    """
    square, squares, taken = (queries * queries).sum(axis=1), (points * points).sum(axis=1), 0
    with np.errstate(over="ignore", invalid="ignore"):
        reach = [(0, len(ids), np.arange(len(queries)), np.zeros(len(queries)))]
        while reach:
            lo, hi, who, gap = reach.pop()
            # the triangle inequality: everything in the range is at least this far
            who = who[~(gap > factor * found.cutoff[who])]
            if lo >= hi or not len(who):
                continue
            if radius[lo] == NONE:
                taken += (hi - lo) * len(who)
                rough = square[who, None] + squares[None, lo:hi] - 2 * queries[who] @ points[lo:hi].T
                # rounding of the rough value is far below this slack; the exact one decides
                slack = 1e-9 * (square[who, None] + squares[None, lo:hi])
                q, p = np.nonzero(~(rough - slack > np.square(found.cutoff[who])[:, None]))
                keep = ids[lo + p] != found.ids[who[q]]
                q, p = who[q[keep]], lo + p[keep]
                far = distances(queries[q], points[p])
                near = far <= found.cutoff[q]
                found.add(q[near], ids[p[near]], far[near])
                continue
            taken += len(who)
            half = lo + 1 + (hi - lo - 1) // 2
            away = distances(queries[who], points[lo: lo + 1])
            near = (away <= found.cutoff[who]) & (ids[lo] != found.ids[who])
            found.add(who[near], np.full(near.sum(), ids[lo]), away[near])
            inner = away < radius[lo]
            # less what rounding may add to it
            gaps = np.abs(away - radius[lo]) - 1e-12 * (away + radius[lo])
            own = np.zeros(len(who))
            # taken from the end: own sides first
            reach += [(half, hi, who[inner], gaps[inner]), (lo + 1, half, who[~inner], gaps[~inner]), (half, hi, who[~inner], own[~inner]), (lo + 1, half, who[inner], own[inner])]
    return taken


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def indexed(rows: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(dim, shard, pos, id, vector, radius): the trees of usable rows, written."""
    good = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))

    def run(batches):
        part, shard, waiting = TaskContext.get().partitionId(), 0, {}

        def tree(dim):
            nonlocal shard
            ids, points = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            order, radius = tree_order(points)
            n, shard = len(ids), shard + 1
            for at in range(0, n, 2048):
                cut = order[at: at + 2048]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(cut) + 1) * dim, dim), pa.int32()), pa.array(points[cut].ravel()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cut), dim), pa.int32()), pa.array(np.full(len(cut), (part << 32) + shard), pa.int64()),
                    pa.array(np.arange(at, at + len(cut)), pa.int32()), pa.array(ids[cut]), vectors, pa.array(radius[at: at + 2048]),
                ], names=["dim", "shard", "pos", "id", "vector", "radius"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = vectors.value_lengths().to_numpy()
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                mine = _matrix(vectors.take(pa.array(which)))
                taken = 0
                while taken < len(which):
                    have = sum(len(i) for i, _ in waiting.get(dim, []))
                    step = min(shard_rows - have, len(which) - taken)
                    waiting.setdefault(dim, []).append((ids[which[taken: taken + step]], mine[taken: taken + step]))
                    taken += step
                    if have + step == shard_rows:
                        yield from tree(dim)
        for dim in list(waiting):
            yield from tree(dim)

    return stored(good.mapInArrow(run, "dim int, shard long, pos int, id long, vector array<double>, radius double"), "trees")


def _searched(index: DataFrame, sent: DataFrame, k: int, factor: float) -> DataFrame:
    """(row, query_id, id, far) within ``index`` for queries sent to shards.

    A shard's tree arrives before the queries sent to it, which pass in blocks: a task
    holds one tree and one block.
    """
    null = lambda kind: F.lit(None).cast(kind)
    trees = index.select("shard", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("at"), "id", "vector", "radius")
    asked = sent.select("shard", F.lit(1).alias("kind"), F.col("row").alias("at"), F.col("query_id").alias("id"), "vector", F.col("cutoff").alias("radius"))
    rows = trees.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "at")

    def answers(tree, block):
        rows_, ids, points, cutoff = (np.concatenate(x) for x in zip(*block))
        found = Found(ids, cutoff, k)
        search(*tree, points, found, factor)
        q, j = np.nonzero(found.rows != NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(rows_[q]), pa.array(ids[q]), pa.array(found.rows[q, j]), pa.array(found.far[q, j])], names=["row", "query_id", "id", "far"])

    def run(batches):
        shard, kind, tree, parts = None, None, None, []
        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            borders = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *borders], [*borders, len(shards)]):
                if (shards[lo], kinds[lo]) != (shard, kind):
                    if kind == 1 and parts and tree:
                        yield from answers(tree, parts)
                    if shards[lo] != shard:
                        tree = None
                    elif kind == 0:
                        _, ids, points, radius = (np.concatenate(x) for x in zip(*parts))
                        tree = (ids, points, radius)
                    shard, kind, parts = shards[lo], kinds[lo], []
                for at in range(lo, hi, TOGETHER):
                    cut = batch.slice(at, min(TOGETHER, hi - at))
                    parts.append((cut.column(2).to_numpy(), cut.column(3).to_numpy(), _matrix(cut.column(4)), cut.column(5).to_numpy()))
                    if kind == 1 and tree and sum(len(p[0]) for p in parts) >= TOGETHER:
                        yield from answers(tree, parts)
                        parts = []
        if kind == 1 and parts and tree:
            yield from answers(tree, parts)

    return rows.mapInArrow(run, "row long, query_id long, id long, far double")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("row").orderBy("far", "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of ``index`` to every usable query.

    ``queries`` has id and vector.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor must lie in (0, 1]")
    good = queries.where(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = stored(good.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).withColumn("dim", F.size("vector")), "queries")
    # a row of a few numbers per shard, as many as scan tasks and runs of SHARD rows
    shards = index.groupBy("dim", "shard").agg(F.count("*").alias("n"))
    strides = shards.groupBy("dim").agg(F.ceil(F.sqrt(F.count("*"))).alias("stride"))
    shards = stored(shards.join(strides, "dim").select("dim", "shard", "stride"), "shards")
    # a stated set of queries against all rows: every query goes to every shard of its length
    first = F.pmod(F.xxhash64("row"), F.col("stride")) == F.pmod(F.xxhash64("shard"), F.col("stride"))
    sent = lambda rows, which: rows.join(F.broadcast(shards), "dim").where(which)
    scouted = stored(_searched(index, sent(asked.withColumn("cutoff", F.lit(float("inf"))), first), k, factor), "scouted")
    cutoffs = scouted.groupBy("row").agg(F.sort_array(F.collect_list("far")).alias("fars")).select("row", F.when(F.size("fars") >= k, F.get("fars", F.lit(k - 1))).alias("cutoff"))
    bound = asked.join(cutoffs, "row", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("inf"))))
    found = scouted.unionByName(_searched(index, sent(bound, ~first), k, factor))
    return _nearest(found, k).select("query_id", "rank", "id", F.col("far").alias("score"))
