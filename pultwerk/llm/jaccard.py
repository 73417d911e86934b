"""From band keys to components: star edges, exact confirmation, exact completion.

Nodes are 64-bit keys of distinct contents. ``payloads`` holds (node, payload, n), n being
the size of the set; ``as_sets`` turns a list of payloads into their sorted distinct 64-bit
elements inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pultwerk.llm.common import drop_shuffles, slices, stored
from pultwerk.llm.components import components

# centers of a bucket; more of them leave less to the exact completion
CENTERS = 4
# members and set elements of a bucket that one task compares at once
BUCKET_ROWS, BUCKET_ELEMENTS = 1024, 1 << 20
# set elements of several small buckets that a task works on at a time, and matrix columns
GROUP_ELEMENTS, COLUMNS = 1 << 18, 4096
# buckets up to this size are compared pair by pair
FEW = 4

AsSets = Callable[[list[memoryview]], list[np.ndarray]]


def live_buckets(keys: DataFrame) -> DataFrame:
    """(band, node) of all buckets with at least two nodes, repeats left out.

    Rows are dealt by band and sorted, and a task walks over them holding one row, so a
    bucket may have any size.
    """
    dealt = keys.select("band", "node").repartition("band").sortWithinPartitions("band", "node")

    def run(batches):
        band_before = head_before = node_before = shown = None
        for batch in batches:
            if not batch.num_rows:
                continue
            band, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.append(band_before is None or band[0] != band_before, band[1:] != band[:-1])
            fresh = new | np.append(node_before is None or node[0] != node_before, node[1:] != node[:-1])
            first = np.flatnonzero(np.append(True, new[1:]))
            group = np.cumsum(new) - new[0]
            heads = node[first].copy()
            if not new[0]:
                heads[0] = head_before
            # a bucket's first node is shown once a second one is met
            other = fresh & (node != heads[group])
            alive = np.zeros(len(heads), bool)
            alive[group[other]] = True
            show = alive.copy()
            if not new[0] and shown:
                show[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([band[first][show], band[other]])), pa.array(np.concatenate([heads[show], node[other]]))], names=["band", "node"])
            shown = bool(alive[-1] or (len(heads) == 1 and not new[0] and shown))
            band_before, node_before, head_before = band[-1], node[-1], heads[-1]

    return dealt.mapInArrow(run, "band long, node long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)
    return bool(100 * both >= percent * (len(a) + len(b) - both))


def confirmed(pairs: DataFrame, payloads: DataFrame, as_sets: AsSets, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = payloads.select(F.col("node").alias("a"), F.col("payload").alias("left"))
    right = payloads.select(F.col("node").alias("b"), F.col("payload").alias("right"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")

    def run(batches):
        for batch in slices(batches, 1024):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # a node stands in several pairs: its set is made once a batch
            payload_of = dict(zip(a, batch.column(2)))
            payload_of.update(zip(b, batch.column(3)))
            set_of = dict(zip(payload_of, as_sets([p.as_buffer() for p in payload_of.values()])))
            alike = [_alike(set_of[x], set_of[y], percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    elements, code, known = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # elements of one set only are no columns
    column = np.cumsum(known > 1) - 1
    shared = known[code] > 1
    owner, column = owner[shared], column[code[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        both += part @ part.T
    return both


def _joined(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of places that join the alike sets of a bucket, one less than a component has members."""
    if len(sets) <= FEW:
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if root[i] != root[j] and _alike(sets[i], sets[j], percent):
                    root = [root[i] if r == root[j] else r for r in root]
                    yield i, j
        return
    both, sizes = _counts(sets), np.array([len(s) for s in sets], np.int64)
    both = both.astype(np.int64)
    alike = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    left = np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start], edge = False, np.array([start])
        while len(edge):
            edge = np.flatnonzero(alike[edge].any(axis=0) & left)
            left[edge] = False
            yield from ((start, int(k)) for k in edge)


def within_buckets(members: DataFrame, payloads: DataFrame, as_sets: AsSets, percent: int) -> DataFrame:
    """Edges (a, b) that join the alike members of every bucket; a task compares whole buckets.

    Payloads travel once per member and nothing else is shuffled. For buckets of bounded size.
    """
    rows = members.join(payloads.select("node", "payload"), "node").select("band", "node", "n", "payload")
    dealt = rows.repartition("band").sortWithinPartitions("band", "node")

    def edges(rows: pa.RecordBatch, borders: np.ndarray) -> pa.RecordBatch:
        node, sets = rows.column(1).to_numpy(), as_sets([p.as_buffer() for p in rows.column(3)])
        found = [(a + i, a + j) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()) for i, j in _joined(sets[a:b], percent)]
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

    def whole_buckets(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The buckets between the starts, as many at a time as their elements allow."""
        before = np.concatenate([[0], np.cumsum(rows.column(2).to_numpy())])[starts]
        at = 0
        while at < len(starts) - 1:
            end = max(at + 1, int(np.searchsorted(before, before[at] + GROUP_ELEMENTS, side="right")) - 1)
            yield edges(rows.slice(starts[at], starts[end] - starts[at]), starts[at: end + 1] - starts[at])
            at = end

    def run(batches):
        held = None
        for batch in slices(batches, 1024):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            band = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            # the last bucket may go on in the next batch
            yield from whole_buckets(batch, starts)
            held = batch.slice(starts[-1])
        if held is not None:
            yield from whole_buckets(held, np.array([0, held.num_rows]))

    return dealt.mapInArrow(run, "a long, b long")


def prefix_pairs(payloads: DataFrame, members: DataFrame, as_sets: AsSets, percent: int, by_bucket: bool) -> DataFrame:
    """Pairs of different components that share an element among the rarest of both, and with
    ``by_bucket`` a bucket.

    Of two sets with the wanted similarity, each holds at most n - ceil(percent * n / 100)
    elements that the other lacks, so in any common order of elements their prefixes one
    longer meet. Rarest first, most sets have a prefix that nobody else knows.
    """
    rows = members.select("node", "component").distinct().join(payloads.select("node", "payload"), "node").dropDuplicates(["node"]).select("node", "component", "payload")

    def run(batches):
        for batch in slices(batches, 256):
            values = [v.view(np.int64) for v in as_sets([s.as_buffer() for s in batch.column(2)])]
            counts = np.array([len(v) for v in values], np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(counts, counts)), pa.array(np.concatenate([np.zeros(0, np.int64), *values]))],
                names=["node", "component", "n", "element"],
            )

    tokens = rows.mapInArrow(run, "node long, component long, n long, element long")
    known = tokens.groupBy("element").agg(F.count(F.lit(1)).alias("known")).where("known > 1")
    of_node = Window.partitionBy("node")
    # elements that nobody else knows come first
    lone = F.col("n") - F.count(F.lit(1)).over(of_node)
    place = lone + F.row_number().over(of_node.orderBy("known", "element"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    ranked = tokens.join(known, "element").withColumn("place", place)
    prefix = stored(ranked.where(F.col("place") <= length).select("element", "node", "component", "n", "place"), "prefixes")
    keys = ["band", "element"] if by_bucket else ["element"]
    if by_bucket:
        prefix = prefix.join(members.select("band", "node"), "node")
    left, right = (prefix.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "n", "place")]) for side in "ab")
    # what can still follow this common element must be enough for the threshold
    enough_left = f"{100 + percent} * (1 + least(n_a - place_a, n_b - place_b)) >= {percent} * (n_a + n_b)"
    met = left.join(right, keys).where(f"node_a < node_b AND component_a <> component_b AND {_similar_size('n_a', 'n_b', percent)} AND {enough_left}")
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _similar_size(a: str, b: str, percent: int) -> str:
    """Sets of other sizes can't reach the threshold."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _still_open(members: DataFrame, parents: DataFrame, percent: int, equal_once: bool = False) -> DataFrame:
    """(band, node, n, component) of the buckets that hold several components, with the bucket's
    members and elements.

    A member whose neighbours by size are too far off has no partner there and is left out.
    ``equal_once`` takes one of the buckets that then hold the very same nodes.
    """
    by_size = Window.partitionBy("band").orderBy("n")
    sized = members.withColumns({"_less": F.lag("n").over(by_size), "_more": F.lead("n").over(by_size)})
    paired = sized.where(f"100 * _less >= {percent} * n OR 100 * n >= {percent} * _more").select("band", "node", "n")
    grouped = paired.join(parents, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    held = [F.count(F.lit(1)).alias("its_rows"), F.sum("n").alias("its_elements"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"_x{i}") for i in range(2)]]
    mixed = grouped.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), *held).where("_a < _b")
    if equal_once:
        mixed = mixed.groupBy("its_rows", "its_elements", "_x0", "_x1").agg(F.min("band").alias("band"))
    mixed = mixed.select("band", "its_rows", "its_elements")
    return stored(grouped.join(mixed, "band"), "open-buckets")


def linked(members: DataFrame, payloads: DataFrame, as_sets: AsSets, percent: int, centers: int = CENTERS, by_bucket: bool = False) -> DataFrame:
    """(node, component) of every node linked with a smaller one.

    ``members`` are the live buckets. Every bucket gets a few centers and gives star edges
    from each of them to its members, so it gives at most a few times as many pairs as
    members; all links of the centers in their bucket are known then, and small buckets are
    done. A star can miss a link between two leaves: buckets whose other members still lie
    in several components are completed exactly through ``prefix_pairs``. Members of one
    component, and sets of too different sizes, are never compared. ``by_bucket`` compares
    members of one bucket only: right for many small sets, whose rare elements are not rare
    enough; large sets with many common buckets would meet once in each. Buckets of bounded
    size are then compared whole, each inside a task, and only larger ones take the way above.
    """
    nothing = members.sparkSession.createDataFrame([], "node long, component long")
    sizes = payloads.groupBy("node").agg(F.max("n").alias("n"))
    now = _still_open(members.join(sizes, "node").select("band", "node", "n"), nothing, percent, by_bucket)
    known = None
    if by_bucket:
        small = f"its_rows <= {BUCKET_ROWS} AND its_elements <= {BUCKET_ELEMENTS}"
        known = stored(within_buckets(now.where(small), payloads, as_sets, percent), "bucket-links")
        drop_shuffles(members.sparkSession)
        now = now.where(f"NOT ({small})")
        if now.isEmpty():
            return components(known)
    # the same order in every bucket, so that a group of copies meets the same few centers
    orders = [F.xxhash64("node", F.lit(i)) for i in range(centers)]
    chosen = now.groupBy("band").agg(*[f("n" if k else "node", o).alias(f"{k}{i}") for i, o in enumerate(orders) for k, f in (("", F.min_by), ("n", F.min_by))])
    picked = F.array(*[F.struct(F.col(f"`{i}`").alias("center"), F.col(f"n{i}").alias("its_n")) for i in range(centers)])
    around = now.join(chosen.select("band", picked.alias("picked")), "band")
    stars = around.select("node", "n", F.inline("picked")).where(f"node <> center AND {_similar_size('n', 'its_n', percent)}")
    pairs = stars.select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
    links = stored(confirmed(pairs, payloads, as_sets, percent), "links")
    parents = components(links if known is None else links.unionByName(known))
    drop_shuffles(members.sparkSession)
    leaves = around.where(~F.array_contains(F.col("picked.center"), F.col("node"))).select("band", "node", "n")
    now = _still_open(leaves, parents, percent)
    if now.isEmpty():
        return parents
    more = stored(confirmed(prefix_pairs(payloads, now, as_sets, percent, by_bucket), payloads, as_sets, percent), "more-links")
    drop_shuffles(members.sparkSession)
    # what was joined before counts as an edge from each node to its component
    return components(parents.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
