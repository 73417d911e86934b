"""Merkle tree of a table whose tampered leaves are persistent versions.

Leaves are placed by (group, order). While a group has more than one node, every sixteen
consecutive ones become one; what remains is the group's subroot, and the subroots, in the
order of their groups, become the root in the same way.

The tree is built bottom up. Two levels at a time lie in an aligned block of 256 leaves,
a row of bounded size that one task folds; the levels above are one aggregation each over
sixteen times fewer rows. A change of one leaf is a version of its own that shares every
untouched node with the tree: it copies the leaf's ancestors and nothing else, first
inside the block and then along the way from the block to the root, which comes to the
block as at most sixteen digests a level. So no version waits for another one, and the
cost of all versions is that of their paths.

Placing is one range shuffle of digests; a group of any size spans many parts, each part
carries one number on. Null groups are a group of their own, before all others. Rows with
a null order value come first in their group; rows equal in all order columns are leaves
of their own, ordered by their digests. An empty table gives an empty tree. Names of the
table's own columns never meet those used here, because they are renamed on the way in.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pultwerk.llm.common import slices, stored

RUN = 16
# leaves of an aligned block, two levels high
BLOCK = RUN * RUN


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """Null becomes the empty string, so that it differs from and precedes every text."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place``, counted from 0 in each ``grp`` by ``order``.

    Rows are dealt out by range, so a group may span many parts. A part continues at most
    one group of the parts before it: what is carried on is one row per part.
    """
    keys = ["grp", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        part, group, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for name in batch.column("grp").to_pylist():
                at = at + 1 if name == group else 0
                group = name
                local.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    numbered = stored(dealt.mapInArrow(run, f"{fields}, part int, local long"), "leaves")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = numbered.groupBy("part", "grp").count().select("part", "grp", F.sum("count").over(before).alias("carried")).where("carried > 0")
    joined = numbered.join(F.broadcast(carried), ["part", "grp"], "left")
    return joined.withColumn("place", F.col("local") + F.coalesce("carried", F.lit(0))).drop("part", "local", "carried")


def _folded(nodes: Column) -> Column:
    """The next level over a list of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * RUN + 1, RUN)), 256))


@dataclass
class Tree:
    """``blocks``: grp, block, rows; ``bottom``: grp, at, total, digest of the blocks;
    ``levels``: grp, at, total, run, digest of the nodes above, lowest first; ``total`` counts
    the group's nodes of that level; ``tops``: grp and digest of what remains."""

    blocks: DataFrame
    bottom: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def built(rows: DataFrame, order: list[str]) -> Tree:
    """Tree over rows with ``grp``, ``leaf`` and further columns that stay with the leaf."""
    kept = [c for c in rows.columns if c not in ("grp", "place")]
    at = placed(rows, order)
    in_order = F.array_sort(F.collect_list(F.struct("place", *kept)))
    blocks = at.groupBy("grp", F.floor(F.col("place") / BLOCK).alias("block")).agg(in_order.alias("rows"))
    blocks = stored(blocks, "blocks")
    first = F.col("rows.leaf")
    once = _folded(first)
    narrow = blocks.select("grp", F.col("block").alias("at"), F.size("rows").alias("n"), first[0].alias("lone"), once[0].alias("low"), _folded(once)[0].alias("high"))
    narrow = stored(narrow, "block-tops")
    # a group of one block stops where one node remains
    alone = F.col("total") == 1
    top = F.when(alone & (F.col("n") == 1), F.col("lone")).when(alone & (F.col("n") <= RUN), F.col("low")).otherwise(F.col("high"))
    level = stored(narrow.join(narrow.groupBy("grp").agg(F.count("*").alias("total")), "grp").select("grp", "at", "total", top.alias("digest")), "level")
    bottom, tops, levels = level, [level.where("total = 1").select("grp", "digest")], []
    while level.agg(F.max("total")).first()[0] not in (None, 1):
        run = F.array_sort(F.collect_list(F.struct("at", "digest")))["digest"]
        up = level.where("total > 1").groupBy("grp", F.floor(F.col("at") / RUN).alias("at"), F.ceil(F.col("total") / RUN).alias("total")).agg(run.alias("run"))
        level = stored(up.withColumn("digest", F.sha2(F.concat_ws("", "run"), 256)), "level")
        levels.append(level)
        tops.append(level.where("total = 1").select("grp", "digest"))
    return Tree(blocks, bottom, levels, reduce(DataFrame.unionByName, tops))


_STEP = "array<struct<slot:int,run:array<string>>>"


def _ways(tree: Tree) -> DataFrame:
    """(grp, block, total, way): the runs from above every block up to its group's top.

    Worked out from the top: each level is a join of a sixteenth of the next one's rows.
    """
    none = F.array().cast(_STEP)
    way = None
    for level in reversed(tree.levels):
        starts = level.where("total = 1").select("grp", "at", none.alias("way"))
        way = starts if way is None else way.unionByName(starts)
        step = level.select("grp", "at", "run").join(way, ["grp", "at"])
        down = step.select("grp", F.col("at").alias("up"), "run", "way", F.posexplode("run").alias("slot", "_digest"))
        way = down.select("grp", (F.col("up") * RUN + F.col("slot")).alias("at"), F.concat(F.array(F.struct("slot", "run")), "way").cast(_STEP).alias("way"))
    single = tree.bottom.where("total = 1").select("grp", "at", none.alias("way"))
    way = single if way is None else way.unionByName(single)
    return way.join(tree.bottom.select("grp", "at", "total"), ["grp", "at"]).withColumnRenamed("at", "block")


def _in_block(place: Column, nodes: Column, total: Column) -> Column:
    """The runs that a leaf passes inside its block."""
    at = F.pmod(place, F.lit(BLOCK)).cast("int")
    run_of = lambda level, i: F.slice(level, F.floor(i / RUN).cast("int") * RUN + 1, RUN)
    low = F.struct((at % RUN).alias("slot"), run_of(nodes, at).alias("run"))
    middle = F.floor(at / RUN).cast("int")
    high = F.struct((middle % RUN).alias("slot"), run_of(_folded(nodes), middle).alias("run"))
    lone, low_only = (total == 1) & (F.size(nodes) == 1), (total == 1) & (F.size(nodes) <= RUN)
    return F.when(lone, F.array().cast(_STEP)).when(low_only, F.array(low).cast(_STEP)).otherwise(F.array(low, high).cast(_STEP))


def _leaf_ways(tree: Tree) -> DataFrame:
    """(leaf columns, way): the runs that every leaf passes; for the small tree of the tops."""
    joined = tree.blocks.join(_ways(tree), ["grp", "block"]).select("total", "way", F.col("rows.leaf").alias("nodes"), F.explode("rows").alias("r"))
    return joined.select("r.*", F.concat(_in_block(F.col("r.place"), F.col("nodes"), F.col("total")), "way").alias("way"))


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def _copied(leaves: list[str], edited: list[str], total: int, way: list[tuple[int, list[str]]]):
    """Per leaf of a block: its siblings on the way up and the ancestors its version copies.

    The nodes of the block are shared by all its versions.
    """
    levels = [leaves]
    height = 2 if total > 1 or len(leaves) > RUN else 1 if len(leaves) > 1 else 0
    for _ in range(height):
        below = levels[-1]
        levels.append([_digest(below[i: i + RUN]) for i in range(0, len(below), RUN)])
    for i, new in enumerate(edited):
        siblings, nodes, at = [], [new], i
        steps = []
        for level in levels[:height]:
            first = at // RUN * RUN
            steps.append((at - first, level[first: first + RUN]))
            at //= RUN
        for slot, run in (*steps, *way):
            siblings += run[:slot]
            siblings += run[slot + 1:]
            nodes.append(_digest([*run[:slot], nodes[-1], *run[slot + 1:]]))
        yield siblings, nodes


def versions(docs: DataFrame, key: str, group: str, columns: list[str], edited: dict[str, Column], when: Column) -> DataFrame:
    """A row per document: key, leaf, place in its group, subroot, root, proof and version.

    ``columns`` are what a leaf holds, in order. Where ``when`` is true the columns of
    ``edited`` are replaced in a version of that row. ``proof_sha256`` is the digest of all
    siblings from the leaf to the root; ``copied`` lists the nodes that the version does
    not share, leaf first, root last (null where nothing was edited); ``folded_root`` is
    the root over the row's new, else old, leaf and the siblings.
    """
    old, new = [F.col(c) for c in columns], [edited.get(c, F.col(c)) for c in columns]
    # the row number makes equal rows differ, so that every row has one place; it is written
    # with the digests and stays as it is
    leaves = stored(docs.select(
        F.col(key).alias("doc"), group_key(F.col(group)).alias("grp"), leaf_digest(old).alias("leaf"),
        F.when(when, leaf_digest(new)).alias("edited"), F.monotonically_increasing_id().alias("row")), "digests")
    tree = built(leaves, ["doc", "leaf", "row"])
    tops = stored(tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("leaf")), "tops")
    upper = built(tops, ["name"])
    # one row: the root; then as many rows as groups, of which every block gets its own
    root = upper.tops.select(F.col("grp").alias("upper_grp"), F.col("digest").alias("root"))
    above = _leaf_ways(upper).select(F.lit("").alias("upper_grp"), F.col("name").alias("grp"), F.col("leaf").alias("subroot"), F.col("way").alias("upper_way")).join(F.broadcast(root), "upper_grp")
    ways = _ways(tree).join(above, "grp").select("grp", "block", "total", "subroot", "root", F.concat("way", "upper_way").alias("way"))
    whole = tree.blocks.join(stored(ways, "ways"), ["grp", "block"]).select("total", "rows", "subroot", "root", "way")
    kind = leaves.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in slices([batch], 16):
                out = {n: [] for n in ("doc", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "copied")}
                for total, rows, subroot, root, way in zip(*[c.to_pylist() for c in block.columns]):
                    leaves_ = [r["leaf"] for r in rows]
                    news = [r["edited"] or r["leaf"] for r in rows]
                    steps = [(w["slot"], w["run"]) for w in way]
                    for r, (siblings, nodes) in zip(rows, _copied(leaves_, news, total, steps)):
                        for name, value in zip(out, (r["doc"], r["place"], r["leaf"], subroot, root, _digest(siblings), nodes[-1], nodes if r["edited"] else None)):
                            out[name].append(value)
                types = [block.schema.field("rows").type.value_type.field("doc").type, pa.int64(), *[pa.string()] * 5, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return whole.mapInArrow(run, f"doc {kind}, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>")


def copied_nodes(found: DataFrame) -> DataFrame:
    """(doc, level, digest): the nodes that each version has of its own."""
    return found.where("copied IS NOT NULL").select("doc", F.posexplode("copied").alias("level", "digest"))


LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_cased_copies(docs: DataFrame) -> DataFrame:
    """``versions`` of documents: every fifth by the crc32 of its id has A-Z in lower case."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return versions(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.translate("text", *LETTERS)}, fifth)
