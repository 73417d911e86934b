"""Sharding over fixed virtual slots with a versioned map from slot to shard.

A record's slot is a hash of its key and never changes. Bytes are summed per slot; the
slot-to-shard map, a table of ``n_slots`` rows whatever the size of the data, is what is
edited when shards are added or loads drift. Rows of a hot key, source or group of copies
spread over the slots because the key is the record's own id.

Null keys share one slot. Null texts count as empty. Repeated rows each get a place of
their own. An empty table gives an empty result and a map without bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pultwerk.llm.common import new_folder, stored, whole_text

N_SLOTS = 16384
MAP_SCHEMA = "virtual_slot int, shard int, bytes long, rows long, first_place long"


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n_slots)).cast("int")


def slot_loads(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot in use; at most ``n_slots`` rows reach the driver."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return sorted((r["virtual_slot"], r["bytes"], r["rows"]) for r in sums.collect())


def first_map(loads: Iterable[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Heaviest slot first, each to the lightest shard; empty slots go round."""
    loads = {slot: size for slot, size, _ in loads}
    heap = [(0, shard) for shard in range(n_shards)]
    chosen = {}
    for slot in sorted(range(n_slots), key=lambda s: (-loads.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        chosen[slot] = shard
        heapq.heappush(heap, (size + loads.get(slot, 0), shard))
    return chosen


def rebalanced(slot_map: dict[int, int], loads: Iterable[tuple[int, int, int]], n_shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """The map edited for new loads or shard counts, moving as few bytes as it can.

    Slots leave shards that no longer exist and, lightest first, shards above
    (1 + tolerance) of the mean; each goes to the shard that is lightest at that moment.
    A slot never leaves a shard that is not above the mean.
    """
    loads = {slot: size for slot, size, _ in loads}
    total = [0] * n_shards
    held: dict[int, list[int]] = {shard: [] for shard in range(n_shards)}
    loose = []
    for slot, shard in slot_map.items():
        if shard < n_shards:
            total[shard] += loads.get(slot, 0)
            held[shard].append(slot)
        else:
            loose.append(slot)
    limit = sum(loads.values()) / n_shards * (1 + tolerance)
    for shard, slots in held.items():
        for slot in sorted(slots, key=lambda s: (loads.get(s, 0), s)):
            if total[shard] <= limit:
                break
            if loads.get(slot, 0):
                total[shard] -= loads[slot]
                loose.append(slot)
    edited = dict(slot_map)
    heap = [(size, shard) for shard, size in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-loads.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (size + loads.get(slot, 0), shard))
    return edited


def write_map(spark: SparkSession, slot_map: dict[int, int], loads: Iterable[tuple[int, int, int]], folder: str, version: int) -> DataFrame:
    """Stores one version of the map; each version is a folder that is never overwritten."""
    loads = {slot: (size, rows) for slot, size, rows in loads}
    places: dict[int, int] = {}
    table = []
    for slot, shard in sorted(slot_map.items()):
        size, rows = loads.get(slot, (0, 0))
        table.append((slot, shard, size, rows, places.get(shard, 0)))
        places[shard] = places.get(shard, 0) + rows
    spark.createDataFrame(table, MAP_SCHEMA).coalesce(1).write.parquet(f"{folder}/version={version}")
    return read_map(spark, folder, version)


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def sized(docs: DataFrame, key: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """One narrow row per record: key, bytes, checksum of the text and virtual slot."""
    text = F.encode(whole_text(), "UTF-8")
    return docs.select(
        F.col(key), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), virtual_slot(F.col(key), n_slots).alias("virtual_slot"),
    )


def sharded(rows: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds the shard and the record's place in it, gapless from 0.

    A shard may hold millions of rows, so places are counted per virtual slot and start
    where the map says; the map has a fixed number of rows and is broadcast.
    """
    order = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")
    placed = rows.withColumn("_nth", F.row_number().over(order) - 1)
    return (
        placed.join(F.broadcast(slot_map.select("virtual_slot", "shard", "first_place")), "virtual_slot")
        .withColumn("slot", F.col("first_place") + F.col("_nth"))
        .drop("_nth", "first_place")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """Sizes, slots, first map (version 1, stored) and places in one go."""
    spark = docs.sparkSession
    rows = stored(sized(docs, key, n_slots), "sized")
    loads = slot_loads(rows)
    slot_map = first_map(loads, n_shards, n_slots)
    return sharded(rows, write_map(spark, slot_map, loads, folder or new_folder(spark, "slot-map"), 1), key)
