"""Near-duplicate documents by MinHash.

1. A task turns each text into its set of word shingles, one-permutation MinHash with
   optimal densification and band keys (``shingles``). Texts with equal sets are one class
   from here on, whatever their number.
2. Classes that share a band key form a bucket. A bucket gives star edges only: from a few
   centers to each other class, so a bucket of any size gives few pairs per member.
3. Candidate pairs are confirmed on the full sets, and a distributed union-find joins them.
4. Stars can miss a link between two leaves. Buckets that still hold several components
   are completed exactly: two sets that are similar enough share one of their few rarest
   shingles (prefix filter with sizes and positions), so classes of different components
   that do are confirmed too. Members of one component are never compared again.

Nothing is sampled or capped; with bands of six over 240 bins a link at the threshold of
0.85 is missed by all 40 bands with a probability of about 6e-9.

A null or empty text has an empty set and is linked with nothing. Repeated rows share their
component. ``kept`` is true for the rows whose key is the component's smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.llm import shingles
from pultwerk.llm.common import U64, slices, small_or_shuffled, stored, utf8_slices, whole_text
from pultwerk.llm.jaccard import linked, live_buckets


def _sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    data, borders = utf8_slices(batch.column(column))
    return [shingles.shingle_set(data[a:b]) for a, b in zip(borders[:-1], borders[1:])]


def signatures(docs: DataFrame, key: str) -> DataFrame:
    """(doc, n_shingles, set_key, bands) of every row."""
    rows = docs.select(F.col(key).alias("doc"), whole_text().alias("text"))

    def run(batches):
        for batch in slices(batches, 256):
            sets = _sets(batch, 1)
            bands = [shingles.band_keys(shingles.one_permutation(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.set_key(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())),
            ], names=["doc", "n_shingles", "set_key", "bands"])

    return stored(rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, n_shingles long, set_key long, bands array<long>"), "signatures")


def full_sets(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(node, payload, n) of the wanted documents: key of the set and its sorted numbers."""
    rows = docs.select(F.col(key).alias("doc"), whole_text().alias("text")).join(small_or_shuffled(wanted), "doc", "left_semi").select("text")

    def run(batches):
        for batch in slices(batches, 256):
            sets = _sets(batch, 0)
            yield pa.RecordBatch.from_arrays([pa.array([shingles.set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["node", "payload", "n"])

    return stored(rows.mapInArrow(run, "node long, payload binary, n long"), "sets")


def classes(docs: DataFrame, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """(doc, n_shingles, component) of every row; component is the smallest doc reachable.

    The nodes of the graph are the distinct sets, named by their ``set_key``.
    """
    found = signatures(docs, key)
    whole = found.where("n_shingles > 0")
    # copies become one node; its smallest document stands for it
    named = stored(whole.groupBy(F.col("set_key").alias("node")).agg(F.min("doc").alias("doc")), "nodes")
    bands = whole.join(named, "doc").where("node = set_key").select("node", F.explode("bands").alias("band"))
    members = stored(live_buckets(bands), "buckets")
    wanted = members.select("node").distinct().join(named, "node").select("doc").distinct()
    joined = linked(members, full_sets(docs, key, stored(wanted, "wanted")), lambda payloads: [np.frombuffer(p, U64) for p in payloads], percent)
    placed = named.join(joined, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc").alias("smallest"))
    final = placed.join(smallest, "component").select(F.col("node").alias("set_key"), "smallest")
    # the empty set has the key 0 and is no node
    return found.select("doc", "n_shingles", "set_key").join(final, "set_key", "left").select("doc", "n_shingles", F.coalesce("smallest", "doc").alias("component"))


def kept_documents(docs: DataFrame, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """One document of each group of near copies, with its columns; texts without words stay.

    Rows with a null key are no copies of others and stay. Of rows with equal key and text
    one stays.
    """
    found = stored(classes(docs, percent, key).select("doc", "component"), "components")
    dropped = small_or_shuffled(stored(found.where("doc <> component").select(F.col("doc").alias(key)).distinct(), "dropped"))
    again = small_or_shuffled(stored(found.groupBy(F.col("doc").alias(key)).count().where(f"count > 1 AND `{key}` IS NOT NULL").select(key), "repeated"))
    # the ids that go, or come twice, are narrow and counted before they are sent
    kept = docs.join(dropped, key, "left_anti").select(*docs.columns)
    once = kept.join(again, key, "left_semi").dropDuplicates([key, "text"])
    return kept.join(again, key, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
