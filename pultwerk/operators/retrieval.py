"""Chunking, ingestion, exact nearest-vector search and context assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import arrow
from pultwerk.functions.text import strip, words
from pultwerk.session import cut_lineage

# cells grow with the root of the table, between these numbers
LEAST_CELLS, MOST_CELLS = 16, 1024
# a row travels once per block that it meets, so blocks are large; a task compares a slice of
# queries with a block at a time, and works out exact distances a piece of pairs at a time
BLOCK_ROWS = 8192
SLICE_ROWS = 128
PIECE_PAIRS = 1 << 15


def chunk_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, chunk) for every chunk longer than the minimum after trimming."""
    spans = docs.withColumn("_spans", arrow.chunk_spans(F.col("text")))
    pieces = F.transform("_spans", lambda s: strip(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    kept = F.filter(pieces, lambda p: F.char_length(p) > fv.CHUNK_MIN_CHARS)
    return spans.select(*docs.columns, F.posexplode(kept).alias("chunk_no", "chunk"))


def ingest(docs: DataFrame) -> DataFrame:
    """The chunk table: ids, metadata and text, ready to be written by class."""
    return chunk_rows(docs).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("document_id"), "chunk_no", "chunk",
        F.substring(F.coalesce(F.nullif("source", F.lit("")), F.lit("Lehrplan")), 1, 200).alias("source"), "classification")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by class, so a search over public material skips the rest."""
    chunks.write.mode("append").partitionBy("classification").parquet(path)


def ingest_report(docs: DataFrame) -> DataFrame:
    """Per document: chunks, words and, for rejected ones, why nothing was stored."""
    spans = F.transform(arrow.chunk_spans(F.col("text")), lambda s: strip(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    sized = docs.withColumn("chunks", F.size(F.filter(spans, lambda p: F.char_length(p) > fv.CHUNK_MIN_CHARS)))
    return sized.select("doc_id", "chunks", F.size(words(F.col("text"))).alias("words"), F.when(
        strip(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("chunks") == 0, "too_short").when(
        ~F.col("classification").isin("public_curriculum", "personal", "unknown"), "invalid_classification").alias("rejected"))


def needs_reading(pages: Column) -> Column:
    """A scan whose text layer is too thin to use."""
    parts = F.filter(F.transform(pages, strip), lambda p: p != "")
    return F.char_length(F.array_join(parts, "\n\n")) < fv.MIN_TEXT_LAYER_CHARS


def _sliced(vectors: pd.Series) -> Iterator[np.ndarray]:
    """Matrices of a few rows, so that a table of distances beside them stays small."""
    for at in range(0, len(vectors), SLICE_ROWS):
        yield arrow.matrix(vectors.iloc[at: at + SLICE_ROWS])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0)


def clamp_k(k: int) -> int:
    return min(max(k, 1), fv.SEARCH_MAX_K)


def _pivots(chunks: DataFrame) -> np.ndarray:
    """Spread-out vectors (a top-n by hash), the only rows the driver sees."""
    cells = min(max(math.isqrt(chunks.count()) // 4, LEAST_CELLS), MOST_CELLS)
    rows = chunks.select("embedding").orderBy(F.xxhash64("chunk_id")).limit(cells).collect()
    return arrow.matrix(pd.Series([r[0] for r in rows]))


@dataclass(frozen=True)
class Cells:
    """A chunk table placed for search: ``placed`` (chunk_id, embedding, cell) is written;
    a pivot, a radius and a number of chunks per cell, at most ``MOST_CELLS`` of them."""

    placed: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def cells_of(chunks: DataFrame) -> Cells:
    """Places every chunk in the cell of its nearest pivot, once, for any number of searches."""
    pivots = _pivots(chunks)

    @F.pandas_udf("struct<cell:int,away:double>")
    def nearest_pivot(vectors: pd.Series) -> pd.DataFrame:
        parts = [np.sqrt(arrow.squared_distances(part, pivots)) for part in _sliced(vectors)]
        return pd.DataFrame({"cell": _joined([d.argmin(1) for d in parts]).astype("int32"), "away": _joined([d.min(1) for d in parts])})

    if not len(pivots):
        return Cells(chunks.select("chunk_id", "embedding", F.lit(0).alias("cell")), pivots, np.zeros(0), np.zeros(0, int))
    placed = cut_lineage(chunks.select("chunk_id", "embedding").withColumn("_p", nearest_pivot("embedding")).select("chunk_id", "embedding", "_p.*"))
    radii, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), int)
    for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():
        radii[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    return Cells(placed.drop("away"), pivots, radii, sizes)


def own_cells(queries: DataFrame, cells: Cells) -> DataFrame:
    """(query_id, embedding, bound, cells): the one cell whose pivot is nearest; no bound yet."""
    pivots, filled = cells.pivots, np.flatnonzero(cells.sizes)

    @F.pandas_udf("array<int>")
    def own(vectors: pd.Series) -> pd.Series:
        nearest = [arrow.squared_distances(part, pivots[filled]).argmin(1) for part in _sliced(vectors)]
        return pd.Series([[int(filled[i])] for part in nearest for i in part])

    return queries.select("query_id", "embedding", F.lit(None).cast("double").alias("bound"), own("embedding").alias("cells"))


def other_cells(asked: DataFrame, near: DataFrame, cells: Cells, k: int, cutoff: float | None) -> DataFrame:
    """The same for the other cells that may hold a chunk within reach.

    Reach is the distance of the k-th chunk of the query's own cell, or the cutoff if that
    is nearer. By the triangle inequality a cell holds nothing nearer than the distance of
    its pivot less its radius.
    """
    pivots, radii, filled = cells.pivots, cells.radii, np.flatnonzero(cells.sizes)
    bounds = near.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n")).filter(F.col("n") >= k)

    @F.pandas_udf("array<int>")
    def reached(vectors: pd.Series, bound: pd.Series, own: pd.Series) -> pd.Series:
        found, numbers = [], filled.astype("int32")
        reach, home = bound.fillna(np.inf).to_numpy(), np.array([o[0] for o in own])
        for part in _sliced(vectors):
            rows = slice(len(found), len(found) + len(part))
            gap = np.sqrt(arrow.squared_distances(part, pivots[filled])) - radii[filled]
            least = np.maximum(gap - 1e-6, 0.0) ** 2
            keep = least <= reach[rows, None]
            if cutoff is not None:
                keep &= least < cutoff
            keep[filled[None, :] == home[rows, None]] = False
            found += [numbers[row] for row in keep]
        return pd.Series(found, dtype=object)

    bound = asked.drop("bound").join(bounds.select("query_id", F.col("far").alias("bound")), "query_id", "left")
    return bound.select("query_id", "embedding", "bound", reached("embedding", "bound", "cells").alias("cells"))


def pairs_compared(asked: DataFrame, cells: Cells) -> int:
    """How many distances a round over ``asked`` takes."""
    reached = asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    return sum(int(r["count"] * cells.sizes[r["cell"]]) for r in reached)


def _equal_ids(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Places (row, column) of equal ids, by row."""
    pairs = left.rename("id").rename_axis("row").reset_index().merge(right.rename("id").rename_axis("col").reset_index(), on="id")
    # a missing number equals nothing
    pairs = pairs[pairs["id"] == pairs["id"]]
    return pairs[["row", "col"]].sort_values("row").to_numpy(dtype=np.int64)


def _nearest_pairs(left: np.ndarray, right: np.ndarray, bound: np.ndarray, k: int, cutoff: float | None,
                   own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the best k columns of each row, within its bound.

    One matrix product and one comparison sort out most pairs, with room for the product's
    rounding; only the few that are left get their exact distance. ``own`` names pairs that
    don't count.
    """
    size, width = (right**2).sum(1), left.shape[1]
    wide = np.hstack([-right, size[:, None] / 2]).T
    reach = bound if cutoff is None else np.minimum(bound, cutoff)
    out, table = [], np.empty((min(len(left), SLICE_ROWS), len(right)))
    for at in range(0, len(left), SLICE_ROWS):
        part = left[at: at + SLICE_ROWS]
        # half the squared distance without the query's own half
        t = np.matmul(np.hstack([part, np.ones((len(part), 1))]), wide, out=table[:len(part)])
        if own is not None:
            pairs = own[np.searchsorted(own[:, 0], at): np.searchsorted(own[:, 0], at + len(part))]
            t[pairs[:, 0] - at, pairs[:, 1]] = np.inf
        norm = (part**2).sum(1)
        slack = 1e-9 + 4e-16 * (width + 8) * (norm + size.max())
        limit = (reach[at: at + len(part)] - norm) / 2 + slack
        hit = t <= limit[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
        if len(many) and t.shape[1] > k:
            limit[many] = np.minimum(limit[many], np.partition(t[many], k - 1, axis=1)[:, k - 1] + slack[many])
            hit[many] = t[many] <= limit[many, None]
        rows, cols = np.divmod(np.flatnonzero(hit), t.shape[1])
        # a pair that doesn't count is infinitely far, and so within no bound only
        counts = t[rows, cols] < np.inf
        rows, cols = rows[counts], cols[counts]
        pieces = [slice(i, i + PIECE_PAIRS) for i in range(0, len(rows), PIECE_PAIRS)]
        d = np.round(_joined([((part[rows[p]] - right[cols[p]]) ** 2).sum(1) for p in pieces]), 9)
        near = d <= bound[at + rows]
        if cutoff is not None:
            near &= d < cutoff
        rows, cols, d = rows[near], cols[near], d[near]
        order = np.lexsort((d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((at + rows[best], cols[best], d[best]))
    return tuple(_joined(list(x)) for x in zip(*out))


def _visited(asked: DataFrame, cells: Cells, k: int, cutoff: float | None, skip_equal_ids: bool) -> DataFrame:
    """(query_id, chunk_id, distance): the best k chunks of each block pair, within the bound.

    Cells, and the queries that visit a cell, are cut into blocks of bounded size; a block of
    chunks goes only to the query blocks of its own cell, and never hands on its pairs.
    """
    schema = ", ".join(f"{name} {frame.schema[name].dataType.simpleString()}" for frame, name in ((asked, "query_id"), (cells.placed, "chunk_id"))) + ", distance double"
    visits = asked.select("query_id", "embedding", "bound", F.explode("cells").alias("cell"))
    counted = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    if not counted:
        return asked.sparkSession.createDataFrame([], schema)
    table = lambda numbers: F.create_map(*[F.lit(int(x)) for pair in numbers.items() for x in pair])
    blocks, parts = table({c: -(-cells.sizes[c] // BLOCK_ROWS) for c in counted}), table({c: -(-n // BLOCK_ROWS) for c, n in counted.items()})
    left = (visits.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
            .withColumn("part", F.pmod(F.xxhash64("query_id"), parts[F.col("cell")].cast("long")).cast("int")))
    right = (cells.placed.filter(F.col("cell").isin(*counted)).withColumn("block", F.pmod(F.xxhash64("chunk_id"), blocks[F.col("cell")].cast("long")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1))))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": c["chunk_id"][:0], "distance": pd.Series(dtype="float64")})
        # ties go by id, so by place once chunks are in order
        q, c = q.reset_index(drop=True), c.sort_values("chunk_id", ignore_index=True)
        own = _equal_ids(q["query_id"], c["chunk_id"]) if skip_equal_ids else None
        rows, cols, d = _nearest_pairs(arrow.matrix(q["embedding"]), arrow.matrix(c["embedding"]), q["bound"].fillna(np.inf).to_numpy(), k, cutoff, own)
        hits = pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "chunk_id": c["chunk_id"].to_numpy()[cols], "distance": d})
        return hits.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id").head(k)

    keys = ["cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(queries: DataFrame, chunks: DataFrame, k: int = fv.SEARCH_DEFAULT_K, cutoff: float | None = fv.SEARCH_CUTOFF,
           skip_equal_ids: bool = False, cells: Cells | None = None) -> DataFrame:
    """Exact k nearest chunks per query by squared distance, below the cutoff.

    Chunks lie in cells around pivots (``cells``, or placed here). A query looks into its
    own cell first; what it finds there bounds its reach, and of the other cells it visits
    only those that the bound lets hold a nearer chunk. Without a cutoff this is what keeps
    a query from visiting everything. Only counts and the cell radii come to the driver.

    Ids may have any type. Distances are compared to nine decimals, so equal vectors tie
    and go by id.
    """
    k = clamp_k(k)
    cells = cells or cells_of(chunks)
    if not len(cells.pivots):
        query_kind, chunk_kind = (frame.schema[name].dataType.simpleString() for frame, name in ((queries, "query_id"), (chunks, "chunk_id")))
        return queries.sparkSession.createDataFrame([], f"query_id {query_kind}, chunk_id {chunk_kind}, distance double, rank int")
    asked = cut_lineage(own_cells(queries, cells))
    near = cut_lineage(_ranked(_visited(asked, cells, k, cutoff, skip_equal_ids), k).drop("rank"))
    more = cut_lineage(other_cells(asked, near, cells, k, cutoff))
    found = near.unionByName(_visited(more, cells, k, cutoff, skip_equal_ids))
    return _ranked(found, k).withColumn("distance", F.round("distance", 3)).select("query_id", "chunk_id", "distance", "rank")


def context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One context text per query and the classes of its hits; a query has at most eight.

    ``chunks`` is the table that ``ingest`` makes.
    """
    block = F.concat(F.lit("[Quelle: "), F.col("source"), F.lit("]\n"), F.col("chunk"))
    rows = hits.join(chunks.select("chunk_id", "source", "chunk", "classification"), "chunk_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), "classification"))).alias("_h"))
    return rows.select("query_id", F.concat(F.lit(fv.CONTEXT_HEADING), F.array_join(F.col("_h.block"), fv.CONTEXT_RULE)).alias("context"),
                       F.col("_h.classification").alias("classifications"))
