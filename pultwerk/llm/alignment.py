"""Alignment of two tokenizers over the same bytes.

The tokens of both sides tile one string of bytes, so each side is a sparse incidence
matrix: tokens x bytes, in compressed sparse rows built by hand. Gustavson's row products
A * B^T give the overlap links, with the number of shared bytes as value. Where a token of
both sides ends a group ends; tokens x groups is a second incidence matrix per side, whose
product links all tokens of a group. A batch of documents is one block-diagonal matrix.

A side: the byte-level vocabulary over a space and the text. B side: the piece vocabulary
over the text. Special tokens' strings inside texts are plain text. Texts that are null or
empty, or of which one side's bytes are not the space and the text (a normalised
character), have no tokens.

How often an id pair is linked is counted over the whole corpus: per document first, then
by pair. Repeated rows are documents of their own, null keys too; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.llm.common import slices, small_or_shuffled, stored, whole_text
from pultwerk.llm.packing import encode

# bytes of text that are multiplied at once; a longer text is a batch of its own
TOGETHER = 1 << 18
# products of a token matrix that are held at once
PRODUCTS = 1 << 20


@dataclass
class Rows:
    """Compressed sparse rows: row i has the columns indices[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray


def incidence(sizes: np.ndarray) -> Rows:
    """Tokens x bytes of tokens that tile the bytes: each has the next ``size`` columns."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return Rows(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int32))


def members(labels: np.ndarray) -> Rows:
    """Tokens x groups: a single column per row."""
    return Rows(np.arange(len(labels) + 1), labels, np.ones(len(labels), np.int32))


def transposed(m: Rows, columns: int) -> Rows:
    """Columns become rows, by a counting sort."""
    counts = np.bincount(m.indices, minlength=columns)
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = np.argsort(m.indices, kind="stable")
    return Rows(np.concatenate([[0], np.cumsum(counts)]), rows[order], m.values[order])


def product(a: Rows, b: Rows) -> Rows:
    """a * b row by row: the rows of b that a row of a names, scaled and added up."""
    picked = b.starts[a.indices + 1] - b.starts[a.indices]
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), picked)
    before = np.cumsum(picked) - picked
    at = np.arange(picked.sum()) + np.repeat(b.starts[a.indices] - before, picked)
    column, value = b.indices[at], np.repeat(a.values, picked) * b.values[at]
    step = np.flatnonzero((row[1:] != row[:-1]) | (column[1:] < column[:-1]))
    if np.any(row[step] == row[step + 1]):
        order = np.lexsort((column, row))
        row, column, value = row[order], column[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (column[1:] != column[:-1])])) if len(row) else np.zeros(0, np.int64)
    summed = np.add.reduceat(value, new) if len(new) else value
    starts = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(a.starts) - 1))])
    return Rows(starts, column[new], summed)


def row_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Products in each row of a * b, before they are added up."""
    picked = np.concatenate([[0], np.cumsum(b.starts[a.indices + 1] - b.starts[a.indices])])
    return picked[a.starts[1:]] - picked[a.starts[:-1]]


def blocks(a: Rows, b: Rows, limit: int = PRODUCTS):
    """(first row, a * b) over runs of rows of a with about ``limit`` products each.

    A row is never cut, so a block holds at most ``limit`` and one row more.
    """
    done = np.concatenate([[0], np.cumsum(row_sizes(a, b))])
    lo, n = 0, len(a.starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + limit, side="right")) - 1)
        s, e = a.starts[lo], a.starts[hi]
        yield lo, product(Rows(a.starts[lo: hi + 1] - s, a.indices[s:e], a.values[s:e]), b)
        lo = hi


@functools.cache
def token_bytes(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes and byte counts by id of a ranks file."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    table = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    return table, np.array([len(t) for t in table], np.int64)


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@functools.cache
def pieces(path: str):
    """(processor, bytes by id, byte counts by id) of a piece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())]
    return model, table, np.array([len(t) for t in table], np.int64)


@functools.cache
def _decimal(n: int) -> np.ndarray:
    """Every id in decimal with each of the three signs that may follow it."""
    return np.array([f"{i}{sign}" for i in range(n) for sign in ",|;"], dtype=object)


def _ids_of(texts: list[str], ranks: str, model_path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both sides' ids of every text; empty where the bytes are not the space and the text."""
    _, a_sizes = token_bytes(ranks)
    model, b_bytes, _ = pieces(model_path)
    none, out = np.zeros(0, np.int64), []
    for text, b in zip(texts, model.encode(texts, num_threads=1) if texts else []):
        found = (none, none)
        if text:
            whole = b" " + text.encode()
            if b"".join([b_bytes[i] for i in b]) == whole:
                a = encode(" " + text, ranks)
                # byte-level tokens are cut out of the text itself, so their sizes say enough
                if a_sizes[a].sum() == len(whole):
                    found = (a.astype(np.int64), np.array(b, np.int64))
        out.append(found)
    return out


@dataclass
class Aligned:
    """Tokens of a batch of documents and what links them.

    ``a``, ``b``: ids; ``a_doc``, ``b_doc``: tokens per document; ``a_group``, ``b_group``:
    group of each token, counted through the batch; ``a_matrix``, ``b_matrix``: bytes.
    """

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_matrix: Rows
    b_matrix: Rows

    @property
    def n_groups(self) -> int:
        return int(self.a_group[-1]) + 1 if len(self.a_group) else 0

    def overlaps(self):
        """Blocks of the links of tokens that share bytes."""
        return blocks(self.a_matrix, transposed(self.b_matrix, self.b_matrix.starts[-1]))

    def shared_groups(self):
        """Blocks of the links of tokens that share a group."""
        return blocks(members(self.a_group), transposed(members(self.b_group), self.n_groups))

    def n_shared_groups(self) -> np.ndarray:
        """Shared-group links per document, from the sizes of the row products."""
        sizes = row_sizes(members(self.a_group), transposed(members(self.b_group), self.n_groups))
        return np.bincount(np.repeat(np.arange(len(self.a_doc)), self.a_doc), weights=sizes, minlength=len(self.a_doc)).astype(np.int64)


def align(ids: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Both sides of a batch as matrices over the bytes of all its documents."""
    a, b = (np.concatenate([pair[side] for pair in ids]) if ids else np.zeros(0, np.int64) for side in (0, 1))
    a_matrix, b_matrix = incidence(a_sizes[a]), incidence(b_sizes[b])
    a_ends, b_ends = a_matrix.starts[1:], b_matrix.starts[1:]
    ends = a_ends[b_ends[np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)] == a_ends] if len(b_ends) else a_ends
    # a token belongs to the group whose end is the first at or after its own
    a_group, b_group = (np.searchsorted(ends, m.starts[1:]) for m in (a_matrix, b_matrix))
    counts = lambda side: np.array([len(pair[side]) for pair in ids], np.int64)
    return Aligned(a, b, counts(0), counts(1), a_group, b_group, a_matrix, b_matrix)


def link_counts(batch: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of the overlap links, ascending; a pair is a * 2^32 + b."""
    doc_of = np.repeat(np.arange(len(batch.a_doc)), batch.a_doc)
    # ids of the batch by rank, so that document and pair are one number to sort by
    a_ids, a_rank = np.unique(batch.a, return_inverse=True)
    b_ids, b_rank = np.unique(batch.b, return_inverse=True)
    keys = [np.zeros(0, np.int64)]
    for first, links in batch.overlaps():
        row = first + np.repeat(np.arange(len(links.starts) - 1), np.diff(links.starts))
        keys.append((doc_of[row] * len(a_ids) + a_rank[row]) * len(b_ids) + b_rank[links.indices])
    found, times = np.unique(np.concatenate(keys), return_counts=True)
    left, b = np.divmod(found, max(len(b_ids), 1))
    doc, a = np.divmod(left, max(len(a_ids), 1))
    return doc, (a_ids[a] << 32) + b_ids[b], times


def group_texts(batch: Aligned, vocabulary: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document: the ids of its groups in order."""
    n_a, n_b = len(batch.a), len(batch.b)
    # a token's place among both sides' tokens: those of earlier groups come before it, and
    # the A tokens of its own group before a B token
    a_at = np.arange(n_a) + np.searchsorted(batch.b_group, batch.a_group, side="left")
    b_at = np.arange(n_b) + np.searchsorted(batch.a_group, batch.b_group, side="right")
    last = lambda group: np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
    signed, words = np.empty(n_a + n_b, np.int64), _decimal(vocabulary)
    signed[a_at] = batch.a * 3 + last(batch.a_group)
    signed[b_at] = batch.b * 3 + 2 * last(batch.b_group)
    pieces_ = words[signed].tolist()
    borders = np.concatenate([[0], np.cumsum(batch.a_doc + batch.b_doc)]).tolist()
    return ["".join(pieces_[lo:hi])[:-1] for lo, hi in zip(borders, borders[1:])]


def _batches(texts: list[str]):
    """Runs of texts of about ``TOGETHER`` characters."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def aligned(docs: DataFrame, ranks: str, model_path: str, key: str = "doc_id") -> DataFrame:
    """A row per document, written: doc, n_a, n_b, n_groups, n_links, n_group_links,
    groups_sha256, and its overlap links as pairs with the number of times."""
    rows = docs.select(F.col(key).alias("doc"), whole_text().alias("text"))

    def run(batches):
        a_sizes, b_sizes = token_bytes(ranks)[1], pieces(model_path)[2]
        vocabulary = max(len(a_sizes), len(b_sizes))
        for batch in slices(batches, 128):
            at = 0
            for texts in _batches(batch.column(1).to_pylist()):
                ids = _ids_of(texts, ranks, model_path)
                found = align(ids, a_sizes, b_sizes)
                doc, pair, times = link_counts(found)
                n = len(ids)
                borders = np.searchsorted(doc, np.arange(n + 1))
                shas = [hashlib.sha256(text.encode("ascii")).hexdigest() if text else "" for text in group_texts(found, vocabulary)]
                # no group reaches over the end of its document
                ends = np.cumsum(found.a_doc)
                groups = np.diff(np.concatenate([[0], np.append(found.a_group, -1)[ends - 1] + 1])) if len(found.a) else np.zeros(n, np.int64)
                links = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
                offsets = pa.array(borders, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array(found.a_doc), pa.array(found.b_doc), pa.array(groups, pa.int64()), pa.array(links),
                    pa.array(found.n_shared_groups()), pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                ], names=["doc", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "pairs", "times"])
                at += n

    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc {kind}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _links(found: DataFrame, *columns: str) -> DataFrame:
    links = found.select(*columns, F.explode_outer(F.arrays_zip("pairs", "times")).alias("l"))
    return links.select(*columns, F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair in the corpus; best among those of its B id.

    At most one row per pair of vocabulary entries; a B id has at most as many as A has ids.
    """
    counted = stored(_links(found).where("pair IS NOT NULL").groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return stored(counted.withColumn("b", b).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` rows with n_best and count_sum; ``counts`` is sent to all tasks if its
    size allows it, else joined by pair, hot pairs being split by the adaptive join."""
    kept = [c for c in found.columns if c not in ("pairs", "times")]
    joined = _links(found, *kept).join(small_or_shuffled(counts), "pair", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.groupBy(*kept).agg(zero(F.when(F.col("best"), F.col("times"))).alias("n_best"), zero(F.col("times") * F.col("n")).alias("count_sum"))


def aligned_and_scored(docs: DataFrame, ranks: str, model_path: str, key: str = "doc_id") -> DataFrame:
    found = aligned(docs, ranks, model_path, key)
    return scored(found, pair_counts(found))


def pair_links(docs: DataFrame, ranks: str, model_path: str, key: str = "doc_id", shared_groups: bool = False) -> DataFrame:
    """(doc, a_at, b_at, a_id, b_id, weight): every link, token by token.

    The weight is the number of shared bytes, for ``shared_groups`` 1. Links leave a task in
    blocks, so a long group is never held at once.
    """
    rows = docs.select(F.col(key).alias("doc"), whole_text().alias("text"))

    def run(batches):
        a_sizes, b_sizes = token_bytes(ranks)[1], pieces(model_path)[2]
        for batch in slices(batches, 1):
            found = align(_ids_of(batch.column(1).to_pylist(), ranks, model_path), a_sizes, b_sizes)
            for first, links in found.shared_groups() if shared_groups else found.overlaps():
                row = first + np.repeat(np.arange(len(links.starts) - 1), np.diff(links.starts))
                for at in range(0, len(row), 1 << 16):
                    r, c, w = row[at: at + (1 << 16)], links.indices[at: at + (1 << 16)], links.values[at: at + (1 << 16)]
                    doc = batch.column(0).take(pa.array(np.zeros(len(r), np.int64)))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(r), pa.array(c), pa.array(found.a[r]), pa.array(found.b[c]), pa.array(w.astype(np.int64))], names=["doc", "a_at", "b_at", "a_id", "b_id", "weight"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, a_at long, b_at long, a_id long, b_id long, weight long")
