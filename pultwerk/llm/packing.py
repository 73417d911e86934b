"""Mixture-controlled packing: source queues served by deficit, cut into equal windows.

Every source is a queue of tokens. In each round a queue earns credit in proportion to its
weight and hands out a token whenever its credit reaches a whole one; what is left is the
deficit it carries on, over window borders as well. So the tokens come in the order of
(position + 1) / weight, and the number of tokens that a queue has handed out before any
window follows from the weights and queue lengths alone (``Mixture.taken``). No task has
to wait for another: a partition only needs to know where its part of each queue begins.
A queue that runs dry leaves its share to the others, so every window but the last is full.

Within a window the tokens of a queue lie together, in queue order.

Null texts are empty documents, null sources are a queue of their own, repeated rows are
documents of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pultwerk.llm.common import queue_key, slices, small_or_shuffled, stored, whole_text

WINDOW = 2048
# windows whose borders a task holds at a time
BLOCK = 4096
# bits that weights are rounded to at most; products with token counts must fit in 62
WEIGHT_BITS = 18

# the vocabulary's own split and the same without look-ahead, which is right (and twice as
# fast) for texts in which no two white-space characters meet
_PLAIN_SPLIT = r" ?\p{L}+|'(?:[sdmt]|ll|ve|re)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_DOUBLE_SPACE = re.compile(r"\s\s")


@functools.cache
def encoders(path: str, special: tuple[tuple[str, int], ...] = ()):
    """(encoder, encoder for texts without double white space) of a ranks file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    make = lambda name, split: tiktoken.Encoding(name, pat_str=split, mergeable_ranks=ranks, special_tokens=dict(special))
    return make("whole", public_tokenizers.PATTERN), make("plain", _PLAIN_SPLIT)


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of a tokenizer's json; such strings are matched in texts."""
    with open(path, encoding="utf-8") as file:
        return tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])


def encode(text: str, path: str, special: tuple[tuple[str, int], ...] = ()) -> np.ndarray:
    whole, plain = encoders(path, special)
    coder = whole if _DOUBLE_SPACE.search(text) else plain
    # texts without a special string, nearly all, take the faster call
    if any(token in text for token, _ in special):
        return np.array(coder.encode(text, allowed_special="all"), dtype="<u4")
    return np.array(coder.encode_ordinary(text), dtype="<u4")


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, key: str, source: str, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per document with its ids, its queue and its place in the part's queue.

    ``part`` is the scan task; ``part_start`` counts the tokens of the same queue that the
    task met before. The table is written, so both stay as they are.
    """
    rows = docs.select(F.col(key), queue_key(F.col(source)).alias("queue"), whole_text().alias("text"))

    def run(batches):
        part, before = TaskContext.get().partitionId(), {}
        for batch in slices(batches, 256):
            starts, counts, blobs = [], [], []
            queues = batch.column(1).to_pylist()
            for queue, text in zip(queues, batch.column(2)):
                ids = np.append(encode(text.as_py(), vocabulary, special), np.uint32(end_id))
                start = before.get(queue, 0)
                starts.append(start)
                counts.append(len(ids))
                blobs.append(ids.astype("<u2" if ids.max() < 65536 else "<u4").tobytes())
                before[queue] = start + len(ids)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([part] * len(starts), pa.int64()), pa.array(starts, pa.int64()),
                pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()),
            ], names=[key, "queue", "part", "part_start", "n_tokens", "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"`{key}` {kind}, queue string, part long, part_start long, n_tokens long, ids binary"), "tokens")


class Mixture:
    """Where each queue stands after any number of tokens handed out."""

    def __init__(self, weights: list[float], totals: list[int]):
        # a weight is multiplied with up to all tokens of all queues
        bits = max(0, min(WEIGHT_BITS, 62 - max(1, sum(int(t) for t in totals).bit_length())))
        top = max(weights, default=1.0)
        self.weights = np.maximum(1, np.rint(np.array(weights, dtype=float) / top * (1 << bits))).astype(np.int64)
        self.totals = np.array(totals, dtype=np.int64)
        self.total = int(self.totals.sum())
        # queues in the order in which they run dry, and the tokens handed out by then
        self._dry = np.argsort(self.totals / self.weights, kind="stable")
        ends = (self.totals / self.weights)[self._dry]
        self._handed = np.array([np.minimum(self.totals, self.weights * e).sum() for e in ends])

    def taken(self, handed: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first ``handed`` ones; a row per number asked."""
        handed = np.minimum(np.asarray(handed, dtype=np.int64), self.total)
        n_dry = np.searchsorted(self._handed, handed, side="right")
        out = np.empty((len(handed), len(self.totals)), dtype=np.int64)
        for k in np.unique(n_dry):
            rows = n_dry == k
            dry, live = self._dry[:k], self._dry[k:]
            out[np.ix_(rows, dry)] = self.totals[dry]
            left = handed[rows] - self.totals[dry].sum()
            if len(live):
                share = left[:, None] * self.weights[live] // self.weights[live].sum()
                out[np.ix_(rows, live)] = np.clip(share, 0, self.totals[live])
        while (open_rows := np.flatnonzero(out.sum(axis=1) < handed)).size:
            mine = out[open_rows]
            next_at = np.where(mine < self.totals, (mine + 1) / self.weights, np.inf)
            out[open_rows, next_at.argmin(axis=1)] += 1
        while (open_rows := np.flatnonzero(out.sum(axis=1) > handed)).size:
            mine = out[open_rows]
            last_at = np.where(mine > 0, mine / self.weights, -np.inf)
            out[open_rows, mine.shape[1] - 1 - last_at[:, ::-1].argmax(axis=1)] -= 1
        return out

    def about(self, queue: int, position: int) -> int:
        """Tokens handed out, near enough, when a queue reaches a position."""
        at = position / self.weights[queue]
        return int(np.minimum(self.totals, self.weights * at).sum())


def cut(mixture: Mixture, queue: int, starts: np.ndarray, ends: np.ndarray, window: int):
    """Pieces of documents that follow each other in a queue.

    Returns document number, first and last queue position, sequence and offset of each.
    """
    slack = len(mixture.totals) // window + 2
    first = max(0, mixture.about(queue, int(starts[0])) // window - slack)
    last = mixture.about(queue, int(ends[-1])) // window + slack + 1
    found = []
    # few rows of a queue may span all windows, so these are walked in blocks
    for low in range(first, last, BLOCK):
        windows = np.arange(low, min(low + BLOCK, last) + 1, dtype=np.int64)
        borders = mixture.taken(windows * window)
        mine = borders[:, queue]
        quota = np.diff(borders, axis=0)
        offsets = np.cumsum(quota, axis=1)[:, queue] - quota[:, queue]
        here = starts[np.searchsorted(starts, mine[0]): np.searchsorted(starts, mine[-1])]
        cuts = np.unique(np.concatenate([here, mine[(mine > starts[0]) & (mine < ends[-1]) & (mine < mine[-1])]]))
        at = np.searchsorted(mine, cuts, side="right") - 1
        found.append((cuts, windows[at], offsets[at] + cuts - mine[at]))
    cuts, sequence, offset = (np.concatenate(c) for c in zip(*found))
    stops = np.append(cuts[1:], ends[-1])
    doc = np.searchsorted(starts, cuts, side="right") - 1
    return doc, cuts, stops, sequence, offset


def pack(
    docs: DataFrame, vocabulary: str, targets: dict[str | None, float] | None = None, window: int = WINDOW,
    end_id: int = 1, key: str = "doc_id", source: str = "source", special: tuple[tuple[str, int], ...] = (), temper: float = 1.0,
) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens.

    ``targets`` gives the token proportions of the sources (a source it leaves out gets the
    smallest of them); without it the proportions are the sources' token counts to the power
    ``temper``: 1 mixes as the corpus is, 0.5 gives small sources more than their share for as
    long as they last, 0 treats all alike.
    Strings of ``special`` tokens in a text become their ids, without it they are ordinary text.
    The number of sources is that of the mixture's own list, so totals go to the driver and a
    task holds ``BLOCK`` borders of every source: a mixture has hundreds of sources, not one per
    document (group rare ones under one name before packing).

    Columns: the key, source queue, start, length, doc_tokens, sequence_id, offset and the
    piece's ids as little-endian unsigned 32-bit numbers.
    """
    tokens = tokenised(docs, vocabulary, end_id, key, source, special)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per scan task and queue
    bases = parts.select("queue", "part", F.coalesce(before, F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in tokens.groupBy("queue").agg(F.sum("n_tokens").alias("n")).collect()}
    queues = sorted(totals)
    if targets is None:
        weights = [float(totals[q]) ** temper for q in queues]
    else:
        named = {"null" if s is None else f"={s}": w for s, w in targets.items()}
        least = min((w for w in named.values() if w > 0), default=1.0)
        weights = [named.get(q) or least for q in queues]
    mixture, number = Mixture(weights, [totals[q] for q in queues]), {q: i for i, q in enumerate(queues)}

    def run(batches):
        for batch in slices(batches, 1024):
            found = []
            names = np.array([number[q] for q in batch.column(1).to_pylist()], dtype=np.int64)
            start, count = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for queue in np.unique(names):
                rows = np.flatnonzero(names == queue)
                rows = rows[np.argsort(start[rows], kind="stable")]
                ids = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype("<u4") for b, n in zip(batch.column(4).take(pa.array(rows)).to_pylist(), count[rows])]
                # documents of a queue follow each other unless a batch of another part comes between
                breaks = np.flatnonzero(start[rows][1:] != (start[rows] + count[rows])[:-1]) + 1
                for group in np.split(np.arange(len(rows)), breaks):
                    starts = start[rows[group]]
                    doc, a, b, sequence, offset = cut(mixture, int(queue), starts, starts + count[rows[group]], window)
                    a, b = a - starts[doc], b - starts[doc]
                    blobs = [ids[group[d]][x:y].tobytes() for d, x, y in zip(doc, a, b)]
                    found.append((rows[group][doc], a, b - a, sequence, offset, blobs))
            at, start_of, length, sequence, offset = (np.concatenate(c) for c in list(zip(*found))[:5])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take), pa.array(start_of), pa.array(length), batch.column(3).take(take),
                pa.array(sequence), pa.array(offset), pa.array([x for f in found for x in f[5]], pa.binary()),
            ], names=[key, "queue", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    # sent to all tasks if small, so that the ids need not move
    placed = tokens.join(small_or_shuffled(stored(bases, "bases")), ["queue", "part"]).select(key, "queue", (F.col("base") + F.col("part_start")).alias("_start"), "n_tokens", "ids")
    kind = tokens.schema[key].dataType.simpleString()
    return placed.mapInArrow(run, f"`{key}` {kind}, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
