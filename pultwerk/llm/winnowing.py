"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every window of ``w`` neighbouring hashes
the smallest is chosen, the rightmost of equals, and kept with its position. Any passage of
w + k - 1 code points that two texts share gives at least one common choice.

A text shorter than k is one gram; a text with fewer than w grams is one window; an empty
text has an empty fingerprint. Null texts are empty. Two empty fingerprints are alike (1),
an empty and another are not (0).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pultwerk.llm.common import U64, mix, whole_text

# a shared passage of 27 code points is found: half of a text of 54
K, W = 12, 16
BASE = 0x9E3779B97F4A7C15
# hash bits compared inside a window; the low bits of the comparison hold the position
_POSITION_BITS = 24
_SEGMENT = (1 << _POSITION_BITS) - 2 * 4096


@functools.cache
def _power(n: int) -> np.uint64:
    return U64(pow(BASE, n, 1 << 64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k-gram: a polynomial built from halves, then mixed."""
    k = min(k, len(points))
    if k == 0:
        return np.zeros(0, U64)
    size, block, out, have = 1, mix(points.astype(U64) + U64(1)), None, 0
    while True:
        if k & size:
            # what is built so far is followed by a block of ``size`` characters
            if out is None:
                out = block
            else:
                n = min(len(out), len(block) - have)
                out = out[:n] * _power(size) + block[have: have + n]
            have += size
        size *= 2
        if size > k:
            break
        half = size // 2
        block = block[:-half] * _power(half) + block[half:]
    return mix(out[: len(points) - k + 1])


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, keys
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions chosen, ascending."""
    w = min(w, len(hashes))
    if w == 0:
        return np.zeros(0, np.int64)
    chosen = []
    for start in range(0, len(hashes) - w + 1, _SEGMENT):
        part = hashes[start: start + _SEGMENT + w - 1]
        back = U64((1 << _POSITION_BITS) - 1) - np.arange(len(part), dtype=U64)
        keys = (part & U64(~((1 << _POSITION_BITS) - 1) & 0xFFFFFFFFFFFFFFFF)) | back
        minima = _window_minima(keys, w)
        new = np.append(True, minima[1:] != minima[:-1])
        chosen.append(start + (1 << _POSITION_BITS) - 1 - (minima[new] & U64((1 << _POSITION_BITS) - 1)).astype(np.int64))
    return np.unique(np.concatenate(chosen))


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen grams; hashes are those compared, low bits cleared."""
    hashes = gram_hashes(code_points(text), k)
    at = winnow(hashes, w)
    return at, hashes[at] >> U64(_POSITION_BITS)


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Position (8 hex digits) and hash (10) of each choice, one after the other."""
    at, hashes = print_
    out = np.empty((len(at), 9), np.uint8)
    out[:, :4] = at.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return out.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared distinct hashes over the mean number of distinct hashes."""
    x, y = np.unique(a[1]), np.unique(b[1])
    if not len(x) and not len(y):
        return 1.0
    return 2 * len(np.intersect1d(x, y, assume_unique=True)) / (len(x) + len(y))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, key: str = "doc_id", k: int = K, w: int = W) -> DataFrame:
    """Key, positions and hashes of every text."""
    rows = docs.select(F.col(key), whole_text().alias("text"))

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), k, w) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([p[0] for p in prints], pa.list_(pa.int64())), pa.array([p[1].astype(np.int64) for p in prints], pa.list_(pa.int64())),
            ], names=[key, "positions", "hashes"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, positions array<long>, hashes array<long>")


_RESULT = "n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, own, following: str, other, k: int, w: int) -> tuple:
    changed = edited(text, following)
    new = fingerprint(changed, k, w)
    return len(text), changed, written(own), written(new), likeness(own, new), likeness(own, other)


def key_ranges(docs: DataFrame, key: str, n_ranges: int):
    """Adds ``_range``, a number that ascends with the numeric key; null keys come first.

    Borders are approximate quantiles of all keys, so the ranges hold about equally many
    rows; they are constants of the plan, so a repeated task puts every row where it was.
    """
    number = F.col(key).cast("double")
    splits = sorted(set(docs.select(number.alias("_n")).approxQuantile("_n", [i / n_ranges for i in range(1, n_ranges)], 0.1 / n_ranges))) if n_ranges > 1 else []
    bucketizer = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_n", outputCol="_range")
    # splits need three borders at least
    if not splits:
        return docs.withColumn("_range", F.lit(0))
    ranged = bucketizer.transform(docs.withColumn("_n", F.coalesce(number, F.lit(-float("inf")))))
    return ranged.withColumn("_range", F.col("_range").cast("int")).drop("_n")


def next_compared(docs: DataFrame, key: str = "doc_id", k: int = K, w: int = W) -> DataFrame:
    """Compares each text with its edited form and with the next document by ascending key.

    Texts move once, into key ranges; the first document of every range also goes to the
    range before it, that of the first range to the last one, as the last document is
    followed by the first. Rows of equal keys go by the hash of their text. Keys are numbers
    (another type is a TypeError), told apart up to 2^53.
    """
    if not isinstance(docs.schema[key].dataType, NumericType):
        raise TypeError(f"{key} must be a number to have a next document")
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = key_ranges(docs.select(F.col(key), whole_text().alias("text")), key, 4 * tasks)
    kind = rows.schema[key].dataType.simpleString()
    # two numbers per range; the ranges are a few times the tasks
    least = sorted((r["_range"], r["least"]) for r in rows.groupBy("_range").agg(F.min(F.coalesce(F.col(key).cast("double"), F.lit(-float("inf")))).alias("least")).collect())
    before = [least[i - 1][0] for i in range(len(least))]
    firsts = spark.createDataFrame([(r, p, v) for (r, v), p in zip(least, before)], "_range int, _before int, _least double")
    heads = rows.join(F.broadcast(firsts), "_range").where(F.coalesce(F.col(key).cast("double"), F.lit(-float("inf"))) == F.col("_least"))
    followers = heads.groupBy("_before").agg(F.min(F.struct(F.xxhash64("text"), "text", key)).alias("f")).select(F.col(f"f.{key}").alias(key), "f.text", F.col("_before").alias("_range"), F.lit(1).alias("_copy"))
    dealt = rows.withColumn("_copy", F.lit(0)).unionByName(followers).repartition(tasks, "_range")
    ordered = dealt.withColumn("_tie", F.xxhash64("text")).sortWithinPartitions("_range", "_copy", F.col(key).asc_nulls_first(), "_tie").select(key, "text", "_range", "_copy")
    names = [key, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def walk(batches):
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, ranges, copies = (batch.column(i).to_pylist() for i in (1, 2, 3))
                keys, results = [], []
                for i, (text, place, copy) in enumerate(zip(texts, ranges, copies)):
                    own = fingerprint(text, k, w)
                    if held is not None and held[3] == place:
                        keys.append(held[0])
                        results.append(_compared(held[1], held[2], text, own, k, w))
                    held = None if copy else (batch.column(0)[i], text, own, place)
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in keys], batch.column(0).type), *[pa.array([r[i] for r in results], t) for i, t in enumerate(types)]], names=names)

    return ordered.mapInArrow(walk, f"`{key}` {kind}, {_RESULT}")
