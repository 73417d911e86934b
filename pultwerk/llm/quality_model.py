"""Quality classifier: random Fourier features over document statistics.

A text becomes a vector of statistics, standardised; random cosines of it approximate a
Gaussian kernel. Every partition of the labelled rows sums its part of the normal equations,
the sums are added up in two levels, and one small ridge system is solved. The sums are kept
per fold, so the scores that calibrate the model come from fits that have not seen them;
isotonic regression over a grid of raw scores turns them into probabilities.

All labelled training rows are used. What reaches the driver has a size of its own: the
means, the summed equations of each fold and a grid of at most ``GRID`` counts.

Null and empty texts are scored like any other (statistics of nothing). Labels with a null
key or value are left out; repeated labels of a key count as their mean. Without any label
every score is 0.5; with labels of one kind every score is that label. Labels, language,
source and key are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk.llm.common import slices, small_or_shuffled, spare, stored, whole_text
from pultwerk.llm.quality_rules import Text

FEATURES, RIDGE, SEED = 256, 1e-3, 20
FOLDS = (1, 2, 3, 4)
GRID = 2048
THRESHOLD = 0.3
_CLIP = 4.0


def statistics(value: str) -> list[float]:
    """Numbers that describe a text, whatever it is about."""
    text = Text(value)
    words, n = text.words, max(text.n_words, 1)
    chars, lines = max(text.word_chars, 1), text.lines
    counts = Counter(words)
    digits = sum(map(value.count, "0123456789"))
    stops = sum(map(value.count, ".,;:"))
    return [
        float(np.log1p(text.n_words)), text.word_chars / n, float(np.log1p(max(map(len, words), default=0))),
        float(np.log1p(10 * text.n_symbols / n)), text.n_symbols / chars, text.n_capitals / chars, float(np.log1p(10 * text.n_marks / n)),
        digits / chars, float(np.log1p(10 * stops / n)), text.n_repeat_words / n, len(counts) / n,
        max(counts.values(), default=0) / n, text.n_dup_lines / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))),
    ]


N_STATISTICS = 14


def fold_of(key: Column) -> Column:
    """Remainder by five of the checksum of the key as text; 0 is held out."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, vectors: np.ndarray) -> np.ndarray:
        z = np.clip((vectors - self.mean) / self.scale, -_CLIP, _CLIP)
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS)
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)])

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if len(self.raw) == 1:
            return np.full(len(vectors), self.probability[0])
        return np.interp(self.features(vectors) @ self.weights, self.raw, self.probability)


def _constant(value: float) -> Model:
    return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(FEATURES + 1), np.zeros(1), np.array([value]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATISTICS)


def labelled(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(fold, y, x) of all labelled rows that are not held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = stored(known.withColumn("fold", fold_of(F.col(key))).where("fold <> 0"), "labels")
    rows = docs.select(F.col(key), whole_text().alias("text")).join(small_or_shuffled(known), key).select("fold", "y", "text")

    def run(batches):
        for batch in slices(batches, 512):
            x = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["fold", "y", "x"])

    return stored(rows.mapInArrow(run, "fold int, y double, x array<double>"), "statistics")


def _equations(rows: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Per fold the summed matrix [features, y] x [features, y]; its size is fixed."""
    side = FEATURES + 2

    def part_sums(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = np.hstack([model.features(_matrix(batch.column(2))), y[:, None]])
            for fold in np.unique(folds):
                mine = z[folds == fold]
                sums[int(fold)] = sums.get(int(fold), np.zeros((side, side))) + mine.T @ mine
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "part", "sums"])

    def added(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for fold, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                sums[fold, part] = sums.get((fold, part), 0) + np.frombuffer(blob)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "part", "sums"])

    schema = "fold int, part int, sums binary"
    level = rows.mapInArrow(part_sums, schema).repartition("fold", "part").mapInArrow(added, schema)
    level = level.withColumn("part", F.lit(0)).repartition("fold").mapInArrow(added, schema)
    return {r["fold"]: np.frombuffer(r["sums"]).reshape(side, side) for r in level.collect()}


def _solved(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:-1, :-1], sums[:-1, -1]
    ridge = RIDGE * max(a[0, 0], 1.0) * np.eye(len(a)) / len(a)
    return np.linalg.solve(a + ridge + 1e-9 * np.eye(len(a)), b)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ascending grid points with label sums and counts."""
    pools: list[list[float]] = []
    for at, t, n in zip(x, total, count):
        pools.append([at, at, t, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            first, last = pools[-2], pools.pop()
            pools[-1] = [first[0], last[1], first[2] + last[2], first[3] + last[3]]
    points = [(edge, t / n) for low, high, t, n in pools for edge in ((low, high) if high > low else (low,))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    rows = labelled(docs, labels, key, label)
    moments = [f(F.col("x")[i]) for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), *moments).first()
    if not first[0] or first[1] == first[2]:
        return _constant(float(first[1]) if first[0] else 0.5)
    mean, scale = np.array(first[3::2]), np.array(first[4::2])
    base = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(2), np.zeros(2))
    equations = _equations(rows, base)
    whole = sum(equations.values())
    # a fold that holds everything can't be left out
    unseen = {fold: _solved(whole - sums if len(equations) > 1 else whole) for fold, sums in equations.items()}

    def graded(batches):
        for batch in batches:
            folds, z = batch.column(0).to_numpy(), base.features(_matrix(batch.column(2)))
            raw = (z * np.array([unseen[int(f)] for f in folds]).reshape(len(z), z.shape[1])).sum(axis=1)
            step = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) * (GRID / 2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], names=["step", "y"])

    grid = rows.mapInArrow(graded, "step long, y double").groupBy("step").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    raw, probability = isotonic(np.array([r["step"] / (GRID / 2) - 0.5 for r in grid]), np.array([r["t"] for r in grid]), np.array([r["n"] for r in grid], float))
    return Model(base.mean, base.scale, _solved(whole), raw, probability)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns with ``score`` and ``predicted`` (1 from the threshold on)."""
    kept = [c for c in docs.columns if c not in {"score", "predicted"}]
    rows = docs.select(*kept, whole_text(text).alias(spare(kept, "whole")))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", score double, predicted int"

    def run(batches):
        for batch in slices(batches, 512):
            x = np.array([statistics(t.as_py()) for t in batch.column(len(kept))]).reshape(batch.num_rows, N_STATISTICS)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents that the classifier takes for good ones, with their columns."""
    return scored(docs, fit(docs, labels, key, label)).where("predicted = 1").select(*docs.columns)
