"""Sets of word shingles and their one-permutation MinHash bands, as numpy steps of a task.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z
lower-cased; a shingle is a hash of five words in a row. A text with fewer words, but at
least one, is a single shingle.
"""

from __future__ import annotations

import functools

import numpy as np

from pultwerk.llm.common import U64, mix

WORDS = 5
BINS, ROWS, BANDS = 240, 6, 40
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


@functools.cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte with A-Z folded, and whether it is white space."""
    folded = np.arange(256)
    folded[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return mix(folded.astype(U64) + U64(1)), space


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word of a text's UTF-8 bytes, from one running sum."""
    values, space = _byte_tables()
    gaps = space[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gaps, [True]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _powers(max(4096, 1 << int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(data: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = word_hashes(data)
    if not len(words):
        return words
    n_here = min(n, len(words))
    out = words[: len(words) - n_here + 1].copy()
    for i in range(1, n_here):
        out = out * U64(_STEP) + words[i: len(words) - n_here + 1 + i]
    # a short text must not equal a longer one's shingle by chance of length
    return np.unique(mix(out + U64(n_here)))


@functools.cache
def _detours(bins: int, tries: int = 512) -> np.ndarray:
    """For each bin the bins to look at, in order, when it is empty."""
    at = np.arange(bins, dtype=U64)[:, None] * U64(_STEP) + np.arange(tries, dtype=U64)[None, :] * U64(_BASE)
    return (mix(at + U64(1)) % U64(bins)).astype(np.int64)


def one_permutation(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash of each bin; empty bins borrow along a fixed random path of their own.

    Two sets follow the same path to the same bin unless their filled bins differ on the
    way, so each bin agrees with the probability of their Jaccard similarity.
    """
    bin_of = ((values >> U64(32)) * U64(bins)) >> U64(32)
    first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
    filled = np.zeros(bins, bool)
    out = np.zeros(bins, U64)
    at = bin_of[first].astype(np.int64)
    out[at], filled[at] = values[first], True
    empty = np.flatnonzero(~filled)
    ways = _detours(bins)
    step = 0
    while len(empty) and step < ways.shape[1]:
        # a few steps of all ways at once; most bins find a lender early
        hit = filled[ways[empty, step: step + 16]]
        found = hit.any(axis=1)
        at_step = step + hit[found].argmax(axis=1)
        lucky = empty[found]
        out[lucky] = mix(out[ways[lucky, at_step]] + at_step.astype(U64) + U64(1))
        empty, step = empty[~found], step + 16
    if len(empty):
        out[empty] = mix(out[at[:1]] + U64(ways.shape[1] + 1))
    return out


@functools.cache
def _weights(rows: int) -> np.ndarray:
    return mix(np.arange(rows, dtype=U64) + U64(77)) | U64(1)


def band_keys(signature: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    sums = (signature[: rows * bands].reshape(bands, rows) * _weights(rows)).sum(axis=1, dtype=U64)
    return mix(sums + np.arange(bands, dtype=U64) * U64(_BASE)).view(np.int64)


def set_key(values: np.ndarray) -> int:
    """A hash of the whole set, 0 for the empty one."""
    if not len(values):
        return 0
    sums = np.array([values.sum(dtype=U64), mix(values ^ U64(_STEP)).sum(dtype=U64)])
    return int(mix((sums * np.array([1, 3], U64)).sum(dtype=U64, keepdims=True)).view(np.int64)[0])
