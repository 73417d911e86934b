"""The few Arrow functions: work that needs a loop or a library inside a task.

Each takes whole batches, returns compact values and leaves everything else to Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pultwerk import fixed_values as fv

_INT, _TEXT = T.IntegerType(), T.StringType()
_TEXTS = T.ArrayType(_TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# type objects, not DDL text: this module may be imported before there is a session
SPANS = T.ArrayType(_struct(start=_INT, end=_INT))
CODES = T.ArrayType(T.ArrayType(_INT))
MARKUP = _struct(text=_TEXT, alternatives=T.ArrayType(_struct(token=_INT, options=_TEXTS)), deleted=_TEXTS, unclear=_INT, markers=_TEXTS)


def _once(udf):
    """Keeps the planner from copying a Python step into every expression that reads it.

    The functions are pure; this only makes their result a column that is computed once.
    """
    return udf.asNondeterministic()


def _spans(text: str) -> Iterator[tuple[int, int]]:
    """Chunk borders; every border depends on the one before, hence the loop."""
    size, start, end = len(text), 0, 0
    while end < size:
        end = min(start + fv.CHUNK_CHARS, size)
        if end < size:
            found = [(text.rfind(s, start + fv.CHUNK_OVERLAP, end), len(s)) for s in fv.CHUNK_SEPARATORS]
            end = next((at + width for at, width in found if at >= 0), end)
        yield start, end
        start = max(end - fv.CHUNK_OVERLAP, start + 1)


@_once
@F.pandas_udf(SPANS)
def chunk_spans(texts: pd.Series) -> pd.Series:
    """Start and end of each chunk in code points; the JVM cuts the text itself."""
    return texts.map(lambda t: [] if t is None else [{"start": a, "end": b} for a, b in _spans(t)])


SEPARATOR = "\x00"


@_once
@F.pandas_udf(_TEXT)
def fold(texts: pd.Series) -> pd.Series:
    """NFKC and full case folding; neither is built in (``lower`` keeps ß).

    Tokens come joined by a separator that both steps leave alone, so that one string per
    row crosses to Python and back instead of a list.
    """
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _longest(ref: list, other: list, at: dict, r0: int, r1: int, o0: int, o1: int) -> tuple[int, int, int]:
    """First longest common run inside two ranges: by place in ``ref``, then in ``other``.

    Only the first pair of a run is followed, and no run that is too near the end to win.
    """
    best_r, best_o, best = r0, o0, 0
    for i in range(r0, r1):
        if r1 - i <= best:
            break
        token = ref[i]
        for j in at.get(token, ()):
            if j < o0:
                continue
            if o1 - j <= best:
                break
            if i > r0 and j > o0 and ref[i - 1] == other[j - 1]:
                continue
            end, room = 1, min(r1 - i, o1 - j)
            while end < room and ref[i + end] == other[j + end]:
                end += 1
            if end > best:
                best_r, best_o, best = i, j, end
    return best_r, best_o, best


def _ordered_runs(ref: list, at: dict) -> list[tuple[int, int, int]] | None:
    """All common runs, if every common token stands once in both and in the same order.

    No run can then rule another one out, whichever is the longest. None otherwise.
    """
    runs, first_i, first_j, behind_i, behind_j = [], 0, 0, 0, 0
    for i, token in enumerate(ref):
        places = at.get(token)
        if places is None:
            continue
        j = places[0]
        if len(places) > 1 or j < behind_j:
            return None
        if i != behind_i or j != behind_j:
            runs.append((first_i, first_j, behind_i - first_i))
            first_i, first_j = i, j
        behind_i, behind_j = i + 1, j + 1
    runs.append((first_i, first_j, behind_i - first_i))
    return [run for run in runs if run[2]]


def _codes(ref: list[str], other: list[str]) -> list[int]:
    """Opcodes of ``difflib.SequenceMatcher`` without its popularity heuristic, as numbers."""
    if ref == other:
        return [1, 0, len(ref), 0, len(other)]
    at: dict[str, list[int]] = {}
    for j, token in enumerate(other):
        at.setdefault(token, []).append(j)
    runs = _ordered_runs(ref, at)
    todo = [(0, len(ref), 0, len(other))] if runs is None else []
    runs = runs or []
    while todo:
        r0, r1, o0, o1 = todo.pop()
        r, o, n = _longest(ref, other, at, r0, r1, o0, o1)
        if n:
            runs.append((r, o, n))
            if r0 < r and o0 < o:
                todo.append((r0, r, o0, o))
            if r + n < r1 and o + n < o1:
                todo.append((r + n, r1, o + n, o1))
    runs.sort()
    out: list[int] = []
    r = o = 0
    for run_r, run_o, n in (*runs, (len(ref), len(other), 0)):
        if r < run_r or o < run_o:
            out += (0, r, run_r, o, run_o)
        if n:
            # runs that touch are one
            if out and out[-5] and out[-3] == run_r and out[-1] == run_o:
                out[-3] += n
                out[-1] += n
            else:
                out += (1, run_r, run_r + n, run_o, run_o + n)
        r, o = run_r + n, run_o + n
    return out


@_once
@F.pandas_udf(CODES)
def align(readings: pd.Series) -> pd.Series:
    """Edit operations from the first reading's tokens to each other reading's tokens.

    Five numbers per operation: equal or not, and the borders in both readings. The
    popularity heuristic stays off: it would ignore frequent words in long regions.
    """
    def row(texts):
        if texts is None:
            return None
        first, *rest = [t.split(SEPARATOR) if t else [] for t in texts]
        return [_codes(first, other) for other in rest]

    return readings.map(row)


# white space as the JVM's Unicode class has it
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_UNIFIED = [(c, "-") for c in fv.DASHES if c != "-"] + [(c, "'") for c in fv.QUOTES if c != "'"]


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _forms(folded: str) -> list[str]:
    """``reading.normal_form`` of folded tokens."""
    # most texts hold few of these marks: looking for each is cheaper than a look at every character
    for mark, plain in _UNIFIED:
        if mark in folded:
            folded = folded.replace(mark, plain)
    return [t.strip(fv.EDGE_PUNCTUATION) for t in _BLANKS.sub(" ", folded).split(SEPARATOR)]


def _normal(text: str) -> list[str]:
    """Tokens in the form they are aligned in."""
    return _forms(_folded(text)) if text else []


@_once
@F.pandas_udf(_struct(folded=_TEXT, normal=_TEXT))
def fold_and_normal(texts: pd.Series) -> pd.DataFrame:
    """``fold`` of joined tokens and, beside it, their normal forms, joined again."""
    folded = [None if t is None else _folded(t) for t in texts]
    return pd.DataFrame({"folded": folded, "normal": [None if t is None else SEPARATOR.join(_forms(t)) for t in folded]}, dtype=object)


@_once
@F.pandas_udf(CODES)
def fold_and_align(readings: pd.Series) -> pd.Series:
    """``align`` over readings as they were written: folding and alignment in one step."""
    def row(texts):
        if texts is None:
            return None
        first, *rest = [_normal(t) for t in texts]
        return [_codes(first, other) for other in rest]

    return readings.map(row)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    order = np.lexsort((ends, starts))
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1] + fv.RANGE_MERGE_GAP))
    last = np.append(new[1:], len(starts)) - 1
    return [{"s": int(a), "e": int(b)} for a, b in zip(starts[new], reach[last])]


@_once
@F.pandas_udf(T.ArrayType(_struct(s=_INT, e=_INT)))
def merged_ranges(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Ranges joined where they overlap or lie at most one token apart; one pass after sorting."""
    return pd.Series([None if a is None else [] if not len(a) else _merged(np.asarray(a), np.asarray(b)) for a, b in zip(starts, ends)])


@_once
@F.pandas_udf(T.ArrayType(_INT))
def running_sums(numbers: pd.Series) -> pd.Series:
    """1, 3, 6 … of 1, 2, 3 …"""
    return numbers.map(lambda n: None if n is None else np.cumsum(n, dtype=np.int32))


# characters of raw text that are turned into structure at a time
MARKUP_CHARS = 1 << 18

_TAG = re.compile(r"<(?P<open>uncertain|deleted|unclear)(?P<slash>\s*/)?>|</(?P<close>uncertain|deleted|unclear)>")


def _token_count(text: str) -> int:
    return sum(2 if len(w) > 1 and w[-1] in fv.SENTENCE_FINAL else 1 for w in text.split())


def _markup(raw: str) -> dict:
    text: list[str] = []
    out = {"alternatives": [], "deleted": [], "unclear": 0}
    markers, tokens, at = set(), 0, 0

    def keep(piece: str, width: int | None = None) -> None:
        nonlocal tokens
        text.append(piece)
        tokens += _token_count(piece) if width is None else width

    for tag in iter(lambda: _TAG.search(raw, at), None):
        keep(raw[at:tag.start()])
        at, kind = tag.end(), tag["open"]
        if kind is None:
            markers.add("malformed")
            continue
        close = -1 if kind == "unclear" and tag["slash"] else raw.find(f"</{kind}>", at)
        if kind == "unclear" and tag["slash"]:
            keep(fv.UNCLEAR, 1)
            out["unclear"] += 1
            continue
        if close < 0:
            markers.add("malformed")
            continue
        inner, at = raw[at:close], close + len(kind) + 3
        options = inner.split("|")
        if _TAG.search(inner):
            markers.add("malformed")
            keep(_TAG.sub("", inner))
        elif kind == "deleted":
            out["deleted"].append(inner)
        elif kind == "unclear":
            keep(fv.UNCLEAR, 1)
            out["unclear"] += 1
        elif 2 <= len(options) <= 3:
            markers.add("uncertain")
            out["alternatives"].append({"token": tokens, "options": options})
            keep(options[0])
        else:
            markers.add("malformed")
            keep(inner)
    keep(raw[at:])
    return {"text": "".join(text), **out, "markers": sorted(markers)}


@_once
@F.pandas_udf(MARKUP)
def parse_markup(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Reader markup to plain text and structure; anything unclear in form is flagged.

    A batch may hold thousands of whole texts, and what is made of a text takes many times its
    room: it is handed on a few texts, or one long text, at a time.
    """
    columns = ["text", "alternatives", "deleted", "unclear", "markers"]
    for raw in batches:
        ends = raw.str.len().fillna(0).cumsum().to_numpy() // MARKUP_CHARS
        borders = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1), len(raw)]
        for start, end in zip(borders, borders[1:]):
            if start < end:
                yield pd.DataFrame([_markup(r or "") for r in raw.iloc[start:end]], columns=columns)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _replaced(text: str, name: str, alias: str) -> str:
    """The name replaced wherever no word goes on at either edge; found by plain search."""
    at, done, out = text.find(name), 0, []
    while at >= 0:
        end = at + len(name)
        glued = at > 0 and _is_word(name[0]) and _is_word(text[at - 1]) or end < len(text) and _is_word(name[-1]) and _is_word(text[end])
        if not glued:
            out += (text[done:at], alias)
            done = end
        at = text.find(name, at + 1 if glued else end)
    return "".join((*out, text[done:])) if out else text


@_once
@F.pandas_udf(_TEXT)
def replace_names(texts: pd.Series, names: pd.Series, aliases: pd.Series) -> pd.Series:
    """Names, in the order given, replaced by their aliases at word edges.

    No pattern is built: a text is searched for each of its own few names.
    """
    def row(text, own, instead):
        if text is None or own is None:
            return text
        for name, alias in zip(own, instead):
            text = _replaced(text, name, alias)
        return text

    return pd.Series([row(*r) for r in zip(texts, names, aliases)], dtype=object)


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    cross = left @ right.T
    return np.maximum((left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * cross, 0.0)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])
