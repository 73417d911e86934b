"""Quality rules as a short-circuit cascade.

Each rule is a predicate over lazily computed counts of a text; a text is dropped by the
first rule that rejects it and later rules are not evaluated. ``plan`` measures every
rule's cost and rejections on a sample and orders rules by rejection per cost, so cheap,
often rejecting rules come first. The order changes the work, never the verdict.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. A null or empty text has no words and fails ``few_words``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.llm.common import slices, spare, whole_text

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
# rows of the sample on which costs and rejections are measured
SAMPLE_ROWS = 2000


class Text:
    """Counts of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if len(number) == n:
            return 0
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 1_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        grams = pairs[:-1] * len(number) + ids[2:]
        _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = count[at] > 1
        marked = np.zeros(n, bool)
        for shift in range(3):
            marked[shift: shift + len(again)] |= again
        return int(marked.sum())

    @cached_property
    def n_capitals(self) -> int:
        """Characters that lower-casing changes."""
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_marks(self) -> int:
        return self.text.count("!") + self.text.count("?")


Rule = Callable[[Text], bool]

BASE: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}

RULES: dict[str, Rule] = {
    **BASE,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "capitals": lambda t: 100 * t.n_capitals > 30 * t.word_chars,
    "marks": lambda t: 10 * t.n_marks > 3 * t.n_words,
    "repeated_lines": lambda t: 100 * t.n_dup_lines > 60 * len(t.lines),
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
}


def measure(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id") -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule on about ``sample_rows`` rows chosen by hash.

    Every rule starts from the bare text, so its cost holds all counts it needs.
    """
    total = docs.count()
    # the sample is a feature of the method: it decides the order of rules, not a verdict
    share = min(1.0, sample_rows / max(total, 1))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(key), "text"), F.lit(1_000_000)) < int(1_000_000 * share))

    def run(batches):
        spent, rejected = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for name, rule in rules.items():
                start = time.thread_time()
                rejected[name] += sum(rule(Text(t)) for t in texts)
                spent[name] += time.thread_time() - start
        yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(spent.values())), pa.array(list(rejected.values()), pa.int64())], names=["rule", "seconds", "rejected"])

    sums = chosen.select(whole_text().alias("text")).mapInArrow(run, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"))
    return {r["rule"]: (r["s"], r["r"]) for r in sums.collect()}


def plan(measured: dict[str, tuple[float, int]], rules: dict[str, Rule] = RULES) -> list[str]:
    """Rule names by rejections per second, best first; unmeasured rules keep their order at the end."""
    worth = {name: measured[name][1] / max(measured[name][0], 1e-9) if name in measured else -1.0 for name in rules}
    return sorted(rules, key=lambda name: -worth[name])


def first_rejection(text: Text, order: list[str], rules: dict[str, Rule]) -> str | None:
    return next((name for name in order if rules[name](text)), None)


def judged(docs: DataFrame, order: list[str], rules: dict[str, Rule] = RULES, counts: bool = False) -> DataFrame:
    """All columns and ``rejected_by``; with ``counts`` also the base counts of every text.

    A text leaves the cascade with the first rule that rejects it; ``counts`` asks for all base
    counts of every text, so then only the other rules are saved. Null texts are empty,
    repeated rows are judged alike, whatever their order, and a text of any length is judged
    as a whole; an empty table gives an empty one.
    """
    extra = [("n_words", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"), ("n_repeat_words", "n_repeat_words")] if counts else []
    kept = [c for c in docs.columns if c not in {"rejected_by", *(name for name, _ in extra)}]
    rows = docs.select(*kept, whole_text().alias(spare(kept, "whole")))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema = ", ".join([types, "rejected_by string", *(f"{name} long" for name, _ in extra)])

    def run(batches):
        for batch in slices(batches, 512):
            verdicts, columns = [], [[] for _ in extra]
            for value in batch.column(len(kept)):
                text = Text(value.as_py())
                verdicts.append(first_rejection(text, order, rules))
                for column, (_, attribute) in zip(columns, extra):
                    column.append(getattr(text, attribute))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(verdicts, pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                names=[*kept, "rejected_by", *(name for name, _ in extra)],
            )

    return rows.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, rules: dict[str, Rule] = RULES, key: str = "doc_id") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    order = plan(measure(docs, rules, key=key), rules)
    return judged(docs, order, rules).where(F.col("rejected_by").isNull()).select(*docs.columns)
