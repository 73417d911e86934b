"""Column expressions over transcribed text: tokens, numbers, units, symbols, critical words.

Everything here is a built-in expression. What is not built in (NFKC and case folding) is
done beforehand by ``arrow.fold`` and arrives as a column.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import arrow
from pultwerk.functions.text import words

_NO_TEXTS = "array<string>"


def canonical_word(word: str) -> str:
    """Folded spelling in which ö and oe, ß and ss are the same; for the fixed lists."""
    folded = unicodedata.normalize("NFKC", word).casefold()
    return folded.replace("ö", "oe").replace("ü", "ue").replace("ä", "ae")


@dataclass(frozen=True)
class Vocabulary:
    """What counts as critical. Small configuration, so it is written into the plan."""

    words: tuple[str, ...] = tuple(fv.CRITICAL_WORDS)
    symbols: str = fv.CRITICAL_SYMBOLS
    units: tuple[str, ...] = tuple(fv.UNITS)
    subject: str | None = None
    extra_words: tuple[str, ...] = field(default=())

    @property
    def canonical_words(self) -> list[str]:
        return sorted({canonical_word(w) for w in (*self.words, *self.extra_words)})

    @property
    def subject_words(self) -> list[str]:
        return sorted({canonical_word(w) for w in fv.SUBJECT_WORDS.get(self.subject or "", [])})

    @property
    def folded_units(self) -> list[str]:
        return sorted({u.casefold() for u in self.units})


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _escape(chars: str) -> str:
    return "".join("\\" + c if c in r"\[]^-&~" else c for c in chars)


def tokens(text: Column) -> Column:
    """White-space words; one sentence-final sign at the end becomes a token of its own."""
    last = lambda w: F.substring(w, -1, 1)
    return F.flatten(F.transform(words(text), lambda w: F.when(
        (F.char_length(w) > 1) & last(w).isin(fv.SENTENCE_FINAL),
        F.array(F.substring(w, F.lit(1), F.char_length(w) - 1), last(w))).otherwise(F.array(w))))


def joined(texts: Column) -> Column:
    """Several texts as one, for a step that is cheaper per row than per text."""
    return F.array_join(texts, arrow.SEPARATOR)


def normal_form(folded: Column) -> Column:
    """Folded tokens (joined) → form for alignment: one dash, one quote, no edge punctuation.

    Digits, signs and comma versus dot stay, because they carry meaning.
    """
    unified = F.translate(F.translate(folded, fv.DASHES, "-" * len(fv.DASHES)), fv.QUOTES, "'" * len(fv.QUOTES))
    edge, sep = _escape(fv.EDGE_PUNCTUATION), arrow.SEPARATOR
    squeezed = F.regexp_replace(unified, r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, rf"(?<![^{sep}])[{edge}]+|[{edge}]+(?![^{sep}])", "")


def number_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)({fv.NUMBER_RUN})"), 1)


def canonical_number(run: Column) -> Column:
    """German notation to plain digits of any length; what cannot be a number becomes 0.

    A comma is the decimal sign and dots then group; a single dot is a decimal sign;
    several dots group. Leading and trailing zeros do not matter.
    """
    def plain(body):
        head, tail = F.regexp_extract(body, r"\A(.*),([^,]*)\z", 1), F.regexp_extract(body, r"\A(.*),([^,]*)\z", 2)
        dots = F.char_length(body) - F.char_length(F.replace(body, F.lit("."), F.lit("")))
        return (F.when(body.contains(","), F.concat_ws(".", F.replace(head, F.lit("."), F.lit("")), tail))
                .when(dots == 1, body).otherwise(F.replace(body, F.lit("."), F.lit(""))))

    def size(plain):
        whole = F.regexp_replace(F.regexp_extract(plain, r"\A([^.]*)", 1), r"\A0+(?=.)", "")
        part = F.regexp_replace(F.regexp_extract(plain, r"\.(.*)\z", 1), r"0+\z", "")
        valid = plain.rlike(r"(?U)\A\d+(\.\d*)?\z")
        return F.when(~valid, "0").otherwise(once(part, lambda p: F.when(p == "", whole).otherwise(F.concat_ws(".", whole, p))))

    found = once(once(F.regexp_replace(run, r"\A[+-]", ""), plain), size)
    return once(found, lambda s: F.when(s == "0", "0").otherwise(F.concat(F.when(run.startswith("-"), "-").otherwise(""), s)))


def numbers(text: Column) -> Column:
    return F.transform(number_runs(text), canonical_number)


def fold_unit(form: Column) -> Column:
    """Case folding for unit spellings; besides ``lower`` only these two letters fold."""
    return F.lower(F.translate(form, "µſ", "μs"))


def raw_units(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Known unit tokens in order and as written, also when glued to a number."""
    known = vocabulary.folded_units
    bare = F.transform(words(text), lambda w: F.regexp_replace(w, r"\A[,.;:()\[\]{}]+|[,.;:()\[\]{}]+\z", ""))
    forms = F.transform(bare, lambda w: F.filter(F.array(w, F.regexp_replace(w, r"(?U)\A[+-]?\d+([.,]\d+)?", "")),
                                                 lambda f: (f != "") & fold_unit(f).isin(known)))
    return F.flatten(F.transform(forms, lambda f: F.slice(f, 1, 1)))


def units(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    return F.transform(raw_units(text, vocabulary), fold_unit)


def prefix_confusion(a: Column, b: Column) -> Column:
    """Same base unit, different prefix, for two unit tokens as written."""
    prefix = lambda u: F.when((F.char_length(u) >= 2) & F.substring(u, 1, 1).isin(list(fv.UNIT_PREFIXES)), F.substring(u, 1, 1)).otherwise("")
    base = lambda u: F.when(prefix(u) == "", u).otherwise(F.substr(u, F.lit(2)))
    return (fold_unit(base(a)) == fold_unit(base(b))) & (a != b) & (prefix(a) != prefix(b))


def symbols_in(texts: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Critical symbols that occur in any of the texts, smallest first."""
    # only symbols are split into characters, not the whole texts
    left = F.regexp_replace(F.array_join(texts, ""), f"[^{_escape(vocabulary.symbols)}]+", "") if vocabulary.symbols else F.lit("")
    used = F.filter(F.split(left, ""), lambda c: c.isin(list(vocabulary.symbols)))
    return F.array_sort(F.array_distinct(used))


def _count(text: Column, symbol: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, symbol, F.lit("")))


def symbol_difference(base: Column, other: Column, used: Column) -> Column:
    """Smallest symbol that the two texts do not contain equally often, else NULL."""
    return F.get(F.filter(used, lambda s: _count(base, s) != _count(other, s)), F.lit(0))


def canonical_text(folded: Column) -> Column:
    return F.replace(F.replace(F.replace(folded, F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")), F.lit("ä"), F.lit("ae"))


def letters(canonical: Column) -> Column:
    return F.regexp_extract_all(canonical, F.lit(r"(\p{L}+)"), 1)


def glued(canonical: Column) -> Column:
    """Letter runs after blanks and dashes are gone."""
    return letters(F.regexp_replace(canonical, rf"(?U)[\s\-{fv.DASHES}]+", ""))


def critical_sequence(canonical: Column, left: Column, right: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Critical words in order: as written, glued within the span, glued to one neighbour.

    Gluing finds a split-off prefix ("un möglich"). It is off as soon as the span contains
    a function word, so that "je der" does not turn into "jeder".
    """
    known, blocked = vocabulary.canonical_words, sorted({canonical_word(w) for w in fv.FUNCTION_WORDS})
    hits = lambda found: F.filter(found, lambda t: t.isin(known))
    none = F.array().cast(_NO_TEXTS)

    def sequence(plain, free):
        differs = lambda text: F.when(free, once(glued(text), lambda found: F.when(found != plain, hits(found)).otherwise(none))).otherwise(none)
        beside = F.array_distinct(F.concat(
            F.when(left != "", differs(F.concat(left, canonical))).otherwise(none),
            F.when(right != "", differs(F.concat(canonical, right))).otherwise(none)))
        return F.concat(hits(plain), differs(canonical), F.when(F.size(plain) > 0, beside).otherwise(none))

    return once(letters(canonical), lambda plain: once(~F.exists(plain, lambda t: t.isin(blocked)), lambda free: sequence(plain, free)))


def first_difference(a: Column, b: Column) -> Column:
    """Word at the first differing place; of two words the alphabetically smaller."""
    place = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return once(F.get(place, F.lit(0)), lambda at: F.least(F.get(a, at), F.get(b, at)))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def span_features(texts: Column, canonical: Column, left: Column, right: Column, vocabulary: Vocabulary) -> Column:
    """Per variant: what the comparison needs, worked out once."""
    subject = lambda c: F.array_sort(F.array_distinct(F.filter(letters(c), lambda t: t.isin(vocabulary.subject_words))))
    none = F.array().cast(_NO_TEXTS)
    return F.transform(F.arrays_zip(texts.alias("text"), canonical.alias("canonical")), lambda v: F.struct(
        v["text"].alias("text"), numbers(v["text"]).alias("numbers"), raw_units(v["text"], vocabulary).alias("units"),
        critical_sequence(v["canonical"], left, right, vocabulary).alias("words"),
        (subject(v["canonical"]) if vocabulary.subject_words else none).alias("subject")))


def span_reason(features: Column, vocabulary: Vocabulary) -> Column:
    """Why a span is critical, NULL if it is not; the first rule that hits decides.

    Every comparison is against the first variant, except the unit prefix, which is
    compared across all pairs of variants.
    """
    base, others = F.get(features, F.lit(0)), F.slice(features, F.lit(2), F.size(features))
    texts = F.transform(features, lambda v: v["text"])
    folded = lambda us: F.transform(us, fold_unit)
    numbered = F.transform(features, lambda v, i: F.struct(i.alias("i"), v["units"].alias("u")))
    confused = F.exists(numbered, lambda a: F.exists(numbered, lambda b: (a["i"] < b["i"]) & F.exists(
        a["u"], lambda x: F.exists(b["u"], lambda y: prefix_confusion(x, y)))))
    symbol = once(symbols_in(texts, vocabulary), lambda used: _first(F.transform(others, lambda v: symbol_difference(base["text"], v["text"], used))))
    word = _first(F.transform(others, lambda v: F.when(v["words"] != base["words"], first_difference(base["words"], v["words"]))))
    caseless = F.array_distinct(F.transform(texts, lambda t: F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))))
    chemical = F.lit(vocabulary.subject == "chemie") & (F.size(caseless) == 1) & (F.size(F.array_distinct(texts)) > 1)
    last = (F.when(chemical, "chemical_case")
            .when(F.lit(bool(vocabulary.subject)) & F.exists(others, lambda v: v["subject"] != base["subject"]),
                  F.lit(f"subject:{vocabulary.subject}")))
    by_word = once(word, lambda w: F.when(w.isNotNull(), F.concat(F.lit("critical_word:"), w)).otherwise(last))
    by_symbol = once(symbol, lambda s: F.when(s.isNotNull(), F.concat(F.lit("symbol:"), s)).otherwise(by_word))
    return (F.when(F.exists(texts, lambda t: t.contains(fv.UNCLEAR)), "unclear")
            .when(F.exists(others, lambda v: v["numbers"] != base["numbers"]), "number")
            .when(F.exists(others, lambda v: folded(v["units"]) != folded(base["units"])) | confused, "unit")
            .otherwise(by_symbol))


BRACKET = re.compile(r"\[[^\]]*\?\]")


def bracket(texts: Column) -> Column:
    """Visible mark for competing readings; the first text is the reference's."""
    rest = F.filter(F.slice(texts, F.lit(2), F.size(texts)), lambda t: t != "")
    base = F.get(texts, F.lit(0))
    inner = (F.when((base != "") & (F.size(rest) == 0), base)
             .when((base == "") & (F.size(rest) > 0), F.concat(F.lit("+"), F.array_join(rest, "|")))
             .otherwise(F.array_join(F.array_distinct(F.filter(texts, lambda t: t != "")), "|")))
    return F.concat(F.lit("["), inner, F.lit("?]"))
