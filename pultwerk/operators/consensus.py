"""Several machine readings of a region → one text with its disagreements marked.

Readings are rows. One shuffle brings the few readers of a region together; alignment is
the only step that leaves the JVM besides case folding. Disagreements become rows again
for classification, still partitioned by region, and are put back without a new shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import arrow, reading
from pultwerk.functions.reading import Vocabulary

KEYS = ["job_id", "page", "region_id"]
ALTERNATIVES = "array<struct<token:int,options:array<string>>>"


def priority(engine: Column) -> Column:
    out = None
    for rank, name in enumerate(fv.READER_PRIORITY):
        out = F.when(engine == name, rank) if out is None else out.when(engine == name, rank)
    return out.otherwise(len(fv.READER_PRIORITY))


def read_markup(readings: DataFrame) -> DataFrame:
    """Raw reader output → plain text, with alternatives and markers as columns."""
    return readings.withColumn("_m", arrow.parse_markup(F.col("raw_text"))).select(
        *[c for c in readings.columns if c != "text"], "_m.text", "_m.alternatives", "_m.deleted", F.col("_m.unclear").alias("unclear"), "_m.markers")


def pick_reference(candidates: DataFrame) -> DataFrame:
    """Reference reader per region: fixed priority, confidence, number of tokens, name."""
    rank = F.struct(priority(F.col("engine")), -F.col("confidence"), -F.size(reading.tokens(F.col("text"))), F.col("engine"))
    return candidates.groupBy(*KEYS).agg(F.min_by("engine", rank).alias("reference_engine"), F.count("*").alias("readers"))


def map_position(ops: Column, at: Column, source: str) -> Column:
    """Border position in one reader's tokens → position in the other's, NULL inside a change."""
    target = "o" if source == "r" else "r"
    s0, s1, t0, t1 = f"{source}0", f"{source}1", f"{target}0", f"{target}1"
    fits = F.filter(ops, lambda o: (o[s0] <= at) & (at <= o[s1]) & (o["equal"] | (at == o[s0]) | (at == o[s1])))
    return reading.once(F.get(fits, F.lit(0)), lambda op: (
        F.when(op["equal"], op[t0] + at - op[s0]).when(at == op[s0], op[t0]).when(at == op[s1], op[t1])))


def merge_ranges(ranges: Column) -> Column:
    """Ranges joined where they overlap or lie at most one token apart."""
    return arrow.merged_ranges(F.transform(ranges, lambda r: r["s"]), F.transform(ranges, lambda r: r["e"]))


def _joined(tokens: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), " ")


def _operations(codes: Column) -> Column:
    at = lambda i, k: F.get(codes, i * 5 + k)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(codes) / 5).cast("int") - 1), lambda i: F.struct(
        (at(i, 0) == 1).alias("equal"), at(i, 1).alias("r0"), at(i, 2).alias("r1"), at(i, 3).alias("o0"), at(i, 4).alias("o1")))


def align_regions(candidates: DataFrame) -> DataFrame:
    """One row per region: reference, other readers, edit operations, merged ranges.

    Only the texts are shuffled; tokens are made afterwards. A region has as many readings
    as there are readers, so the list gathered is short.
    """
    if "alternatives" not in candidates.columns:
        candidates = candidates.withColumn("alternatives", F.array().cast(ALTERNATIVES))
    # a NUL in a text would be taken for the separator of folded tokens
    candidates = candidates.withColumn("text", F.translate("text", arrow.SEPARATOR, "\ufffd"))
    rows = candidates.groupBy(*KEYS).agg(F.collect_list(F.struct("engine", "pos", "text", "confidence", "alternatives")).alias("readers"))
    rows = rows.withColumn("readers", F.transform("readers", lambda r: F.struct(
        r["engine"].alias("engine"), r["pos"].alias("pos"), r["text"].alias("text"), r["confidence"].alias("confidence"),
        reading.tokens(r["text"]).alias("tokens"), r["alternatives"].alias("alternatives"))))
    rows = rows.withColumn("readers", F.transform(F.array_sort(F.transform("readers", lambda r: F.struct(
        priority(r["engine"]).alias("p"), (-r["confidence"]).alias("c"), (-F.size(r["tokens"])).alias("n"), r["engine"].alias("e"), r["pos"].alias("o"), r.alias("r")))),
        lambda x: x["r"]))
    rows = rows.withColumn("ref", F.get("readers", F.lit(0))).withColumn("others", F.array_sort(
        F.slice("readers", 2, F.size("readers")), lambda a, b: a["pos"] - b["pos"]))
    # readings that are equal word for word need neither folding nor alignment
    same = F.forall("others", lambda o: o["tokens"] == F.col("ref.tokens"))
    per_reader = F.transform(F.concat(F.array("ref"), F.col("others")), lambda r: reading.joined(r["tokens"]))
    rows = rows.withColumn("codes", arrow.fold_and_align(F.when(~same, per_reader)))
    size = F.size("ref.tokens")
    alike = F.transform("others", lambda o: F.array(F.struct(
        F.lit(True).alias("equal"), F.lit(0).alias("r0"), size.alias("r1"), F.lit(0).alias("o0"), size.alias("o1"))))
    rows = rows.withColumn("ops", F.when(F.col("codes").isNull(), alike).otherwise(F.transform("codes", _operations))).drop("codes")
    # every reader with its own operations; the reference stands for itself
    marked = F.flatten(F.concat(
        F.array(F.transform("ref.alternatives", lambda a: F.struct(a["token"].alias("at"), F.col("ref.engine").alias("engine"), a["options"].alias("options"), (a["token"] < F.size("ref.tokens")).alias("ok")))),
        F.transform("others", lambda o, i: F.transform(o["alternatives"], lambda a: F.struct(
            map_position(F.get("ops", i), a["token"], "o").alias("at"), o["engine"].alias("engine"), a["options"].alias("options"), (a["token"] < F.size(o["tokens"])).alias("ok"))))))
    rows = rows.withColumn("marked", F.filter(marked, lambda m: m["ok"] & m["at"].isNotNull()))
    changed = F.transform(F.filter(F.flatten("ops"), lambda o: ~o["equal"]), lambda o: F.struct(o["r0"].alias("s"), o["r1"].alias("e")))
    uncertain = F.transform("marked", lambda m: F.struct(m["at"].alias("s"), (m["at"] + 1).alias("e")))
    spots = F.concat(changed, uncertain)
    merged = merge_ranges(reading.once(spots, lambda found: F.when(F.size(found) > 0, found)))
    return rows.withColumn("ranges", F.coalesce(merged, F.array().cast("array<struct<s:int,e:int>>")))


def _variants(start: Column, end: Column) -> Column:
    """(text, engine) pairs of one range, the reference's first."""
    def other(o, i):
        # an operation that puts words in at this very place
        own = lambda ops: F.when(start == end, F.get(F.filter(ops, lambda p: (p["r0"] == start) & (p["r1"] == start)), F.lit(0)))
        place = lambda ops: reading.once(own(ops), lambda p: F.struct(
            F.when(p.isNotNull(), p["o0"]).otherwise(map_position(ops, start, "r")).alias("first"),
            F.when(p.isNotNull(), p["o1"]).otherwise(map_position(ops, end, "r")).alias("last")))
        return reading.once(reading.once(F.get("ops", i), place), lambda at: F.when(
            at["first"].isNotNull() & at["last"].isNotNull(),
            F.struct(_joined(o["tokens"], at["first"], at["last"]).alias("text"), o["engine"].alias("engine"))))

    base = F.struct(_joined(F.col("ref.tokens"), start, end).alias("text"), F.col("ref.engine").alias("engine"))
    inside = F.filter("marked", lambda m: (start <= m["at"]) & (m["at"] < end))
    options = F.flatten(F.transform(inside, lambda m: F.transform(m["options"], lambda t: F.struct(t.alias("text"), m["engine"].alias("engine")))))
    return F.concat(F.array(base), F.array_compact(F.transform("others", other)), options)


def classify_spans(spans: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """spans(texts, left, right) → ``differs`` and, for a critical difference, its ``reason``.

    ``texts`` are the distinct variants of a span, the reference's first; ``left`` and
    ``right`` are the reference tokens beside it.
    """
    rows = spans.withColumn("_f", arrow.fold_and_normal(reading.joined(F.concat("texts", F.array("left", "right")))))
    own = lambda joined: F.slice(F.split(joined, arrow.SEPARATOR), F.lit(1), F.size("texts"))
    rows = rows.withColumn("differs", F.size(F.array_distinct(own(F.col("_f.normal")))) > 1)
    # all variants and neighbours as one text, split once; the steps below read the parts
    rows = rows.withColumn("canonical", F.when(F.col("differs"), F.split(reading.canonical_text(F.col("_f.folded")), arrow.SEPARATOR)))
    beside = lambda i: F.element_at("canonical", i)
    rows = rows.withColumn("features", F.when(F.col("differs"), reading.span_features(
        F.col("texts"), F.slice("canonical", F.lit(1), F.size("texts")), beside(-2), beside(-1), vocabulary)))
    return rows.withColumn("reason", F.when(F.col("differs"), reading.span_reason(F.col("features"), vocabulary))).drop("_f", "canonical", "features")


def _judged(aligned: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per range with its verdict, and one bare row for a region without ranges.

    A summary of the region rides along with its first range instead of its readings, so
    rows stay narrow and nothing has to be joined back later.
    """
    summary = F.struct(
        F.col("ref.engine").alias("reference_engine"), F.col("ref.text").alias("selected_text"), F.size("readers").alias("n_readers"),
        F.array_sort(F.transform("readers", lambda r: r["engine"])).alias("engines"),
        (F.aggregate("readers", F.lit(0.0), lambda acc, r: acc + r["confidence"]) / F.size("readers")).alias("mean_confidence"))
    # what a range needs is cut out inside the region, so that a row carries its own variants
    # and not all readings; the region itself rides along with its first range only
    tokens = F.col("ref.tokens")
    spans = F.transform("ranges", lambda r: F.struct(
        r["s"].alias("start"), r["e"].alias("end"), _variants(r["s"], r["e"]).alias("pairs"),
        F.coalesce(F.get(tokens, r["s"] - 1), F.lit("")).alias("left"), F.coalesce(F.get(tokens, r["e"]), F.lit("")).alias("right")))
    # a step of its own: next to a generator the struct would lose its field names
    summed = aligned.select(*KEYS, summary.alias("region"), tokens.alias("ref_tokens"), spans.alias("spans"))
    rows = summed.select(*KEYS, "region", "ref_tokens", F.posexplode_outer("spans").alias("pos", "span"))
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rows = rows.select(
        *KEYS, F.when(head, F.col("region")).alias("region"), F.when(head, F.col("ref_tokens")).alias("ref_tokens"),
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.pairs").alias("pairs"),
        F.coalesce("span.left", F.lit("")).alias("left"), F.coalesce("span.right", F.lit("")).alias("right"))
    none = F.array().cast("array<string>")
    rows = classify_spans(rows.withColumn("texts", F.coalesce(F.array_distinct(F.transform("pairs", lambda p: p["text"])), none)), vocabulary)
    variants = F.transform("texts", lambda t: F.struct(t.alias("text"), F.array_sort(F.array_distinct(F.transform(
        F.filter("pairs", lambda p: p["text"] == t), lambda p: p["engine"]))).alias("engines")))
    return rows.select(*KEYS, "region", "ref_tokens", "differs", F.struct(
        "start", "end", variants.alias("variants"), F.col("reason").isNotNull().alias("critical"), F.coalesce("reason", F.lit("")).alias("reason")).alias("d"))


def disagreements(aligned: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row per disagreement: range, variants with their readers, critical flag, reason."""
    return _judged(aligned, vocabulary).filter("differs").select(*KEYS, "d.*")


def pieces_of(tokens: Column, found: Column) -> Column:
    """Reference tokens with one bracket in place of every disputed range, in order.

    ``found`` is sorted by start; ``d`` numbers the brackets and is -1 for plain tokens.
    """
    outside = lambda a, b: F.transform(
        F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0))), lambda t: F.struct(t.alias("text"), F.lit(-1).alias("d")))
    behind = lambda k: F.when(k > 0, F.get(found, k - 1)["end"]).otherwise(0)
    parts = F.transform(found, lambda d, k: F.concat(outside(behind(k), d["start"]), F.array(
        F.struct(reading.bracket(F.transform(d["variants"], lambda v: v["text"])).alias("text"), k.alias("d")))))
    return F.concat(F.flatten(parts), outside(behind(F.size(found)), F.size(tokens)))


def with_text(regions: DataFrame) -> DataFrame:
    """Adds consensus_text and the exact character range of every bracket.

    Ranges come from the pieces the text is made of, so a bracket printed in the source is
    never mistaken for a mark.
    """
    rows = regions.withColumn("pieces", pieces_of(F.col("ref_tokens"), F.col("found")))
    rows = rows.withColumn("spaced", F.transform("pieces", lambda p, i: F.when(
        (i == 0) | p["text"].isin(fv.SENTENCE_FINAL), p["text"]).otherwise(F.concat(F.lit(" "), p["text"]))))
    rows = rows.withColumn("consensus_text", F.array_join("spaced", ""))
    # where every piece ends, for the regions that have a bracket at all
    rows = rows.withColumn("stops", arrow.running_sums(F.when(F.size("found") > 0, F.transform("spaced", F.char_length))))
    marks = F.filter(F.transform("pieces", lambda p, i: F.struct(p["d"].alias("d"), i.alias("i"), F.char_length(p["text"]).alias("w"))), lambda x: x["d"] >= 0)
    ends = F.transform(marks, lambda x: F.struct(F.get("stops", x["i"]).alias("e"), x["w"].alias("w")))
    ranged = F.transform(F.arrays_zip(F.col("found").alias("d"), ends.alias("x")), lambda z: F.struct(
        z["d"]["start"].alias("start"), z["d"]["end"].alias("end"), z["d"]["variants"].alias("variants"), z["d"]["critical"].alias("critical"),
        z["d"]["reason"].alias("reason"), (z["x"]["e"] - z["x"]["w"]).alias("char_start"), z["x"]["e"].alias("char_end")))
    return rows.withColumn("disagreements", ranged).drop("pieces", "spaced", "stops", "found")


def agreement(found: Column, n_tokens: Column, n_readers: Column) -> Column:
    """Share of reference tokens nobody disputes; an insertion counts as one token."""
    width = F.aggregate(found, F.lit(0), lambda acc, d: acc + F.greatest(F.lit(1), d["end"] - d["start"]))
    return F.when(n_readers < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - width / F.greatest(n_tokens, F.lit(1)))))


def build_regions(candidates: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """candidates(keys, pos, engine, text, confidence[, alternatives]) → one row per region.

    Rows are already partitioned by region when disagreements are gathered, so the whole
    job shuffles once.
    """
    judged = _judged(align_regions(candidates), vocabulary)
    rows = judged.groupBy(*KEYS).agg(
        F.first("region", ignorenulls=True).alias("region"), F.first("ref_tokens", ignorenulls=True).alias("ref_tokens"),
        F.array_sort(F.collect_list(F.when(F.col("differs"), F.col("d")))).alias("found"))
    rows = rows.withColumn("agreement", agreement(F.col("found"), F.size("ref_tokens"), F.col("region.n_readers")))
    return with_text(rows).select(
        *KEYS, "region.reference_engine", "region.selected_text", "consensus_text", "disagreements", "agreement",
        "region.n_readers", "region.engines", "region.mean_confidence",
        F.size("disagreements").alias("n_disagreements"), F.exists("disagreements", lambda d: d["critical"]).alias("critical"))
