"""Golden cases for reading comparison: spans, brackets, offsets, both reader orders."""

import re

import pytest
from pyspark.sql import functions as F

from pultwerk.functions import arrow, reading
from pultwerk.functions.reading import Vocabulary
from pultwerk.operators import consensus

DASH = "-‐‑‒–—―−"


def spans(spark, rows, vocabulary=Vocabulary()):
    df = spark.createDataFrame([(i, list(t), l, r) for i, (t, l, r) in enumerate(rows)], "i int, texts array<string>, l string, r string")
    df = df.withColumn("folded", F.split(arrow.fold(reading.joined(F.concat("texts", F.array("l", "r")))), arrow.SEPARATOR))
    own = F.slice("folded", F.lit(1), F.size("texts"))
    df = df.withColumn("f", reading.span_features(F.col("texts"), F.transform(own, reading.canonical_text),
                                                  reading.canonical_text(F.element_at("folded", -2)), reading.canonical_text(F.element_at("folded", -1)), vocabulary))
    out = df.withColumn("reason", reading.span_reason(F.col("f"), vocabulary)).orderBy("i").collect()
    return [r["reason"] or "" for r in out]


def pairs(*items):
    return [((a, b), "", "") for a, b in items]


def test_numbers(spark):
    cases = {"3,5": ["3.5"], "3.5": ["3.5"], "35": ["35"], "1.234,5": ["1234.5"], "1.234.567": ["1234567"], "-4": ["-4"], "+4": ["4"],
             "1,2,3": ["0"], "1,234.567": ["0"], "007,50": ["7.5"], "x 3 und 4,0": ["3", "4"], "-0": ["0"], "1.234": ["1.234"]}
    df = spark.createDataFrame(list(cases.items()), "t string, want array<string>").withColumn("got", reading.numbers(F.col("t")))
    for r in df.collect():
        assert r["got"] == r["want"], r["t"]


def test_spans_by_rule(spark):
    assert set(spans(spark, pairs(("3,5", "35"), ("-4", "4"), ("Ergebnis: -3,5 m", "Ergebnis: 3,5 m"), ("+5 V", "-5 V")))) == {"number"}
    assert set(spans(spark, pairs(("5 m", "5 km"), ("3 N", "3 J"), ("10 mV", "10 MV")))) == {"unit"}
    assert all(r.startswith("symbol:") for r in spans(spark, pairs(("a+b", "a-b"), ("a<b", "a>b"), ("a≤b", "a<b"), ("a→b", "a⇌b"))))
    assert spans(spark, pairs(("x ␣?␣", "y"))) == ["unclear"]
    assert set(spans(spark, pairs(("3,5", "3.5"), ("Co", "CO"), ("Auto", "Autos"), ("daher", "deshalb"), ("Uniform", "Form"), ("Unterricht", "Bericht"),
                                  ("integriert", "gefiltert"), ("ist konstant", "bleibt konstant"), ("je der", "wie der"), ("je der", "so der")))) == {""}


def test_split_negation(spark):
    rows = [((f"un{sep}{word}", word), "", "") for sep in (" ", *DASH) for word in ("möglich", "gleich", "wahr")]
    got = spans(spark, rows)
    assert all(r.startswith(("symbol:", "critical_word:")) for r in got), got
    assert spans(spark, pairs(("un möglich", "möglich"))) == ["critical_word:unmoeglich"]
    assert spans(spark, [(("un", ""), "", "möglich")]) == ["critical_word:unmoeglich"]
    assert spans(spark, [(("je", "wie"), "", "der")]) == [""]


def test_word_order_is_critical(spark):
    got = spans(spark, pairs(("steigt nicht", "nicht steigt"), ("nicht steigt", "steigt nicht"), ("nicht mehr möglich", "möglich mehr nicht")))
    assert all(r.startswith("critical_word:") for r in got)


def test_subject_rules(spark):
    assert spans(spark, pairs(("Co", "CO"), ("Kraft", "Masse")), Vocabulary(subject="chemie")) == ["chemical_case", ""]
    assert spans(spark, pairs(("Kraft", "Haft")), Vocabulary(subject="physik")) == ["subject:physik"]


def test_decomposed_letters_count_as_composed(spark):
    assert spans(spark, pairs(("möglich", "möglich"))) == [""]


def regions(spark, cases, vocabulary=Vocabulary(), markup=False):
    rows = [(0, 0, i, pos, engine, text, text, conf) for i, readers in enumerate(cases) for pos, (engine, text, conf) in enumerate(readers)]
    df = spark.createDataFrame(rows, "job_id int, page int, region_id int, pos int, engine string, text string, raw_text string, confidence double")
    if markup:
        df = consensus.read_markup(df)
    return consensus.build_regions(df, vocabulary).orderBy("region_id").collect()


def both_orders(a, b):
    return [[("htr", a, 0.9), ("tesseract", b, 0.9)], [("htr", b, 0.9), ("tesseract", a, 0.9)]]


def test_lost_negation_both_orders(spark):
    for r in regions(spark, both_orders("Die Kraft ist nicht konstant.", "Die Kraft ist konstant.")):
        assert [d["reason"] for d in r["disagreements"]] == ["critical_word:nicht"]
        assert re.search(r"\[\+?nicht\?\]", r["consensus_text"]) and r["agreement"] < 1 and r["critical"]


@pytest.mark.parametrize("a,b", [("Ergebnis: -3,5 m", "Ergebnis: 3,5 m"), ("Spannung: +5 V", "Spannung: -5 V")])
def test_lost_sign_both_orders(spark, a, b):
    for r in regions(spark, both_orders(a, b)):
        assert [d["reason"] for d in r["disagreements"]] == ["number"]


def test_identical_readers(spark):
    (r,) = regions(spark, [[(e, "Alles ist gleich.", 0.9) for e in ("htr", "tesseract", "ollama_vlm")]])
    assert r["agreement"] == 1.0 and r["disagreements"] == [] and "[" not in r["consensus_text"] and r["consensus_text"] == "Alles ist gleich."


def test_long_region_keeps_frequent_words(spark):
    words = ["der", "die", "ist", "wort"] * 150
    with_word = words[:300] + ["nicht"] + words[300:]
    for r in regions(spark, both_orders(" ".join(with_word), " ".join(words))):
        (d,) = r["disagreements"]
        assert d["end"] - d["start"] <= 3


def test_neighbouring_ranges_merge(spark):
    for r in regions(spark, both_orders("eins zwei drei", "einsX zwei dreiY")):
        assert [(d["start"], d["end"]) for d in r["disagreements"]] == [(0, 3)]


def test_insertions_are_zero_width(spark):
    cases = [[("htr", "Kraft ist konstant.", 0.9), ("tesseract", "Die Kraft ist konstant.", 0.9)],
             [("htr", "Die Kraft ist", 0.9), ("tesseract", "Die Kraft ist konstant", 0.9)]]
    for r in regions(spark, cases):
        (d,) = r["disagreements"]
        assert d["start"] == d["end"] and "[+" in r["consensus_text"]


def test_reference_priority_and_single_reader(spark):
    a, b = regions(spark, [[("tesseract", "eins zwei drei vier", 0.99), ("htr", "eins", 0.5)], [("tesseract", "allein", 0.9)]])
    assert a["reference_engine"] == "htr" and b["agreement"] == 0.0 and b["disagreements"] == []


def test_markup_alternative_escalates_one_reader(spark):
    (r,) = regions(spark, [[("htr", "Die Kraft <uncertain>ist|ist nicht</uncertain> konstant.", 0.9)]], markup=True)
    assert r["critical"] and r["disagreements"][0]["reason"] == "critical_word:nicht"


def test_markup_parsing(spark):
    raw = ["Die Aussage ist <deleted>falsch</deleted> richtig.", "a <uncertain>b|c|d|e</uncertain>", "x <unclear/> y <unclear></unclear>", "a </deleted> b <deleted> c",
           "<uncertain>a <deleted>b</deleted>|c</uncertain> d", "Eins. <uncertain>zwei|drei</uncertain>"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").withColumn("m", arrow.parse_markup("raw")).orderBy("i")
    m = [r["m"] for r in df.collect()]
    assert " ".join(m[0]["text"].split()) == "Die Aussage ist richtig." and m[0]["deleted"] == ["falsch"] and m[0]["markers"] == []
    assert m[1]["text"] == "a b|c|d|e" and m[1]["markers"] == ["malformed"]
    assert m[2]["text"] == "x ␣?␣ y ␣?␣" and m[2]["unclear"] == 2
    assert m[3]["text"] == "a  b  c" and m[3]["markers"] == ["malformed"]
    assert m[4]["text"] == "a b|c d" and m[4]["markers"] == ["malformed"]
    assert m[5]["alternatives"][0]["token"] == 2 and m[5]["alternatives"][0]["options"] == ["zwei", "drei"]


def test_brackets(spark):
    cases = {("nicht", ""): "[nicht?]", ("", "nicht"): "[+nicht?]", ("3,5", "8,5"): "[3,5|8,5?]", ("Co", "CO", "C0"): "[Co|CO|C0?]", ("", "a", "b"): "[+a|b?]"}
    df = spark.createDataFrame([(list(k), v) for k, v in cases.items()], "t array<string>, want string").withColumn("got", reading.bracket(F.col("t")))
    for r in df.collect():
        assert r["got"] == r["want"]


def test_offsets_point_at_brackets(spark):
    cases = both_orders("Der Wert 3,5 m ist nicht gleich. Ende!", "Wert 8,5 m ist gleich. Ende!") + both_orders("[ja|nein?] steht da wirklich so", "[ja|nein?] steht hier wirklich ganz so")
    for r in regions(spark, cases):
        last = 0
        for d in r["disagreements"]:
            piece = r["consensus_text"][d["char_start"]:d["char_end"]]
            assert piece.startswith("[") and piece.endswith("?]") and d["char_start"] >= last
            last = d["char_end"]
        assert last <= len(r["consensus_text"])


def test_normal_form(spark):
    cases = {"„Straße“": "'strasse'", "-4": "-4", "3,5": "3,5", "(Foo)": "foo", "a–b": "a-b", "ﬁx": "fix", "don’t": "don't", "*x*": "x"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", reading.normal_form(arrow.fold("t")))
    for r in df.collect():
        assert r["got"] == r["want"], r["t"]


def test_a_nul_in_a_text_hides_no_negation(spark):
    for r in regions(spark, both_orders("a b\0c nicht d", "a b\0c d")):
        assert [d["reason"] for d in r["disagreements"]] == ["critical_word:nicht"] and r["critical"]


def written(spark, frame, column):
    return frame.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_expressions_are_worked_out_once(spark):
    """A value that is read at several places is written into the plan once."""
    df = spark.createDataFrame([([(True, 0, 1, 0, 1)], "a", "b", "c")], "ops array<struct<equal:boolean,r0:int,r1:int,o0:int,o1:int>>, t string, l string, r string")
    assert written(spark, df, consensus.map_position(F.col("ops"), F.lit(1) + F.size("ops"), "r")).count("filter(") == 1
    words = written(spark, df, reading.critical_sequence(F.col("t"), F.col("l"), F.col("r")))
    assert words.count("regexp_extract_all(") == 4
    number = written(spark, df, reading.canonical_number(F.col("t")))
    assert number.count("regexp_extract(") <= 12 and number.count("RLIKE") == 1
    judged = consensus.classify_spans(df.select(F.array("t", "l").alias("texts"), F.col("l").alias("left"), F.col("r").alias("right")))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 6


def test_normal_forms_beside_folded_tokens(spark):
    cases = ["(„Straße“)", "ﬁn—al", "a  b", "...", "", "*_~", "3,5", "ΑΣ", "x\u0085y", "“Co”", "(a) (b)", "\tq\n"]
    df = spark.createDataFrame([(cases,), (["", ""],)], "t array<string>").withColumn("f", arrow.fold_and_normal(reading.joined(F.col("t"))))
    df = df.withColumn("want", F.transform(F.split(arrow.fold(reading.joined(F.col("t"))), arrow.SEPARATOR), reading.normal_form))
    for r in df.withColumn("got", F.split("f.normal", arrow.SEPARATOR)).collect():
        assert r["got"] == r["want"]


def test_symbols_of_texts(spark):
    df = spark.createDataFrame([(["a+b – c", "x→y+"],), (["", "abc"],), ([],)], "t array<string>").withColumn("s", reading.symbols_in(F.col("t")))
    assert [r["s"] for r in df.collect()] == [["+", "–", "→"], [], []]


def test_number_without_text(spark):
    got = spark.createDataFrame([(None,), ("1,0",), (",5",), ("0,00",)], "t string").withColumn("n", reading.canonical_number(F.col("t"))).collect()
    assert [r["n"] for r in got] == ["", "1", "0", "0"]
