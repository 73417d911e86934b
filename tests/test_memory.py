"""Steps that hold whole texts hand on a part at a time."""

import pandas as pd

from pultwerk.functions import arrow


def test_markup_is_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(arrow, "MARKUP_CHARS", 100)
    texts = ["a <uncertain>b|c</uncertain> d", None, "", "x" * 500, "<deleted>e</deleted> f", "<unclear/>"] * 20
    empty = pd.Series([], dtype=object)
    parts = list(arrow.parse_markup.func(iter([pd.Series(texts), empty, pd.Series(texts[:3])])))
    assert max(len(p) for p in parts) <= 7
    got = [tuple(r) for p in parts for r in p.itertuples(index=False)]
    want = [tuple(arrow._markup(t or "").values()) for t in texts + texts[:3]]
    assert got == want


def test_markup_keeps_rows_in_place(spark):
    rows = [(i, None if i % 50 == 0 else f"w{i} <uncertain>b{i}|c</uncertain> " + "y " * (i % 7 * 5000)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, raw string").coalesce(2)
    got = {r["id"]: (r["m"]["text"], [tuple(a) for a in r["m"]["alternatives"]]) for r in df.select("id", arrow.parse_markup("raw").alias("m")).collect()}
    for i, raw in rows:
        m = arrow._markup(raw or "")
        assert got[i] == (m["text"], [(a["token"], a["options"]) for a in m["alternatives"]])
