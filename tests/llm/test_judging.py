"""Rules, classifier, URL filter and main text, and the pipeline as a whole."""

import collections
import html
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from pultwerk.llm import main_text, quality_model, quality_rules, url_filter
from pultwerk.llm.queries import QUERIES

CLEAN = " ".join(f"wort{i % 97}" for i in range(120)) + "."
SCHEMA = "doc_id long, text string, score string, rejected_by string, n_words string, predicted string, _x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def slow_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in collections.Counter(grams).items() if n > 1}
    return len({j for i, g in enumerate(grams) if g in often for j in (i, i + 1, i + 2)})


def test_counts_equal_their_definitions():
    rng = random.Random(3)
    texts = ["", " ", "a", "a b c a b c", "x\n\nx\n x\nx", "é#*$%&|<> \x0b\f\r\t\xa0z", *(" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60))]
    for t in texts:
        got = quality_rules.Text(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got.n_words == len(words) and got.word_chars == sum(map(len, words))
        assert got.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert got.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))
        assert got.n_repeat_words == slow_repeats(t)


def test_cascade_orders_by_rejection_per_cost_and_short_circuits(spark):
    assert quality_rules.plan({"few_words": (1.0, 5), "symbols": (0.1, 5), "capitals": (0.1, 1)}, dict.fromkeys(["few_words", "capitals", "symbols"])) == ["symbols", "capitals", "few_words"]
    asked = []
    rules = {"first": lambda t: asked.append("first") or True, "second": lambda t: asked.append("second") or True}
    assert quality_rules.first_rejection(quality_rules.Text("x"), ["second", "first"], rules) == "second" and asked == ["second"]
    docs = table(spark, [(1, CLEAN), (2, None), (3, ""), (4, CLEAN.replace(" ", "## ")), (5, CLEAN.upper()), (6, "again and again " * 80), (7, CLEAN), (7, CLEAN), (None, CLEAN)])
    measured = quality_rules.measure(docs)
    assert measured["few_words"][1] == 2 and set(measured) == set(quality_rules.RULES)
    for order in (quality_rules.plan(measured), list(reversed(quality_rules.RULES))):
        kept = {(r["doc_id"], r["rejected_by"] is None) for r in quality_rules.judged(docs, order).collect()}
        assert kept == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True), (None, True)}
    assert quality_rules.kept_documents(docs).columns == docs.columns
    assert quality_rules.kept_documents(table(spark, [])).collect() == []


def test_classifier_on_held_out_rows(spark):
    small = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in QUERIES["op2_quality_classifier"](spark, small).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{small}/documents.parquet").count()
    held = [k for k in labels if scored[k]["held_out"]]
    right = sum(scored[k]["predicted"] == labels[k] for k in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.values())


def test_held_out_labels_and_other_columns_change_no_score(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    one = quality_model.fit(docs, labels)
    other = quality_model.fit(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source"), labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"))
    probe = np.array([quality_model.statistics(t) for t in (CLEAN, "", "## " * 50)])
    assert np.allclose(one.scores(probe), other.scores(probe))


def test_classifier_edge_cases(spark):
    rows = [(i, CLEAN if i % 2 else "## $$ " * 40) for i in range(60)] + [(100, None), (101, ""), (7, CLEAN), (None, CLEAN)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(60)] + [(7, 1, "z"), (None, 1, "z"), (8, None, "z")], "doc_id long, quality int, text string")
    out = quality_model.scored(docs, quality_model.fit(docs, labels))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["text"] == CLEAN} == {1} and {r["predicted"] for r in got if (r["text"] or "").startswith("##")} == {0}
    assert quality_model.kept_documents(docs, labels).columns == docs.columns
    assert {r["score"] for r in quality_model.scored(docs, quality_model.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in quality_model.scored(docs, quality_model.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality_model.scored(table(spark, []), quality_model.fit(table(spark, []), labels)).collect() == []


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x, n = np.arange(50.0), rng.integers(1, 9, 50).astype(float)
    t = rng.uniform(0, 1, 50) * n
    at, p = quality_model.isotonic(x, t, n)
    assert (np.diff(p) >= -1e-12).all() and abs((np.interp(x, at, p) * n).sum() - t.sum()) < 1e-9


URLS = [
    ("http://a.example.org/en/1?x", "a.example.org", "/en/1", None), ("https://WWW.Example.COM/en/2#t", "www.example.com", "/en/2", "www.example.com/en/"),
    ("http://blog.example.com/en/3", "blog.example.com", "/en/3", "example.com/en/"), ("http://x.example.com", "x.example.com", "", None),
    ("http://x.example.com/de", "x.example.com", "/de", "com/"), ("http://x.example.net/fr/", "x.example.net", "/fr/", "net/fr/"), ("http://xnet/fr/", "xnet", "/fr/", None),
    ("no scheme/en/", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d?e://f", "b:", "//c/d", None), ("http://ÄB.com/x", "Äb.com", "/x", "com/"),
    ("http://?q", "", "", None), ("http://example.com/en/", "example.com", "/en/", "example.com/en/"), ("http://a.net/es/" + "y" * 9000, "a.net", "/es/" + "y" * 9000, "net/es/"),
]


def test_urls_rules_and_model(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "p", "r", "v", "s") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string, verdict string, score string")
    weights = url_filter.trained(url_filter.seed_table(spark))
    got = {r["page_id"]: r for r in url_filter.judged(pages, weights).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == url_filter.RULES[rule]
    unseen = ["http://m.casino-win.example.org/en/7", "https://www.cheap-pills.example.org/de/8.html", "http://free-bets.example.net/en/9", "http://blog.adult-x.example.org/en/1"]
    fine = ["http://tionble.example.org/en/7", "https://www.ththon.example.net/de/8.html", "http://m.thernd.example.org/en/9"]
    verdicts = [r["verdict"] for r in url_filter.judged(spark.createDataFrame([(u,) for u in unseen + fine], "url string").coalesce(1), weights).collect()]
    assert verdicts == ["block"] * len(unseen) + ["allow"] * len(fine)
    assert url_filter.judged(pages.limit(0), weights).collect() == []
    assert set(url_filter.trained(url_filter.seed_table(spark).limit(0), steps=1)) == {0.0}
    assert "Python" not in url_filter.judged(pages, weights)._jdf.queryExecution().toString()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies, many of them, all day and every day of the year.</div>
<!-- <p>comment</p> --><article><header><h1>Head&shy;line &lt;1&gt;</h1></header><p><b>First <i>par</i>agraph
   over lines.<br>Next &nbsp; line<p>Second a < b &amp; c, with 5 &gt; 4.</p><aside>Related things</aside><div class='ad'>Buy!</div><ul><li>Item one<li>Item two</ul>
<form><input value="x > y">Send <button>Go</button></form><p>Short.</p></article><section id="comments"><article class="comment">I say so.</article></section>
<footer>&copy; somebody</footer></body></html>"""


def test_main_text_of_a_full_page():
    want = "Head\xadline <1> First paragraph over lines. Next line Second a < b & c, with 5 > 4. Item one Item two Short."
    assert main_text.main_text(PAGE) == want
    unmarked = PAGE.replace("<article>", "<div class=body>").replace("</article><section", "</div><section").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert main_text.main_text(unmarked) == want


@pytest.mark.parametrize("page, want", [("", ""), ("plain text only", "plain text only"), ("<p>unclosed", "unclosed"), ("a < b", "a < b"), ("<nav>only menu</nav>", ""), ("<script>x", ""), ("<p title='a>b'>c", "c"), ("<!-- open", ""), ("&#65;&eacute;&am &amp", "Aé&am &")])
def test_main_text_of_small_pages(page, want):
    assert main_text.main_text(page) == want


STORY = [f"<p>Sentence {i} of the story goes on for quite a while, so that it is text and no menu.</p>" for i in range(4)]


def plain(*parts):
    return " ".join(re.sub(r"<[^>]*>", " ", "".join(parts)).split())


def test_all_text_between_surges_and_dives():
    box = "<aside><p>Other</p><p>things</p><p>to read</p><p>here</p></aside>"
    menu = "".join(f"<div class=x1>{w}</div>" for w in ("Home", "News", "Sport", "Shop")) + "".join(f"<div class=x2><a href=/{w}>{w} of the last week</a></div>" for w in "abcd")
    first, second = "".join(STORY), "".join(STORY[:2])
    assert main_text.main_text(f"<body>{menu}{first}{box}{second}{menu}<p>Bye.</p></body>") == plain(first, second)
    assert main_text.main_text(f"<div>{first}<p>Short.</p>{menu}{second}</div>") == plain(first, "<p>Short.</p>", second)
    assert main_text.stretches([500, 0, 0, 0, 400]) == [(0, 1), (2, 5)]
    assert main_text.stretches([8, 5, 9, 4, 500, 7, 400, 5, 8, 9, 4]) == [(2, 7)]


def test_marks_only_weigh():
    story, menu = "".join(STORY), "".join(f"<div class=x1>{w}</div>" for w in ("Home", "News", "Sport", "Shop"))
    teaser = "<article><h3>Another story</h3><div><a href=/b>Read the whole of it</a></div></article>"
    # no marks, a teaser beside the story, a main around the whole page
    for page in (f"{menu}{story}{menu}", f"{menu}{teaser}{menu}<div>{story}</div>{menu}", f"<div>{story}</div>{menu}{teaser}", f"<main>{menu}<div>{story}</div>{menu}</main>"):
        assert main_text.main_text(f"<body>{page}</body>") == plain(story)
    # boxes inside an article do not end it
    box = "<div class=ad><p>Buy</p><p>this</p><p>thing</p><p>now</p></div>"
    assert main_text.main_text(f"<body><article>{story}{box}<p>The end.</p></article></body>") == plain(story, "<p>The end.</p>")
    assert main_text.main_text("<nav>menu</nav><article><h1>One</h1></article><div>two</div>") == "One"


def test_unknown_and_misleading_names():
    story = "".join(STORY)
    # names nobody knows, a name that sounds like a box around the story, a headline in a "header"
    for page in (f"<div class=zq7>Buy now, only today.</div><article>{story}</article>", f"<article class='related-story'>{story}</article><div class=ad>Buy</div>",
                 f"<div class=ad>Buy this very thing now.</div><div class=promo-wrapper>{story}</div>", f"<article><div class='comment-style-2'>{story}</div></article>"):
        assert main_text.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>(c) all of us, for ever and a day</footer></body>") == plain(story)
    head = "<div class='post-header'><h1>What it is about</h1></div>"
    assert main_text.main_text(f"<body>{head}{story}</body>") == plain(head, story)
    # long comments beside a story that no element marks, and a short box in the midst of it
    comments = "".join(f"<p>Comment {i}: I liked this, and I have to say a few things about it too.</p>" for i in range(6))
    assert main_text.main_text(f"<body><div>{story * 2}</div><div id=comments>{comments}</div></body>") == plain(story * 2)
    box = "<div class='newsletter'><p>Get our letter every week by mail.</p></div>"
    assert main_text.main_text(f"<body><div>{story}{box}{story}</div></body>") == plain(story, story)


def test_main_text_of_a_deep_and_long_page():
    story = "".join(STORY) * 500
    assert main_text.main_text("<div>" * 3000 + story + "</div>" * 3000) == plain(story)


def test_main_text_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op9_main_text"](spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for p in pages:
        number = int(re.search(r"/(\d+)", p["url"].split("://")[1])[1])
        head = html.unescape(re.search(r"<h1>(.*?)</h1>", p["html"], re.S)[1])
        assert got[p["page_id"]]["text"] == " ".join(f"{head} {texts[number]}".split())
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
    odd = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>x", "t"), (1, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in main_text.extracted(odd).collect()) == ["", "x", "x"]
    assert main_text.extracted(odd.limit(0)).collect() == []


def test_pipeline_stages_and_whole_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, small)
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in seen.select("doc_id").collect()}
        seen = spark.createDataFrame(out.collect(), docs.schema)
    left = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert not [k for k in left if labels.get(k) == 0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, small).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    assert sorted(tuple(p) for p in corpus_pipeline.run(spark, small).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces)
