"""Distributed steps against brute force on small fixtures."""

import difflib
import itertools
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions import arrow
from pultwerk.operators import ordered, pages, retrieval, review, segmentation
from pultwerk.session import shared_dir


def test_ordered_primitives_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(-5, 9)) for i, g in enumerate(rng.choices(["a", "b", "c", None], [8, 1, 1, 6], k=700))]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    split = ordered.range_split(df, ["g"], ["i"])
    out = ordered.running(split, ["g"], ["i"], F.col("v"), "total")
    out = ordered.running(out, ["g"], ["i"], F.col("v"), "top", how="max", include_current=False)
    out = ordered.position(ordered.previous(out, ["g"], ["i"], "v", "before"), ["g"], ["i"], "place")
    got = {(r["g"], r["i"]): (r["total"], r["top"], r["before"], r["place"]) for r in out.collect()}
    assert split.select(ordered.PART).distinct().count() > 3
    for g in ("a", "b", "c", None):
        total, top, before = 0, None, None
        for place, (_, i, v) in enumerate([r for r in rows if r[0] == g], 1):
            total += v
            assert got[(g, i)] == (total, top, before, place)
            before, top = v, v if top is None else max(top, v)


@pytest.mark.parametrize("cutoff,k", [(1.3, 4), (None, 3), (0.4, 8)])
def test_search_is_exact(spark, monkeypatch, cutoff, k):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.25, (60, 4)) for c in (0.0, 0.6, 3.0)])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[::5], "query_id long, embedding array<double>")
    got = {}
    for r in retrieval.search(queries, chunks, k=k, cutoff=cutoff).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    for q, vector in rows[::5]:
        d = ((points - np.array(vector)) ** 2).sum(1)
        want = [int(i) for i in np.lexsort((np.arange(len(d)), d)) if cutoff is None or d[i] < cutoff][:k]
        assert [c for _, c in sorted(got.get(q, []))] == want


def test_range_numbers_follow_the_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "", "a", "ä", "z"]), rng.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, i long")
    out = ordered.range_split(df, ["g"], ["v", "i"])
    ordered_rows = sorted(out.collect(), key=lambda r: (r["g"] is not None, (r["g"] or "").encode(), r["v"] is not None, r["v"] or 0, r["i"]))
    parts = [r[ordered.PART] for r in ordered_rows]
    assert parts == sorted(parts) and len(set(parts)) > 3


@pytest.mark.parametrize("cutoff", [None, 1.5])
def test_a_block_is_compared_in_slices(cutoff):
    rng = np.random.default_rng(8)
    left, right = rng.normal(size=(900, 6)).round(1), rng.normal(size=(3000, 6)).round(1)
    right[1000:1600] = right[7]
    own = np.array([(i, 2 * i) for i in range(900)])
    bound = np.where(np.arange(900) % 3 == 0, np.inf, 2.0)
    tracemalloc.start()
    rows, cols, d = retrieval._nearest_pairs(left, right, bound, 5, cutoff, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the table of all distances would take 21.6 MB, and several times that while it is made
    assert peak < 16e6
    want = []
    for i in range(900):
        away = np.round(((left[i] - right) ** 2).sum(1), 9)
        best = [j for j in np.lexsort((np.arange(3000), away)) if j != 2 * i and away[j] <= bound[i] and (cutoff is None or away[j] < cutoff)][:5]
        want += [(i, int(j), float(away[j])) for j in best]
    assert list(zip(rows.tolist(), cols.tolist(), d.tolist())) == want


def test_reached_cells_are_found_in_slices(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(3 * retrieval.SLICE_ROWS + 5, 4)))]
    cells = retrieval.cells_of(spark.createDataFrame(rows, "chunk_id long, embedding array<double>").coalesce(1))
    asked = retrieval.own_cells(spark.createDataFrame(rows, "query_id long, embedding array<double>").coalesce(1), cells)
    own = {r["query_id"]: r["cells"] for r in asked.collect()}
    others = {r["query_id"]: r["cells"] for r in retrieval.other_cells(asked, spark.createDataFrame([], "query_id long, distance double"), cells, 3, None).collect()}
    every = {int(c) for c in np.flatnonzero(cells.sizes)}
    assert len(own) == len(rows) and all(set(others[q]) == every - set(own[q]) for q in own)


def test_chunks_cover_the_text(spark):
    text = "Ein Satz mit Inhalt. " * 200 + "\n\n" + "x" * 2000 + " Schluss äöü."
    rows = spark.createDataFrame([(1, text, "s", "personal"), (2, "kurz", "s", "personal"), (3, "  ", "s", "personal")], "doc_id long, text string, source string, classification string")
    chunks = [r["chunk"] for r in retrieval.chunk_rows(rows).orderBy("doc_id", "chunk_no").collect()]
    assert all(60 < len(c) <= 900 for c in chunks) and chunks[0].endswith(".") and chunks[-1].endswith("äöü.")
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - 200))
        assert found >= 0 and found <= at + 70  # a piece of up to 60 characters may be dropped
        at = max(at, found + len(c))
    report = {r["doc_id"]: r["rejected"] for r in retrieval.ingest_report(rows).collect()}
    assert report == {1: None, 2: "too_short", 3: "empty"}


def walk(events, critical):
    """The review rules as a plain walk through one job's events."""
    status, edited = None, set()
    for kind, region, problem in events:
        if status is None:
            status = "processing" if kind == "create" else None
        elif status == "deleted":
            continue
        elif kind == "delete":
            status = "deleted"
        elif kind in ("complete", "fail") and status == "processing":
            status = "needs_review" if kind == "complete" else "failed"
        elif kind == "edit" and status in ("needs_review", "approved") and not problem:
            edited.add(region)
            status = "needs_review"
        elif kind == "approve" and status == "needs_review" and not critical - edited:
            status = "approved"
    return status


def test_job_states_match_a_walk(spark):
    rng = random.Random(11)
    kinds, weights = ["create", "complete", "fail", "edit", "approve", "delete"], [3, 4, 0.4, 6, 5, 0.6]
    jobs = {j: [(rng.choices(kinds, weights)[0], rng.randint(0, 2), rng.random() < 0.2) for _ in range(rng.randint(1, 25))] for j in range(200)}
    critical = {j: {r for r in range(3) if rng.random() < 0.4} for j in jobs}
    order = itertools.count()
    rows = [(j, next(order), k, r, p) for j, es in jobs.items() for k, r, p in es]
    events = spark.createDataFrame([(j, i, i, k, r, p) for j, i, k, r, p in rows], "job_id long, ts long, event_id long, kind string, region_id long, problem boolean")
    crit = spark.createDataFrame([(j, r) for j, rs in critical.items() for r in rs], "job_id long, region_id long")
    accepted = events.filter("kind = 'edit' and not problem")
    got = {r["job_id"]: r["status"] for r in review.job_states(events, crit, accepted).collect()}
    want = {j: walk(es, critical[j]) for j, es in jobs.items()}
    assert got == {j: s for j, s in want.items() if s is not None}


def test_word_lines_follow_the_growing_line(spark):
    boxes = [(1, i, x, y0, x + 5, y1) for i, (x, y0, y1) in enumerate([(0, 0, 10), (6, 5, 15), (12, 9, 20), (0, 30, 40), (6, 30, 30)])]
    df = spark.createDataFrame(boxes, "page_id long, box_id long, x0 long, y0 long, x1 long, y1 long")
    lines = {r["box_id"]: r["line"] for r in segmentation.word_lines(df).collect()}
    # box 2 overlaps the grown line (0–15) by 6 of 11, though box 0 alone by 1 of 10
    assert lines == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def decide(spark, regions, page=("personal", True, False), failures=(), required=(), exhausted=None):
    cols = "job_id int, page int, region_id int, n_readers int, n_disagreements int, critical boolean, agreement double, mean_confidence double, engines array<string>"
    df = spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(regions)], cols)
    p = spark.createDataFrame([(1, 0, *page)], "job_id int, page int, classification string, auto_approve boolean, quality_blocking boolean")
    f = spark.createDataFrame([(1, 0, e) for e in failures], "job_id int, page int, engine string")
    r = pages.decide_pages(p, df, f, list(required), exhausted).first()
    return r["status"], r["reasons"]


def test_page_decisions(spark):
    clean = (2, 0, False, 1.0, 0.9, ["htr", "tesseract"])
    assert decide(spark, [clean], ("student_submission", True, False)) == ("needs_review", [])
    assert decide(spark, [clean]) == ("approved", []) and decide(spark, [clean], ("personal", False, False)) == ("needs_review", [])
    assert decide(spark, [clean], ("personal", True, True)) == ("needs_review", ["image_quality"])
    assert decide(spark, [(1, 0, False, 0.0, 0.9, ["htr"])]) == ("needs_review", ["low_agreement", "single_engine"])
    assert decide(spark, [(0, 0, False, 0.0, None, [])], failures=["htr"], required=["htr"]) == ("failed", ["engine_unavailable:htr", "no_candidates"])
    assert decide(spark, [clean, (2, 1, True, 0.5, 0.4, ["htr", "tesseract"])])[1] == ["critical_uncertainty", "low_agreement", "low_confidence"]


def test_second_reading_budget(spark):
    cols = "job_id int, page int, region_id int, n_readers int, n_disagreements int, critical boolean, agreement double, mean_confidence double"
    rows = [(1, 0, 0, 2, 0, False, 1.0, 0.9), (1, 0, 1, 2, 1, False, 0.5, 0.9), (1, 0, 2, 2, 1, True, 0.9, 0.9), (1, 0, 3, 2, 0, False, 1.0, 0.4), (1, 0, 4, 1, 0, False, 0.0, 0.9)]
    flagged = pages.needs_second_reading(spark.createDataFrame(rows, cols))
    assert {r["region_id"] for r in flagged.filter("suspicious").collect()} == {1, 2, 3, 4}
    assert [r["region_id"] for r in pages.second_reading_selection(flagged, 2).orderBy("rank").collect()] == [2, 4]
    assert pages.exhausted_pages(flagged, 2).count() == 1 and pages.exhausted_pages(flagged, 4).count() == 0


def test_revision_conflict(spark):
    rows = [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 1), (2, 1, 4, 5)]
    got = {r["event_id"]: (r["accepted"], r["revision"]) for r in review.check_revisions(spark.createDataFrame(rows, "state_id long, ts long, event_id long, expected long")).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 2), 4: (False, 0)}


def test_retention_and_orphans(spark):
    jobs = spark.sql("SELECT * FROM VALUES ('old', timestamp_ntz'2026-01-01 00:00:00'), ('new', timestamp_ntz'2026-04-05 00:00:00') AS t(folder, created_at)")
    assert [r["folder"] for r in review.expired_jobs(jobs, "2026-04-11 00:00:00", 30).collect()] == ["old"]
    inv = spark.sql("SELECT * FROM VALUES ('lost', timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-04-10 00:00:00'), ('fresh', timestamp_ntz'2026-04-10 00:00:00', NULL), ('bad name!', timestamp_ntz'2026-01-01 00:00:00', NULL), ('old', timestamp_ntz'2026-01-01 00:00:00', NULL) AS t(folder, created_at, modified_at)")
    assert [r["folder"] for r in review.orphans(inv, jobs, "2026-04-11 00:00:00", 30).collect()] == ["lost"]


def test_checkpoint_folder_is_read_from_the_session(spark):
    assert shared_dir(spark)


def test_long_readings_are_aligned_in_one_pass():
    ref = [f"w{i}" for i in range(20000)]
    other = ["x" if i % 10 == 4 else t for i, t in enumerate(ref)]
    start = time.perf_counter()
    codes = arrow._codes(ref, other)
    assert time.perf_counter() - start < 2
    assert codes[:10] == [1, 0, 4, 0, 4, 0, 4, 5, 4, 5] and len(codes) == 5 * 4001


def test_alignment_with_and_without_repeated_tokens():
    rng = random.Random(11)
    for size in (1, 2, 4, 60, 1000) * 60:
        ref = [f"t{rng.randrange(size)}" for _ in range(rng.randrange(30))]
        other = [t for t in ref if rng.random() > 0.1] + ref[:rng.randrange(3)]
        want = [x for tag, *b in difflib.SequenceMatcher(None, ref, other, autojunk=False).get_opcodes() for x in (int(tag == "equal"), *b)]
        assert arrow._codes(ref, other) == (want or [1, 0, 0, 0, 0])


def test_dashes_and_quotes_are_unified():
    text = "\x00".join(["a\u2011b", "c\u2013\u2212d", "\u201ee\u201dx", "f\u2019s", 'g"h', "i-j", "\u00abk\u00bb"])
    assert arrow._normal(text) == [t.strip(fv.EDGE_PUNCTUATION) for t in ("a-b", "c--d", "'e'x", "f's", "g'h", "i-j", "'k'")]
