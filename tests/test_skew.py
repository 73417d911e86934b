"""Hot groups, keyed stores and long inputs against plain loops."""

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pultwerk.functions import arrow
from pultwerk.operators import consensus, lessons, ordered, pseudonym, retrieval, review, usage
from pultwerk.sources import record_store
from pultwerk.sources.record_store import Kept
from pultwerk.streaming import jobs


def test_revisions_of_a_hot_state_equal_a_walk(spark):
    rng, rows, now = random.Random(9), [], {}
    for i in range(3000):
        state = rng.choices([7, 1, 2, 3, None], [80, 10, 5, 4, 1])[0]
        guess = now.get(state, 0) + rng.choice([0, 0, 0, -1, 1, 5])
        # some expectations lie far ahead and come true much later
        expected = rng.choice([guess, guess, rng.randrange(900), None])
        rows.append((state, i // 3, i, expected))
        now[state] = now.get(state, 0) + (expected == now.get(state, 0))
    want, revision = {}, {}
    for state, _, i, expected in rows:
        hit = state is not None and expected == revision.get(state, 0)
        revision[state] = revision.get(state, 0) + hit
        want[i] = (hit, revision[state])
    df = spark.createDataFrame(rows, "state_id long, ts long, event_id long, expected long").repartition(6)
    split = ordered.range_split(df.filter("state_id = 7"), ["state_id"], ["ts", "event_id"])
    assert split.select(ordered.PART).distinct().count() > 4
    got = review.check_revisions(df).collect()
    assert {r["event_id"]: (r["accepted"], r["revision"]) for r in got} == want
    assert review.check_revisions(df.limit(0)).collect() == []


def test_revisions_when_every_state_is_small(spark):
    df = spark.createDataFrame([(i % 500, i, i, i // 500) for i in range(1500)], "state_id long, ts long, event_id long, expected long")
    assert review.check_revisions(df).filter("not accepted or revision <> expected + 1").count() == 0


def test_sessions_of_a_hot_user_equal_a_loop(spark):
    rng, start = random.Random(1), dt.datetime(2026, 3, 1)
    rows, at = [], {}
    for i in range(2500):
        user = rng.choices([1, 2, 3], [20, 2, 1])[0]
        at[user] = at.get(user, start) + dt.timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31, 200] if user > 1 else [0, 1, 2, 3, 30] if i % 40 == 0 else [0, 1, 2]))
        rows.append((user, at[user], i, rng.randrange(100)))
    rows.append((4, None, 9999, 5))
    want, open_ = {}, {}
    for user, ts, _, tokens in sorted((r for r in rows if r[1]), key=lambda r: (r[0], r[1], r[2])):
        first, last = open_.get(user, (None, None))
        if last is None or ts - last >= dt.timedelta(minutes=30):
            first = ts
        open_[user] = (first, ts)
        total, n = want.get((user, first), (0, 0))
        want[user, first] = (total + tokens, n + 1)
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, request_id long, total_tokens long").repartition(5)
    got = usage.session_tokens(df).withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).collect()
    assert {(r["user_id"], r["session_start"]): (r["session_tokens"], r["requests"]) for r in got} == want


def test_costs_of_a_table_without_skills(spark):
    plan = spark.createDataFrame([("gpt-4", None, 1_000_000, 0)], "model string, provider string, input_tokens long, output_tokens long")
    row = usage.cost_estimate(plan).first()
    assert row["estimated_input_cost_usd"] == row["price_per_million_input"] == row["estimated_total_cost_usd"]
    assert "skill_name" not in usage.with_cost(plan).columns
    named = plan.withColumn("skill_name", F.lit(""))
    assert usage.with_cost(named).first()["skill_name"] is None


def test_borders_weigh_tasks_by_their_rows(spark):
    big, small = spark.range(20000).select("id", F.lit("x").alias("g")).coalesce(1), spark.range(50).select((F.col("id") + 10**6).alias("id"), F.lit("x").alias("g")).repartition(5)
    split = ordered.range_split(big.unionByName(small), ["g"], ["id"])
    sizes = [r["count"] for r in split.groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 20050 / 8
    like = ordered.range_split(small, ["g"], ["id"], like=big)
    assert like.select(ordered.PART).distinct().count() == 1


@pytest.mark.parametrize("cutoff", [None, 1.3])
def test_search_compares_far_fewer_pairs_than_there_are(spark, monkeypatch, cutoff):
    monkeypatch.setattr(retrieval, "LEAST_CELLS", 64)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 16)) * 6
    points = middles[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)
    queries = chunks.withColumnRenamed("chunk_id", "query_id")
    cells = retrieval.cells_of(chunks)
    asked = retrieval.own_cells(queries, cells)
    near = retrieval._ranked(retrieval._visited(asked, cells, 4, cutoff, True), 4).drop("rank")
    more = retrieval.other_cells(asked, near, cells, 4, cutoff)
    assert retrieval.pairs_compared(asked, cells) + retrieval.pairs_compared(more, cells) < 3000 * 3000 / 8
    got = {}
    for r in retrieval.search(queries, chunks, 4, cutoff, True, cells).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    d = ((points[:, None] - points[None]) ** 2).sum(-1).round(9)
    np.fill_diagonal(d, np.inf)
    for q in range(0, 3000, 37):
        want = [int(i) for i in np.lexsort((np.arange(3000), d[q]))[:4] if cutoff is None or d[q, i] < cutoff]
        assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == want


def learner_root(spark, folder, n=120):
    students = spark.createDataFrame([(i, f"Kind{i % 100}", f"Name{i % 100}", i % 5, "sie") for i in range(n)], "student_id long, given_name string, family_name string, class_id long, pronoun string")
    notes = spark.createDataFrame([(1000 + i, i % n, "Mathe", "Brüche") for i in range(400)], "obs_id long, student_id long, subject string, competency string")
    name = F.concat_ws(" ", "given_name", "family_name")
    record_store.create(folder, students, notes, students.select(name.alias("real"), F.lit("SuS-01").alias("alias")).distinct(), notes.select(F.col("obs_id").alias("document_id"), F.lit("Text").alias("chunk")))
    return folder


def files_of(folder):
    return {str(p) for p in Path(folder).rglob("part-*") if "/_" not in str(p)}


def test_erasure_leaves_no_trace_and_touches_only_its_buckets(spark, tmp_path):
    root = learner_root(spark, str(tmp_path / "l"))
    patch = spark.createDataFrame([(3, "Neu", None, None, None), (60, "Anders", None, None, None), (500, "Dazu", "Gekommen", 1, "er")], "student_id long, given_name string, family_name string, class_id long, pronoun string")
    record_store.upsert(spark, root, patch, ["given_name", "family_name", "class_id", "pronoun"])
    index = {r["student_id"]: r["name"] for r in record_store.read(spark, root, Kept("index")).collect()}
    assert index[3] == "Neu Name3" and index[500] == "Dazu Gekommen" and index[4] == "Kind4 Name4" and len(index) == 121
    assert [r["student_id"] for r in record_store.raw(spark, root, Kept("versions")).orderBy("student_id").collect()] == [3, 60]
    before = files_of(root)
    # 7 shares its name with 107, 3 had one in common with 103, 60 is known by an old name too
    record_store.erase(spark, root, spark.createDataFrame([(3,), (55,), (60,), (7,), (None,)], "student_id long"))
    gone = {3, 55, 60, 7}
    notes = {1000 + i for i in range(400) if i % 120 in gone}
    for kept in record_store.LEARNER_TABLES:
        keys = {r[0] for r in record_store.raw(spark, root, kept).select(kept.key).collect()}
        assert not keys & (gone | notes), kept
        assert keys or kept.name == "versions"
    names = {r["real"] for r in record_store.raw(spark, root, Kept("aliases", "real")).collect()}
    assert not names & {"Kind55 Name55", "Kind60 Name60", "Neu Name3"} and "Kind3 Name3" in names and "Kind7 Name7" in names and "Kind4 Name4" in names
    assert len(names) == 98 and len(notes) == 14
    # a bucket of the records holds about four learners: most files are the same as before
    assert len(files_of(root) & before) > len(before) * 0.6
    stones = spark.read.parquet(f"{root}/_tombstones").collect()
    assert all(len(r["hashed"]) == 64 for r in stones) and record_store.settle(spark, root) == 0


def test_erasure_cut_short_is_hidden_at_once_and_settled_later(spark, tmp_path, monkeypatch):
    root = learner_root(spark, str(tmp_path / "l"))
    moved, real = [], record_store.folders.move

    def broken(spark_, old, new):
        if len(moved) == 3:
            raise OSError("lost")
        moved.append(old)
        real(spark_, old, new)

    monkeypatch.setattr(record_store.folders, "move", broken)
    with pytest.raises(OSError):
        record_store.erase(spark, root, spark.createDataFrame([(11,), (12,), (13,)], "student_id long"))
    monkeypatch.setattr(record_store.folders, "move", real)
    assert record_store.settle(spark, root) == 1 and record_store.settle(spark, root) == 0
    for kept, n in ((Kept("records"), 117), (Kept("index"), 117), (Kept("observations"), 400 - 12)):
        raw = record_store.raw(spark, root, kept)
        assert raw.count() == n and raw.filter("student_id IN (11, 12, 13)").isEmpty()


def test_alias_map_over_many_batches(spark, tmp_path):
    path = str(tmp_path / "map")
    write, store = jobs.grow_alias_map(path), jobs.alias_store(path)
    names, rng = [f"Kind {i}" for i in range(60)], random.Random(3)
    want, batches = {}, [[(rng.choice(names), b * 10 + i) for i in range(rng.choice([0, 2, 4]))] for b in range(9)]
    for b, rows in enumerate(batches):
        for name, _ in sorted(rows, key=lambda r: r[1]):
            want.setdefault(name, f"SuS-{len(want) + 1:02d}")
        for _ in range(1 + (b == 4)):  # one batch runs twice
            write(spark.createDataFrame(rows, "name string, seen long"), b)
    assert {r["real"]: r["alias"] for r in store.read(spark).collect()} == want
    # of every bucket the newest snapshot and the one before are there, whatever the number of batches
    assert all(len(list(p.glob("batch=*"))) <= 2 for p in Path(path).glob("bucket=*"))


def test_review_events_of_a_hot_job_are_streamed(spark, tmp_path):
    kinds = ["create", "complete"] + ["edit"] * 4000 + ["approve"]
    rows = [(1, i, i, k, i % 7, None, "2,5", None) for i, k in enumerate(kinds)] + [(2, 0, 9000, "edit", 1, None, "", None)]
    schema = "job_id long, ts long, event_id long, kind string, region_id long, problem string, critical_regions string, completed_as string"
    write = jobs.write_review_outcomes(str(tmp_path / "r"))
    df = spark.createDataFrame(rows, schema).repartition(4)
    write(df.filter("event_id < 2000 or job_id = 2"), 0)
    write(df.filter("event_id >= 2000 and job_id = 1"), 1)
    got = {r["event_id"]: (r["outcome"], r["status"]) for r in jobs.review_outcomes(spark, str(tmp_path / "r")).collect()}
    assert got[4002] == ("approved", "approved") and got[9000] == ("not_found", None)
    assert {got[i] for i in range(2, 4002)} == {("edited", "needs_review")} and len(got) == 4004


def plain_merge(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def test_merged_ranges_equal_a_loop(spark):
    rng = random.Random(5)
    cases = [[(a, a + rng.randrange(4)) for a in (rng.randrange(40) for _ in range(rng.randrange(12)))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, r array<struct<s:int,e:int>>").withColumn("m", consensus.merge_ranges(F.col("r")))
    for row in df.collect():
        assert [(x["s"], x["e"]) for x in row["m"]] == plain_merge(cases[row["i"]])
    assert spark.createDataFrame([([1, 2, 3],), (None,), ([],)], "n array<int>").select(arrow.running_sums("n").alias("n")).collect() == [([1, 3, 6],), (None,), ([],)]


def test_region_of_twenty_thousand_tokens(spark):
    ref = [f"w{i}" for i in range(20000)]
    other = ["x" if i % 10 == 4 else t for i, t in enumerate(ref)]
    df = spark.createDataFrame([(0, 0, 0, p, e, " ".join(t), 0.9) for p, (e, t) in enumerate((("htr", ref), ("tesseract", other)))],
                               "job_id int, page int, region_id int, pos int, engine string, text string, confidence double")
    row = consensus.build_regions(df).first()
    assert row["n_disagreements"] == 2000 and row["consensus_text"].startswith("w0 w1 w2 w3 [w4|x?] w5")
    for d in row["disagreements"][::97]:
        assert row["consensus_text"][d["char_start"]:d["char_end"]] == f"[w{d['start']}|x?]"


def test_answers_are_kept_once_per_distinct_ask(spark):
    asks = spark.createDataFrame([(i, "Mathe", 7, 1) for i in range(500)] + [(900, "Mathe", 1, 1), (901, None, 7, 1)], "ask_id long, subject string, class_level long, state_id long")
    plan = spark.createDataFrame([(t, "Mathe", f"T{t}", 5, 9, t % 3) for t in range(30)], "topic_id long, subject string, title string, class_from long, class_to long, state_id long")
    assert lessons.curriculum_answers(asks, plan).count() == 1
    got = {r["ask_id"]: len(r["entries"]) for r in lessons.answered_asks(asks, plan).collect()}
    assert got == {**{i: 20 for i in range(500)}, 900: 0, 901: 0}
    assert lessons.curriculum_lookup(asks, plan).count() == 500 * 20


def test_lookup_makes_no_lists_and_equals_a_loop(spark):
    asks = [(i, s, level, state) for i, (s, level, state) in enumerate([("Mathe", 7, 1), ("Mathe", 7, 0), ("Mathe", 5, None), ("Mathe", None, 1), (None, 7, 1), ("Bio", 9, 2)] * 2)] + [(0, "Mathe", 7, 1)]
    plan = [(t, s, f"T{t}", 5, 5 + t % 5, state) for t, s in ((t, "Mathe" if t % 3 else "Bio") for t in range(30)) for state in (t % 3,)] + [(3, "Mathe", None, 7, 7, 1)] * 2
    want = sorted((a, t, title, cs == 0) for a, s, level, state in asks for t, cu, title, low, high, cs in plan
                  if s == cu and level is not None and low <= level <= high and cs in (state, 0))
    out = lessons.curriculum_lookup(
        spark.createDataFrame(asks, "ask_id long, subject string, class_level long, state_id long"),
        spark.createDataFrame(plan, "topic_id long, subject string, title string, class_from long, class_to long, state_id long"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr) and want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_names_are_replaced_longest_first_at_word_edges(spark):
    rows = [
        (1, "Anna Meier und Anna, Annabell; Meier.", ["Anna", "Anna Meier", "Meier"]),
        (2, "O'Neil traf O'Neil-Kraft. (Udo) Udo!", ["O'Neil", "(Udo)", "O'Neil-Kraft"]),
        (3, "Anna Meier Kraft", ["Anna Meier", "Meier Kraft x", "Meier Kraft"]),
        (4, "nichts", []), (5, None, ["Anna"]), (6, "Ein Jörg. jörg JÖRG Jörg2", ["Jörg", " ", None]), (7, "a.b a.b. xa.b", ["a.b"]), (8, "Anna\nMeier Anna  Meier", ["Anna Meier"]),
    ]
    aliases = spark.createDataFrame([(n, f"SuS-{i:02d}") for i, n in enumerate(["Anna", "Anna Meier", "Meier", "O'Neil", "(Udo)", "O'Neil-Kraft", "Meier Kraft", "Jörg", "a.b"], 1)], "real string, alias string")
    out = pseudonym.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, names array<string>"), aliases)
    assert {r["doc_id"]: r["pseudonymized"] for r in out.collect()} == {
        1: "SuS-02 und SuS-01, Annabell; SuS-03.", 2: "SuS-04 traf SuS-06. SuS-05 Udo!", 3: "Anna SuS-07", 4: "nichts", 5: None,
        6: "Ein SuS-08. jörg JÖRG Jörg2", 7: "SuS-09 SuS-09. xa.b", 8: "Anna\nMeier Anna  Meier"}
