"""Readers and writers on real files, and streams fed in several batches."""

import datetime as dt
import difflib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pultwerk.functions import arrow, reading
from pultwerk.operators import consensus, retrieval, usage
from pultwerk.plans import stream_queries, written_files
from pultwerk.sources import logs, manifest, results, sse, usage_files
from pultwerk.sources.tables import view
from pultwerk.streaming import jobs


def test_usage_files_round_trip(spark, tmp_path):
    rows = [{"request_id": "1", "ts": "2026-01-31T23:30:00+02:00", "model": "gpt-4", "input_tokens": 1000, "output_tokens": 500, "skill_name": "A/b"},
            {"request_id": "2", "ts": "2026-02-01T00:10:00Z", "model": "x", "input_tokens": 10, "output_tokens": 5}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n", encoding="utf-8")
    events = usage_files.read_events(spark, str(tmp_path / "in"))
    assert sorted((r["request_id"], r["day"]) for r in usage.period_keys(events).collect()) == [("1", "2026-01-31"), ("2", "2026-02-01")]
    priced = usage.with_cost(events)
    usage_files.write_json_report(usage.rollups(priced), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter("period = 'total'").first()["total_tokens"] == 1515
    usage_files.write_csv(usage_files.monthly_csv(usage.usage_by_month(priced)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Month", "Total Tokens", "Input Tokens", "Output Tokens", "Cost (USD)", "Requests"]
    usage_files.write_text(usage.report_lines(usage.usage_total(priced), usage.usage_by_month(priced), usage.usage_by_skill(priced)), str(tmp_path / "txt"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert lines[0] == "Total Tokens: 1,515" and lines[6].startswith("2026-02: $") and lines[7].startswith("2026-01: $") and lines[8].endswith("(1x)")


def test_logs_with_several_entries(spark, tmp_path):
    (tmp_path / "mathe_7a_brüche.md").write_text(
        "# Log\n\n## 01.02.2026 – Mathe Klasse 7a: Brüche\n- Lernziel: kürzen\n- Methoden: Vortrag, Gruppe\n- Feedback nach der Stunde:\n\n"
        "## 02.02.2026 – Bio Klasse 8: Zelle\n- Lernziel: Zelle\n- Methoden: Film\n- Feedback nach der Stunde: gut\n", encoding="utf-8")
    files = logs.read_files(spark, str(tmp_path))
    got = [(r["held_on"], r["subject"], r["class_name"], r["topic"], r["methods"], r["feedback"]) for r in logs.lesson_log(files).orderBy("pos").collect()]
    assert got == [("01.02.2026", "Mathe", "7a", "Brüche", ["Vortrag", "Gruppe"], None), ("02.02.2026", "Bio", "8", "Zelle", ["Film"], "gut")]


def test_result_documents_skip_corrupt_and_fill_defaults(spark, tmp_path):
    good = {"jobId": "j", "pages": [{"index": 0, "regions": [{"id": "r", "candidates": [], "disagreements": [{"start": 0, "end": 1, "critical": True, "reason": "unit"}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(good), encoding="utf-8")
    (tmp_path / "b.json").write_text('{"jobId": "k", "pages": [', encoding="utf-8")
    docs = results.read_documents(spark, str(tmp_path))
    rows = results.region_rows(docs)
    assert [r["scanCleanupStatus"] for r in docs.collect()] == ["retained"]
    assert [(r["edited"], r["verify_failed"]) for r in rows.collect()] == [(False, False)]
    assert results.disagreement_rows(rows).first()["char_start"] == -1 and results.candidate_rows(rows).first()["engine"] is None


def test_stream_of_model_output(spark):
    lines = [": ping", 'data: {"choices":[{"delta":{"content":"Hal"}}]}', "data: {bad", 'data: {"choices":[{"delta":{"content":"lo"}}],"usage":{"prompt_tokens":3,"completion_tokens":2}}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"!"}}]}']
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "id long, pos int, value string")
    r = sse.reassemble(df, ["id"]).first()
    assert (r["text"], r["prompt_tokens"], r["completion_tokens"]) == ("Hallo", 3, 2)


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "students").mkdir()
    for name in ("a.md", "a.md.bak1", "b.txt", "students/c.md"):
        (tmp_path / name).write_text("x" * len(name), encoding="utf-8")
    inventory = manifest.read_inventory(spark, str(tmp_path))
    listed = manifest.manifest(inventory)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in listed.collect()) == ["a.md", "a.md.bak1"]
    changed = listed.withColumn("sha256", F.when(F.col("path").endswith(".bak1"), "0").otherwise(F.col("sha256")))
    assert sorted(r["status"] for r in manifest.verify(changed, listed).collect()) == ["hash_mismatch", "ok"]


def test_chunk_table_is_partitioned(spark, tmp_path, small):
    retrieval.write_chunks(retrieval.ingest(view(spark, small, "docs")), str(tmp_path / "chunks"))
    plan = spark.read.parquet(str(tmp_path / "chunks")).filter("classification = 'personal'")
    assert "classification=personal" in plan.first().asDict().__repr__() or plan.count() > 0
    assert (tmp_path / "chunks" / "classification=personal").is_dir()


def test_alignment_is_that_of_the_standard_library(spark):
    rng = random.Random(2)
    rows = [[" ".join(rng.choices("abcde", k=rng.randint(0, 12))) for _ in range(3)] for _ in range(40)]
    df = spark.createDataFrame([(i, [t.replace(" ", "\x00") for t in r]) for i, r in enumerate(rows)], "i int, t array<string>")
    for r in df.select("i", arrow.align("t").alias("c")).collect():
        first, *rest = [t.split() for t in rows[r["i"]]]
        for codes, other in zip(r["c"], rest):
            want = [x for tag, *b in difflib.SequenceMatcher(None, first, other, autojunk=False).get_opcodes() for x in (int(tag == "equal"), *b)]
            assert codes == (want or [1, 0, 0, 0, 0])


def test_consensus_keeps_the_reference_text(spark):
    rng = random.Random(4)
    words = ["der", "nicht", "Wert", "3,5", "8,5", "m", "km", "Satz.", "ja", "-4"]
    cases = [(i, [" ".join(rng.choices(words, k=rng.randint(1, 15))) for _ in range(3)]) for i in range(60)]
    rows = [(0, 0, i, pos, e, t, 0.9) for i, ts in cases for pos, (e, t) in enumerate(zip(("htr", "ollama_vlm", "tesseract"), ts))]
    df = spark.createDataFrame(rows, "job_id int, page int, region_id int, pos int, engine string, text string, confidence double")
    for r in consensus.build_regions(df).collect():
        text, ref = r["consensus_text"], dict(cases)[r["region_id"]][0]
        out, at = "", 0
        for d in r["disagreements"]:
            assert reading.BRACKET.fullmatch(text[d["char_start"]:d["char_end"]]) and {"htr"} <= set(d["variants"][0]["engines"])
            out, at = out + text[at:d["char_start"]] + d["variants"][0]["text"], d["char_end"]
        assert (out + text[at:]).split() and (out + text[at:]).replace(" ", "") == ref.replace(" ", "")


def feed(spark, folder, rows, schema, parts):
    """Rows as one file per batch, read in order."""
    for n, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/part={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


def run_batches(stream, writer, checkpoint):
    jobs.run_to_end(stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def test_sticky_mode_over_batches(spark, tmp_path):
    rows = [(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False), (1, 3, False)]
    src = feed(spark, str(tmp_path / "in"), rows, "conv_id long, turn long, is_local boolean", [[0, 3], [1], [2, 4]])
    run_batches(src, jobs.write_sticky_privacy(str(tmp_path / "sticky")), str(tmp_path / "cp"))
    got = {(r["conv_id"], r["turn"]): r["sticky_mode"] for r in spark.read.parquet(str(tmp_path / "sticky/modes")).collect()}
    assert got == {(1, 0): "auto", (1, 1): "local_required", (1, 2): "local_required", (1, 3): "local_required", (2, 0): "auto"}


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path):
    # an earlier turn may lie in a later file of the same arrival
    rows = [(c, t, "user", f"Mail an a{c}@b.de" if t == c % 9 + 1 else "Wie geht das?") for c in range(40) for t in range(12)]
    random.Random(8).shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    folder = stream_queries.by_batch(stream_queries.in_batches(spark, str(tmp_path), "requests", "turn").withColumn("is_local", F.col("text").startswith("Mail")), jobs.write_sticky_privacy)
    got = spark.read.parquet(f"{folder}/modes")
    assert got.select("batch").distinct().count() == 3
    assert {(r["conv_id"], r["turn"]): r["sticky_mode"] for r in got.collect()} == {(c, t): "local_required" if t > c % 9 else "auto" for c, t, *_ in rows}


def test_turns_of_a_batch_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def marked(turn):
        seen.add(1)
        return turn == 1

    src = feed(spark, str(tmp_path / "in"), [(1, 0), (1, 1), (2, 0)], "conv_id long, turn long", [[0, 1, 2]])
    run_batches(src.withColumn("is_local", F.udf(marked, "boolean").asNondeterministic()("turn")), jobs.write_sticky_privacy(str(tmp_path / "sticky")), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "sticky/modes")).count() == 3 and seen.value == 3


def test_review_machine_over_batches(spark, tmp_path):
    kinds = ["approve", "create", "edit", "complete", "approve", "edit", "edit", "approve", "edit", "approve", "delete", "approve"]
    rows = [(1, dt.datetime(2026, 1, 1, 0, i), i, k, 2, "empty_patch" if i == 5 else None, "2", None) for i, k in enumerate(kinds)]
    src = feed(spark, str(tmp_path / "in"), rows, "job_id long, ts timestamp, event_id long, kind string, region_id long, problem string, critical_regions string, completed_as string",
               [[0, 1, 2], [3, 4], [5, 6, 7], [8, 9, 10, 11]])
    run_batches(src, jobs.write_review_outcomes(str(tmp_path / "review")), str(tmp_path / "cp"))
    got = [r["outcome"] for r in jobs.review_outcomes(spark, str(tmp_path / "review")).orderBy("event_id").collect()]
    assert got == ["not_found", "created", "not_ready", "completed", "critical_uncertainty", "empty_patch", "edited", "approved", "edited", "approved", "deleted", "not_found"]


def test_late_events_and_aliases_over_batches(spark, tmp_path):
    schema = "request_id long, ts timestamp_ntz, user_id long, model string, provider string, input_tokens long, output_tokens long, skill_name string"
    rows = [(i, dt.datetime(2026, 1, d), 1, "gpt-4", None, 1000, 0, None) for i, d in enumerate([1, 9, 1, 2])]
    src = feed(spark, str(tmp_path / "u"), rows, schema, [[0], [1], [2, 3]])
    jobs.run_to_end(src.writeStream.foreachBatch(jobs.write_partials(str(tmp_path / "sums"))).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start())
    got = {r["day"]: r["requests"] for r in jobs.from_partials(spark, str(tmp_path / "sums")).collect()}
    assert got == {"2026-01-01": 2, "2026-01-02": 1, "2026-01-09": 1}
    names = feed(spark, str(tmp_path / "n"), [("Max", 1), ("Erika", 2), ("Max", 3), ("Udo", 4)], "name string, seen long", [[0, 1], [2], [3]])
    write = jobs.grow_alias_map(str(tmp_path / "map"))
    run_batches(names, write, str(tmp_path / "cp2"))
    assert {r["real"]: r["alias"] for r in jobs.alias_store(str(tmp_path / "map")).read(spark).collect()} == {"Max": "SuS-01", "Erika": "SuS-02", "Udo": "SuS-03"}


def test_budget_alerts_over_batches(spark, tmp_path):
    schema = "request_id long, ts timestamp_ntz, user_id long, model string, provider string, input_tokens long, output_tokens long, skill_name string"
    rng = random.Random(7)
    rows = sorted((dt.datetime(2026, 1 + rng.randrange(2), rng.randrange(1, 28), rng.randrange(24)), i) for i in range(90))
    rows = [(i, ts, 1, "openai/gpt-4", None, 80_000, 1000, None) for ts, i in rows]
    src = feed(spark, str(tmp_path / "in"), rows, schema, [range(0, 30), range(30, 31), range(31, 90)])
    jobs.run_to_end(src.writeStream.foreachBatch(jobs.write_budget_alerts(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    got = {r["request_id"]: (r["month"], r["month_to_date_usd"], r["budget_alert"]) for r in spark.read.parquet(str(tmp_path / "out" / "alerts")).collect()}
    whole = usage.budget_alerts(usage.with_cost(spark.createDataFrame(rows, schema))).collect()
    assert got == {r["request_id"]: (r["month"], r["month_to_date_usd"], r["budget_alert"]) for r in whole}
    assert {a for _, _, a in got.values()} == {None, "budget_75", "budget_90"}


def test_entry_points(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


def test_documents_with_a_badly_typed_field_are_left_out(spark):
    good = '{"jobId": "a", "pages": [{"index": 0, "regions": [{"id": "r", "agreement": 0.5}]}]}'
    bad = [good.replace("0.5", '"bad"'), good.replace('"a"', "null"), '{"jobId": "c"}', "{", good.replace('"index": 0', '"index": "x"')]
    docs = spark.createDataFrame([(v,) for v in (good, *bad)], "value string")
    assert [r["jobId"] for r in results.parse_documents(docs).collect()] == ["a"]


def test_a_table_is_streamed_from_one_file_or_a_folder(spark, tmp_path):
    """Large tables are folders of files; they were taken for a name that no file has."""
    docs = spark.createDataFrame([(i, f"Text {i}", "de", "wiki") for i in range(6)], "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        rows = stream_queries.to_table(stream_queries.stream(spark, str(tmp_path / kind), "docs"))
        assert sorted(r["doc_id"] for r in rows.collect()) == list(range(6))


def test_named_files_are_written_by_tasks(spark, monkeypatch):
    """The driver looked into a folder per file and moved each one; now it moves none."""
    moved = []
    monkeypatch.setattr(written_files.folders, "move", lambda *a: moved.append(a))
    df = spark.createDataFrame([(i, f"a{i % 3}/f_{i}.md", None if i == 4 else f"Zeile ä{i}\nzwei", 1_700_000_000 + i) for i in range(40)], "n long, path string, value string, modified long")
    got = {r["path"].split("/", 3)[-1]: r for r in logs.read_files(spark, written_files.write_named(df)).withColumn("t", F.unix_timestamp("modified")).collect()}
    assert not moved and len(got) == 40
    for name, r in got.items():
        i = int(os.path.basename(name)[2:-3])
        assert (r["value"], r["t"]) == ("\n" if i == 4 else f"Zeile ä{i}\nzwei\n", 1_700_000_000 + i)


@pytest.mark.parametrize("paths", [("a.md", "a.md"), ("a.md", None)])
def test_two_files_of_one_name_are_refused(spark, paths):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(paths)], "n long, path string, value string")
    with pytest.raises(Exception, match="no name of its own"):
        written_files.write_named(df)
