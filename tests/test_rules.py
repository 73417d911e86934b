"""Golden cases for usage, privacy, pseudonyms, grading, records and profile fields."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pultwerk.functions import privacy as px
from pultwerk.operators import grading, lessons, normalise, privacy, pseudonym, records, review, routing, usage
from pultwerk.sources import roster


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], names)
    return df.select(expression.alias("x")).first()["x"]


def test_price_resolution(spark):
    rows = [("a", "openai/gpt-4", None, 1_000_000, 1_000_000), ("b", "meta-llama/llama-2-70b-chat", None, 0, 0), ("c", "unlisted", None, 10, 10),
            ("d", "anthropic/claude-3-opus", "openrouter", 0, 0), ("e", "gpt-4", "openai", 0, 0), ("f", "gpt-4", "google", 0, 0)]
    df = spark.createDataFrame(rows, "request_id string, model string, provider string, input_tokens long, output_tokens long")
    got = {r["request_id"]: r for r in usage.with_cost(df).collect()}
    assert (got["a"]["resolved_provider"], float(got["a"]["cost"])) == ("openai", 90.0)
    assert (got["b"]["resolved_provider"], float(got["b"]["input_price"]), float(got["b"]["output_price"])) == ("openrouter", 0.65, 0.90)
    assert got["c"]["price_fallback"] and got["c"]["resolved_model"] == "claude-3-5-sonnet-20241022"
    assert got["d"]["resolved_provider"] == "anthropic" and got["e"]["resolved_provider"] == "openai" and got["f"]["resolved_provider"] == "openai"


def test_unknown_period_is_an_error(spark):
    with pytest.raises(ValueError):
        usage.summary(spark.range(1), "week")


def test_findings_and_redaction(spark):
    text = "Kontakt: max@example.de, Tel. 030 1234567, geboren am 01.02.2010"
    found = one(spark, px.findings(F.col("t")), t=text)
    assert {"email", "phone", "birth_date"} <= set(found)
    masked = one(spark, px.redact(F.col("t")), t=text)
    assert masked == "Kontakt: [E-Mail], Tel. [Telefon], geboren am [Datum]"
    assert one(spark, px.redact(F.col("t")), t="am 01.02.2010") == "am 01.02.2010"
    assert one(spark, px.redact(F.col("t")), t="geboren 1/2/2010") == "geboren 1/2/2010"
    assert one(spark, px.findings(F.col("t")), t="müsus SCHÜLERIN") == ["student_context"]


def decide(spark, text, classes=(), skill=None, requested="auto", sticky="auto"):
    df = spark.createDataFrame([([text], list(classes), skill, requested, sticky)], "texts array<string>, classifications array<string>, skill_id string, requested_mode string, sticky_mode string")
    r = privacy.decide(df).first()
    return r["mode"], r["reasons"]


def test_privacy_decisions(spark):
    q = "Was steht im Lehrplan zur Bruchrechnung?"
    assert decide(spark, q, ["public_curriculum"]) == ("cloud_allowed", [])
    assert decide(spark, q, ["personal"]) == ("local_required", ["document_not_public"])
    assert decide(spark, "Bitte hilf mir dabei.", skill="zeugnis_formulieren") == ("local_required", ["sensitive_skill:zeugnis_formulieren"])
    assert {"student_submission", "document_not_public"} <= set(decide(spark, "Bitte bewerte diese Klassenarbeit.", ["student_submission"])[1])
    assert decide(spark, q, requested="local_required", sticky="local_required")[1] == ["chat_already_local", "user_requested_local"]


def test_endpoints(spark):
    urls = {"https://a.example/x": (None, False), "http://a.example": ("not_https", False), "https://u:p@a.example": ("credentials", False), "https://a.example:8443/": ("port", False),
            "http://localhost:11434": ("not_https", True), "http://127.8.0.1": ("not_https", True), "https://[::1]/": (None, True), "https://a.example:80": (None, False), "nonsense": ("not_https", False)}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", px.endpoint_problem(F.col("u")).alias("p"), px.loopback(F.col("u")).alias("l"))
    assert {r["u"]: (r["p"], r["l"]) for r in df.collect()} == urls


def test_gate(spark):
    jobs = spark.createDataFrame([("job-1", "needs_review", 0, "personal"), ("job-2", "approved", 1, "personal"), ("job-3", "approved", 0, "personal")], "job_id string, status string, unresolved_critical long, classification string")
    s = "schuelerarbeit_bewerten"
    reqs = spark.createDataFrame([(1, "lehrplan_einlesen", ["job-1"]), (2, s, ["job-1"]), (3, s, ["job-2"]), (4, s, ["does-not-exist"]), (5, s, []), (6, s, ["job-3", "job-1", "job-2"])], "request_id long, skill_id string, job_ids array<string>")
    got = {r["request_id"]: r["gate_reasons"] for r in privacy.grading_gate(reqs, jobs).collect()}
    assert got == {1: [], 2: ["not_approved:job-1"], 3: ["critical_uncertainty:job-2"], 4: ["unknown_job:does-not-exist"], 5: [], 6: ["not_approved:job-1", "critical_uncertainty:job-2"]}


def test_trigger_match(spark):
    assert one(spark, routing.match_skill(F.col("t")), t="Ich will den LEHRPLAN EINLESEN, Lehrplan!") == "lehrplan_einlesen"
    assert one(spark, routing.match_skill(F.col("t")), t="nichts davon") is None


def test_names(spark):
    text = "Name: Max Mustermann\nDie Antwort stammt von Erika Musterfrau und von ihr."
    assert one(spark, pseudonym.name_candidates(F.col("t")), t=text) == ["Max Mustermann", "Name: Max Mustermann", "Erika Musterfrau"]


def test_alias_order(spark):
    df = spark.createDataFrame([("Max Mustermann", 1), ("Max Mustermann ", 2), ("Erika Musterfrau", 3)], "name string, seen long")
    assert {r["real"]: r["alias"] for r in pseudonym.assign_aliases(df).collect()} == {"Max Mustermann": "SuS-01", "Erika Musterfrau": "SuS-02"}


def test_pseudonymize_edges(spark):
    cases = [("Timo und Timur waren da, aber Tim nicht.", ["Tim"], "Timo und Timur waren da, aber {0} nicht."), ("Jürgen Groß und Jürgen Großmann", ["Jürgen Groß"], "{0} und Jürgen Großmann"),
             ("Anna-Lena kam.", ["Anna-Lena"], "{0} kam."), ("Dr. Meier sprach", ["Dr. Meier"], "{0} sprach"), ("Anna Meier kam. Auch Anna.", ["Anna Meier", "Anna"], "{0} kam. Auch {1}."), ("a.b$c", [".b$"], "a{0}c")]
    aliases = spark.createDataFrame([(n, f"SuS-{i:02d}") for i, n in enumerate(sorted({n for _, ns, _ in cases for n in ns}), 1)], "real string, alias string")
    known = {r["real"]: r["alias"] for r in aliases.collect()}
    texts = spark.createDataFrame([(i, t, ns) for i, (t, ns, _) in enumerate(cases)], "doc_id long, text string, names array<string>")
    got = {r["doc_id"]: r["pseudonymized"] for r in pseudonym.pseudonymize(texts, aliases).collect()}
    for i, (_, names, want) in enumerate(cases):
        assert got[i] == want.format(*[known[n] for n in names])
    back = pseudonym.restore(spark.createDataFrame([(1, "SuS-01 und SuS-99, SuS-100")], "doc_id long, text string"), aliases.union(spark.createDataFrame([("Hundert", "SuS-100")])))
    assert back.first()["restored"] == ".b$ und SuS-99, Hundert"


def test_narratives(spark):
    notes = spark.createDataFrame([(1, "{NAME} zeigt, was {er/sie} kann. {Sein/Ihr} Heft. {SEIN/IHR}"), (2, "{NAME}: {er/sie}"), (3, "{NAME} {ihm/ihr}")], "student_id long, text string")
    who = spark.createDataFrame([(1, "Anna", "SuS-01", "sie"), (2, "Ben", "SuS-02", "er"), (3, "", "SuS-03", None)], "student_id long, given_name string, alias string, pronoun string")
    got = {r["student_id"]: r["filled"] for r in pseudonym.reinsert_names(notes, who).collect()}
    assert got == {1: "Anna zeigt, was sie kann. Ihr Heft. Ihr", 2: "Ben: er", 3: "SuS-03 ihr"}


def test_grades(spark):
    df = spark.createDataFrame([(47.5, 1), (40.0, 2), (32.5, 3), (25.0, 4), (12.5, 5), (12.0, 6)], "p double, want int").withColumn("got", grading.grade(F.col("p") * 2))
    assert all(r["got"] == r["want"] for r in df.collect())
    with pytest.raises(ValueError):
        grading.grade(F.lit(1), "other")


def test_streak_and_share(spark):
    rows = [(1, dt.datetime(2026, 1, d), d, m) for d, m in enumerate("AAAB", 1)]
    got = {r["method"]: r for r in lessons.method_warnings(spark.createDataFrame(rows, "class_id long, held_on timestamp, lesson_id long, method string")).collect()}
    assert got["A"]["longest_run"] == 3 and got["A"]["share"] == 0.75 and got["A"]["run_warning"] and got["A"]["share_warning"] and not got["B"]["run_warning"]


def test_school_year_and_rating(spark):
    days = {"2026-05-15": "2025/26", "2026-09-01": "2026/27", "2026-08-01": "2026/27", "2026-07-31": "2025/26"}
    for day, want in days.items():
        assert one(spark, records.school_year(F.to_date("d")), d=day) == want
    df = spark.createDataFrame([("3", "1-4", "3 / 4"), ("2", None, "2"), (None, "1-4", "")], "r string, s string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", records.rating_label(F.col("r"), F.col("s"))).collect())


def test_fuzzy_names(spark):
    df = spark.createDataFrame([("Bayren", "Bayern"), ("nrw", "Nordrhein-Westfalen"), ("Atlantis", "Atlantis"), ("  ", "  "), (" hessn ", "Hessen")], "raw string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", normalise.state_name(F.col("raw"))).collect())
    assert one(spark, normalise.school_type(F.col("t")), t="gymnasim") == "Gymnasium"


def test_roster_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text(" Vorname ;NACHNAME;pronomen\nAnna;Müller;sie\n;Ohne;er\n Ben ;Schmidt;er\n", encoding="utf-8")
    got = sorted((r["vorname"], r["nachname"], r["pronomen"]) for r in roster.read_roster(spark, str(tmp_path / "r.csv")).collect())
    assert got == [("Anna", "Müller", "sie"), ("Ben", "Schmidt", "er")]
    (tmp_path / "bad.csv").write_text("a;b\n1;2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        roster.read_roster(spark, str(tmp_path / "bad.csv"))


def test_rosters_of_a_folder_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Vorname;Nachname\nAnna;Müller\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffNachname;Pronomen;Vorname\r\nSchulz;er;Ben\r\n\r\n", encoding="utf-8")
    got = sorted((r["vorname"], r["nachname"], r["pronomen"]) for r in roster.read_roster(spark, str(tmp_path)).collect())
    assert got == [("Anna", "Müller", ""), ("Ben", "Schulz", "er")]


def test_empty_skill_names_count_as_none(spark):
    rows = [("r1", dt.datetime(2026, 1, 1), "openai/gpt-4", None, 10, 5, ""), ("r2", dt.datetime(2026, 1, 1), "openai/gpt-4", None, 10, 5, "Klasse"), ("r3", dt.datetime(2026, 1, 1), "openai/gpt-4", None, 10, 5, None)]
    events = spark.createDataFrame(rows, "request_id string, ts timestamp, model string, provider string, input_tokens long, output_tokens long, skill_name string")
    priced = usage.with_cost(events)
    total = usage.usage_total(priced).first()
    assert (total["requests"], total["skill_executions"]) == (3, 1)
    skills = usage.rollups(priced).filter("period IN ('skill', 'day_skill')").collect()
    assert len(skills) == 2 and all(r["requests"] == 1 for r in skills)


def test_an_empty_text_clears_a_region(spark):
    rows = [(1, 1, None, ""), (2, 2, "htr", ""), (3, 3, "htr", None), (4, 4, None, None), (5, 5, "", "x"), (6, 6, "nobody", "x")]
    events = spark.createDataFrame([(1, r, i, "edit", dt.datetime(2026, 1, i), e, t) for i, r, e, t in rows], "job_id long, region_id long, event_id long, kind string, ts timestamp, engine string, text string")
    readers = spark.createDataFrame([(1, r, "htr", f"read {r}") for r in range(1, 7)], "job_id long, region_id long, engine string, text string")
    classified = review.classify_edits(events, readers)
    assert {r["region_id"]: r["selected_text"] for r in review.latest_edits(classified).collect()} == {1: "", 2: "", 3: "read 3"}
    assert {r["region_id"]: r["problem"] for r in review.rejected_edits(classified).collect()} == {4: "empty_patch", 5: "unknown_reader", 6: "unknown_reader"}


def test_what_a_table_explodes_into_is_not_broadcast(spark):
    """A table of keys that becomes many rows each looks small and was broadcast."""
    events = spark.range(10).selectExpr("id AS event_id", "id AS job_id", "id % 5 AS region_id", "'edit' AS kind", "'htr' AS engine", "cast(null AS string) AS text", "timestamp_ntz'2026-01-01' AS ts")
    candidates = spark.range(10).selectExpr("id AS job_id", "explode(sequence(0L, 4L)) AS region_id", "'htr' AS engine", "'liest' AS text")
    classified = review.classify_edits(events, candidates)
    assert "Broadcast" not in classified._jdf.queryExecution().executedPlan().toString()
    assert classified.count() == 10
