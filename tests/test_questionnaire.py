"""Questionnaire kernels and the full enrichment."""

import json

import pytest
from pyspark.sql import functions as F

from symptomlake import dims
from symptomlake.functions import questionnaire as Q
from symptomlake.operators import messages, questionnaire as ops
from symptomlake.plans import reports


def frame(spark, *answers):
    return spark.createDataFrame([(i, a) for i, a in enumerate(answers)],
                                 "submission_id int, answers map<string,string>")


def value(spark, sql, **raw):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in raw.items()]).select(F.expr(sql).alias("v")).first().v


def cond(op, target):
    return dims._question("rating", "q", "Rate it", {}, ("dep", op, target))


@pytest.mark.parametrize("op,target,answer,shown", [
    ("gte", 4, "4", True), ("gte", 4, "5", True), ("gte", 4, "3", False), ("gte", 4, "x", False),
    ("not_eq", "none", "yes", True), ("not_eq", "none", "none", False), ("not_eq", "none", '["none"]', True),
    ("eq", "active", "active", True), ("eq", "active", "inactive", False),
    ("in_list", ["red", "blue"], "red", True), ("in_list", ["red", "blue"], "green", False),
    ("contains", "a", '["b","a"]', True), ("contains", "a", "a", False), ("contains", "a", "[]", False),
    ("gte", 1, None, False), ("someday", "x", "y", True)])
def test_visibility(spark, op, target, answer, shown):
    row = frame(spark, {"dep": answer} if answer is not None else {}).select(
        F.expr(Q.is_shown(cond(op, target))).alias("v")).first()
    assert row.v is shown


def test_unconditional_question_is_shown(spark):
    assert value(spark, Q.is_shown(dims._question("rating", "q", "Rate it"))) is True


def scale(kind="rating", lo=1, hi=5, **extra):
    return dims._question(kind, "q", "Rate?", {}, min=lo, max=hi, **extra)


@pytest.mark.parametrize("q,raw,expected", [
    (scale(), "1", 0.0), (scale(), "3", 0.5), (scale(), "5", 1.0),
    (scale(descending=True), "5", 0.0), (scale(descending=True), "1", 1.0),
    (scale("slider", 0, 10), "0", 0.0), (scale("slider", 0, 10), "5", 0.5), (scale("slider", 0, 10), "10", 1.0),
    (scale(lo=3, hi=3), "3", 0.0), (scale(), None, None), (scale("single-select"), "x", None)])
def test_normalized_severity(spark, q, raw, expected):
    assert value(spark, Q.severity_normalized(q, "raw"), raw=raw) == expected


def test_region_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 6, 10, 15)], "n int")
    assert [r.s for r in rows.select(F.expr(Q.region_severity("n")).alias("s")).collect()] == [0, 1, 1, 2, 3, 4, 4]


def question(kind, options=None, **extra):
    return dims._question(kind, "q", "Rate pain?", options or {}, **extra)


@pytest.mark.parametrize("q,raw,expected", [
    (question("rating", {"4": "Severe"}), "4", "Test: Rate pain rated Severe (4/5)"),
    (question("rating", {"3": "Moderate"}), "3", None),
    (question("single-select"), "6+", "Test: frequency 6+ times"),
    (question("single-select"), "5-6", None),
    (question("body-diagram"), '["head","chest","back"]', "Test: 3 body regions affected"),
    (question("body-diagram"), '["head","chest"]', None),
    (question("slider", unit="hrs", low_limit=3.0), "2", "Test: 2hrs (critically low)"),
    (question("slider", unit="hrs", low_limit=3.0), "3.5", None),
    (question("color-chart", {"red": "Red", "brown": "Brown"}, alert_values=["red"]), '["red"]',
     "Test: alarming color reported (Red)"),
    (question("color-chart", {"red": "Red", "brown": "Brown"}, alert_values=["red"]), "red",
     "Test: alarming color reported (Red)"),
    (question("color-chart", {"red": "Red"}, alert_values=["red"]), "blue", None),
    (question("rating"), None, None)])
def test_alert_flags(spark, q, raw, expected):
    items = Q.as_list("raw") if q["type"] in Q.LIST_TYPES else None
    assert value(spark, Q.alert_flag("Test", q, "raw", items), raw=raw) == expected


def test_catalogue_shape():
    kinds = [q["type"] for q in dims.flat_questions()]
    assert len(dims.SECTIONS) == 13 and len(kinds) == 42
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "rating": 11, "single-select": 9, "multi-select": 6, "text": 6, "color-chart": 5, "slider": 2,
        "body-diagram": 1, "joint-diagram": 1, "muscle-diagram": 1}
    assert (len(dims.JOINT_REGIONS), len(dims.MUSCLE_REGIONS)) == (18, 40)


def test_empty_and_single_answer(spark):
    empty, one = ops.enrich(frame(spark, {}, {"appetite_rating": "4", "mood_rating": "2"})).orderBy("submission_id").collect()
    assert empty.completion.questions_answered == 0 and empty.summary.symptom_count == 0
    assert empty.completion.total_questions == 42 and len(empty.sections) == 13
    assert one.summary.alert_flags == ["Appetite Loss: How is your appetite on a scale of one to five rated Poor (4/5)"]
    assert one.summary.max_severity == 4 and one.summary.max_severity_area == "Appetite Loss"
    assert one.answers == {"appetite_rating": "4", "mood_rating": "2"}


def test_fallback_details_and_hidden_flags(spark):
    answers = {"cough_frequency": "3-4", "phlegm_color": "red", "headache_frequency": "none",
               "headache_location": '["forehead","top_head","back_head"]',
               "sleep_quality": "1", "joint_pain_areas": '["left_knee","right_knee","left_hip"]'}
    row = ops.enrich(frame(spark, answers)).first()
    by_title = {s.title: s for s in row.sections}
    assert (by_title["Cough"].severity_score, by_title["Cough"].severity_label) == (2, "Moderate")
    # hidden answers are nulled but still raise flags, and a rating of 1 still makes a concern
    hidden = by_title["Headaches"]
    assert hidden.responses[2].raw_value is None and hidden.responses[2].skip_reason == "conditional_not_met"
    assert hidden.alert_flags == ["Headaches: 3 body regions affected"] and hidden.details is None
    assert by_title["Insomnia"].is_concern and by_title["Insomnia"].severity_label == "Very good"
    assert by_title["Joint Pain"].details is None and by_title["Joint Pain"].responses[0].region_count == 3
    assert row.summary.clinical_areas_affected == ["musculoskeletal", "neurological", "respiratory", "sleep"]
    assert row.summary.max_severity_area == "Cough"


def test_lean_enrichment_gives_the_same_summary(spark):
    df = frame(spark, {"cough_frequency": "3-4", "phlegm_color": "red", "sleep_quality": "4", "sleep_hours": "2.5",
                       "sleep_symptoms": '["anxiety","own words"]', "muscle_pain_areas": "[]"}, {})
    pick = ["submission_id", "summary", "completion"]
    full, lean = ops.enrich(df).select(*pick), ops.enrich(df, responses=False).select(*pick)
    assert full.orderBy("submission_id").collect() == lean.orderBy("submission_id").collect()
    first = lean.orderBy("submission_id").first()
    assert first.completion.questions_answered == 4
    assert first.summary.areas_of_concern[1].details == ["Feeling anxious and/or depressed", "own words"]


def test_filters_meet_finished_values_or_the_scan(spark, tmp_path):
    frame(spark, {"appetite_rating": "4"}, {}).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    hit = ops.enrich(stored).where("summary.symptom_count > 0 and completion.questions_answered > 0 and submission_id = 0")
    text = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(submission_id,0)" in text and text.count("others_specify") < 120
    assert [r.submission_id for r in hit.collect()] == [0]
    assert messages.with_messages(ops.enrich(stored)).where("size(messages) >= 3").count() == 1


def test_quotes_in_a_custom_catalogue(spark):
    custom = [dims.section("X1", "It's", "area", "q1", [
        dims.rating("q1", "How's \\ it?", {"1": "can't", "5": 'so "so"'})])]
    row = ops.enrich(frame(spark, {"q1": "5"}), custom).first()
    assert row.summary.alert_flags == ['It\'s: How\'s \\ it rated so "so" (5/5)']


def test_messages_and_status(spark):
    rows = messages.with_messages(ops.enrich(frame(spark, {}, {"appetite_rating": "2", "appetite_causes": "[]"})))
    empty, one = [r.messages for r in rows.orderBy("submission_id").collect()]
    assert len(empty) == 1 and empty[0].role == "assistant"
    assert [m.role for m in one] == ["assistant", "assistant", "user"]
    assert one[2].content == ("Regarding Appetite Loss:\n- How is your appetite on a scale of one to five?: Good\n"
                              "Overall severity: Good (2)")
    derived = spark.createDataFrame([("questionnaire_1", "RED")], "session_id string, alert_level string")
    status = messages.triage_status(ops.enrich(frame(spark, {}, {"appetite_rating": "2"})), derived)
    assert [(r.triage_status, r.alert_level) for r in status.orderBy("submission_id").collect()] == [
        ("skipped", None), ("completed", "RED")]


def test_only_asked_columns_meet_the_records(spark):
    """Whole answers are not shuffled to find the submissions that still need scoring."""
    rows = frame(spark, {"appetite_rating": "2"}, {"appetite_rating": "4"}, {}, {"appetite_rating": "5"})
    done = spark.createDataFrame([("questionnaire_0", "RED"), ("questionnaire_0", "RED"), (None, "RED")],
                                 "session_id string, alert_level string")
    wide = reports.scored_submissions(rows, done).select("submission_id", "session_id", F.size("messages").alias("n"))
    narrow = reports.scored_submissions(rows, done, "submission_id", F.size("messages").alias("n"))
    assert sorted((r.submission_id, r.session_id, r.n) for r in narrow.collect()) \
        == sorted(tuple(r) for r in wide.collect()) == [(1, "questionnaire_1", 4), (3, "questionnaire_3", 4)]
    lines = narrow._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert "Generate" not in "".join(lines[:at]) and "Generate" in "".join(lines[at:])
    assert "answers" not in lines[at + 1] and "messages" not in lines[at + 1].replace("size(messages", "")


def test_history_shaping(spark):
    turns = [("system", "old", "t0"), ("user", "Hi", "t1")]
    df = spark.createDataFrame([(turns,)], "h array<struct<role:string,content:string,timestamp:string>>")
    plain = df.select(messages.shape_history(F.col("h")).alias("h")).first().h
    fresh = df.select(messages.shape_history(F.col("h"), "new").alias("h")).first().h
    assert [tuple(m) for m in plain] == [("system", "old"), ("user", "Hi")]
    assert [tuple(m) for m in fresh] == [("system", "new"), ("user", "Hi")]


def test_catalogue_is_data_only():
    assert json.dumps(dims.SECTIONS)


def test_generated_code_stays_within_a_method(spark, capfd):
    rows = spark.createDataFrame([(1, {"appetite_rating": "2.5"})], "submission_id int, answers map<string,string>")
    ops.question_responses(rows).collect()
    enriched = ops.enrich(rows)
    enriched.select("sections", "summary", "completion").collect()
    messages.with_messages(enriched).select("messages").collect()
    assert "Failed to compile" not in capfd.readouterr().err


def test_fractional_rating_is_kept(spark):
    rows = spark.createDataFrame([(1, {"appetite_rating": "2.5"})], "submission_id int, answers map<string,string>")
    scores = ops.section_results(ops.enrich(rows, responses=False), "submission_id").collect()
    assert 2.5 in [r.severity_score for r in scores]


ODD = [{}, None, {"appetite_rating": "2.5", "cough_frequency": "6+", "phlegm_color": '["red",null,"own"]', "sleep_hours": "x"},
       {"sleep_quality": "4", "sleep_hours": "2.5", "sleep_symptoms": '["anxiety","own words"]', "muscle_pain_areas": "[]",
        "joint_pain_areas": '["left_knee","right_knee","left_hip"]', "headache_location": "forehead", "appetite_causes": "[broken"}]


def test_one_rule_for_exploded_answers(spark):
    """The long form keeps one rule for all questions, and gives what the struct of each question holds."""
    flat = dims.flat_questions()
    full = {q["question_id"]: v for q in flat for v in [next(iter(q["options"]), "3")]}
    rows = frame(spark, *ODD, full, {k: '["%s","?"]' % v for k, v in full.items()})
    long = ops.question_responses(rows)
    wide = ops.with_responses(rows).select("submission_id", F.inline("responses")).drop("alert_flag")
    assert [(f.name, f.dataType) for f in long.schema] == [(f.name, f.dataType) for f in wide.schema]
    order = ["submission_id", "section_pos", "question_pos"]
    assert long.count() == 6 * 42 and long.orderBy(*order).collect() == wide.orderBy(*order).collect()
    assert long._jdf.queryExecution().optimizedPlan().toString().count("conditional_not_met") == 1


def test_unread_responses_are_not_built(spark):
    rows = frame(spark, *ODD)
    summary = ops.enrich(rows).select("submission_id", "completion", "summary")
    assert "conditional_not_met" not in summary._jdf.queryExecution().optimizedPlan().toString()
    flat = ops.with_responses(rows).select("submission_id", "responses")
    nested = ops.enrich(rows).select("submission_id", F.flatten(F.transform("sections", lambda s: s["responses"])).alias("responses"))
    assert nested.orderBy("submission_id").collect() == flat.orderBy("submission_id").collect()


@pytest.mark.parametrize("raw", ["[]", '[""]', '["]', '["a"]', '["a","b, c","","d"]', '["a",","b"]', '["a", "b"]', '["a\\"b"]',
                                 '["a\\\\"]', '["a\\u0041"]', '["a\tb"]', '["a",null]', '[1,"a"]', '["a"],["b"]', '["a","b"', "[broken",
                                 '["é","日本"]', '["' + "x" * 12_000 + '","y"]', "a", "", None])
def test_plain_lists_are_cut_as_the_parser_would(spark, raw):
    row = spark.createDataFrame([(raw,)], "raw string").select(
        F.expr(Q.as_list("raw")).alias("cut"),
        F.expr("CASE WHEN startswith(raw, '[') THEN from_json(raw, 'array<string>') END").alias("parsed")).first()
    assert row.cut == row.parsed


def largest_method(df) -> int:
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_hot_methods_are_small_enough_to_be_compiled(spark):
    """Beyond 8,000 bytes the JVM interprets a method for ever."""
    from workload import adapter as A

    rows = frame(spark, *ODD)
    talk = messages.with_messages(ops.enrich(rows, talk=True))
    for df in (ops.alert_flags(rows), talk.select("submission_id", "messages"),
               ops.section_results(ops.enrich(rows, responses=False), "submission_id"),
               ops.clinical_summary(ops.enrich(rows, responses=False), "submission_id")):
        assert largest_method(df) <= 8000
    orders = spark.createDataFrame([(1, 2, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    derived = A.derive_submissions(spark, None, orders)
    assert largest_method(derived) <= 8000
    assert "map_filter(map(" not in derived._jdf.queryExecution().optimizedPlan().toString()


def test_talk_says_what_the_responses_say(spark):
    rows = frame(spark, *ODD)
    talk = messages.with_messages(ops.enrich(rows, talk=True))
    plain = messages.with_messages(ops.enrich(rows))
    assert talk.columns == plain.columns
    assert talk.orderBy("submission_id").collect() == plain.orderBy("submission_id").collect()
    only = talk.select("messages")._jdf.queryExecution().optimizedPlan().toString()
    assert "conditional_not_met" not in only and "transform(_sections" not in only


def test_summary_follows_from_the_sections(spark):
    rows = frame(spark, *ODD)
    enriched = ops.enrich(rows, responses=False)
    for r in enriched.collect():
        concerns = [s for s in r.sections if s.is_concern]
        scores = [s.severity_score for s in concerns if s.severity_score is not None]
        worst = max(scores, default=None)
        assert [a.section_id for a in r.summary.areas_of_concern] == [s.section_id for s in concerns]
        assert (r.summary.symptom_count, r.summary.max_severity) == (len(concerns), worst)
        assert r.summary.max_severity_area == next((s.title for s in concerns if worst is not None and s.severity_score == worst), None)
        assert r.summary.clinical_areas_affected == sorted({s.clinical_area for s in concerns})
        assert r.summary.alert_flags == [f for s in r.sections for f in s.alert_flags]
    # written out for each section: nothing over the sections is left to interpreted functions
    plan = ops.clinical_summary(enriched, "submission_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(_sections" not in plan and "is_concern, lambda" not in plan


def test_derived_tables_are_written_small(spark, tmp_path):
    """So many answers outgrow the dictionary of a file; a submission of 42 questions still takes few bytes."""
    import os
    from workload import adapter
    n = 200_000
    orders = spark.range(n).selectExpr("id AS o_orderkey", "id % 10 AS o_custkey", "timestamp '2024-01-01 00:00:00' AS o_orderdate")
    rows = adapter.stored(spark, str(tmp_path), "submissions", lambda _: adapter.derive_submissions(spark, "", orders.repartition(1)))
    assert rows.count() == n
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in rows.inputFiles()) < 80 * n
