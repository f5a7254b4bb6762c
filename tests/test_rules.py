"""Escalation, notification, insights, wording and conformance boundary cases."""

import json

import pytest
from pyspark.sql import functions as F

from symptomlake.functions import symptoms as S, text, timing
from symptomlake.operators import escalation, quality, triage

NAMES = ["cough", "nausea", "lack_of_appetite", "fatigue", "pain"]


def five(**changes):
    doc = {n: {"frequency_rating": 1, "severity_rating": 1, "key_indicators": []} for n in NAMES}
    for name, fields in changes.items():
        doc[name].update(fields)
    return doc


def escalated(spark, doc, status):
    df = spark.createDataFrame([(json.dumps(doc), status)], "doc string, treatment_status string")
    df = df.withColumn("symptoms", S.symptom_entries(F.col("doc")))
    return escalation.escalate(df).select("flag", "level", "reason").first()


TREAT, REMIT = "undergoing_treatment", "in_remission"


@pytest.mark.parametrize("changes,status,flag", [
    ({}, TREAT, False),
    ({"fatigue": {"frequency_rating": 5}}, TREAT, True),
    ({"cough": {"severity_rating": 3}}, TREAT, True),
    ({"cough": {"severity_rating": 2, "frequency_rating": 2}}, TREAT, False),
    ({"nausea": {"severity_rating": 3, "frequency_rating": 3}}, TREAT, True),
    ({"fatigue": {"severity_rating": 2, "frequency_rating": 4}}, TREAT, False),
    ({"fatigue": {"severity_rating": 3, "frequency_rating": 3}}, REMIT, False),
    ({"cough": {"frequency_rating": 4}}, REMIT, True),
    ({"pain": {"severity_rating": 4}}, REMIT, True),
    ({"pain": {"severity_rating": 3, "frequency_rating": 2}}, REMIT, False),
    ({"fatigue": {"severity_rating": 5, "frequency_rating": 5}}, "unknown_status", False),
])
def test_escalation_limits(spark, changes, status, flag):
    row = escalated(spark, five(**changes), status)
    assert row.flag is flag
    assert row.level == ("amber" if flag else "none")
    if flag:
        assert list(changes)[0] in row.reason and ("remission" in row.reason) == (status == REMIT)
    else:
        assert row.reason == ""


def test_escalation_edges(spark):
    assert escalated(spark, {}, TREAT).flag is False
    assert escalated(spark, {"fatigue": {}}, TREAT).flag is False
    first = escalated(spark, five(nausea={"severity_rating": 5}, pain={"severity_rating": 5}), TREAT)
    assert first.reason == "Severe nausea - high frequency (1) or severity (5)"


def test_symptom_shapes_keep_order(spark):
    docs = [(1, '{"zeta": {"severity_rating": 2}, "alpha": "mild", "mid": {"severity_rating": "bad"}}'),
            (2, '[{"symptom": "headaches", "severity": "mild"}, {"symptom": "mood", "severity": "severe"}]'),
            (3, "{}"), (4, None), (5, "not json")]
    df = spark.createDataFrame(docs, "id int, symptoms_json string")
    rows = escalation.flatten_symptoms(df).orderBy("id", "pos").collect()
    assert [(r.id, r.symptom, r.shape, r.severity_rating, r.severity_text) for r in rows] == [
        (1, "zeta", "rated", 2, None), (1, "alpha", "text", None, None), (1, "mid", "rated", None, None),
        (2, "headaches", "listed", None, "mild"), (2, "mood", "listed", None, "severe")]


@pytest.mark.parametrize("level,expected", [
    ("GREEN", ("GREEN", "none", False)), ("RED", ("RED", "red", True)), ("ORANGE", ("ORANGE", "amber", True)),
    ("YELLOW", ("YELLOW", "amber", False)), (None, ("UNKNOWN", "none", False))])
def test_notification_merge(spark, level, expected):
    df = spark.createDataFrame([(False, "none", level)], "flag boolean, lvl string, alert string")
    m = S.merge_notification(F.col("lvl"), F.col("flag"), F.col("alert").isNotNull(), F.col("alert"))
    row = df.select(m.alias("m")).first().m
    assert (row.alert_level, row.level, row.flag) == expected


def test_yellow_keeps_a_higher_level(spark):
    df = spark.createDataFrame([("red",)], "lvl string")
    m = S.merge_notification(F.col("lvl"), F.lit(True), F.lit(True), F.lit("YELLOW"))
    assert df.select(m.alias("m")).first().m.level == "red"


def test_alert_descriptions(spark):
    df = spark.createDataFrame([("RED", "en"), ("GREEN", "zh-HK"), ("YELLOW", "fr"), ("PINK", "en")],
                               "alert_level string, language string")
    got = [r.alert_description for r in escalation.describe_alerts(df).collect()]
    assert got[0].startswith("Severe symptoms") and got[1].startswith("常規症狀")
    assert got[2].startswith("Moderate symptoms") and got[3] == "Unknown alert level: PINK"


def insights(spark, doc, level, urgency):
    df = spark.createDataFrame([(json.dumps(doc), level, urgency)], "doc string, level string, urgency int")
    cards = triage.insight_cards(S.symptom_entries(F.col("doc")), F.col("level"),
                                 F.array(F.struct(F.col("urgency").alias("urgency"))))
    return [c.title for c in df.select(cards.alias("c")).first().c]


def test_insight_cards(spark):
    listed = [{"symptom": "Low mood", "severity": "severe"}, {"symptom": "Insomnia", "severity": "mild"}]
    assert insights(spark, listed, "RED", 5) == [
        "attention_needed", "mood_sleep_correlation", "high_severity_symptoms", "high_priority_conditions"]
    assert insights(spark, [{"symptom": "pain", "severity": "mild"}], "GREEN", 1) == ["all_good", "symptoms_improving"]
    assert insights(spark, {}, "YELLOW", 1) == ["monitor_closely", "general_health_tip", "wellness_reminder"]
    assert insights(spark, {}, None, 1) == ["general_health_tip", "wellness_reminder"]


def test_texts(spark):
    df = spark.createDataFrame([("lack_of_appetite", "字" * 101, "2024-01-02T03:04:05Z"),
                                ("pain", None, "soon")], "s string, t string, ts string")
    rows = df.select(text.title_symptom(F.col("s")).alias("s"), text.summary_text(F.col("t")).alias("t"),
                     timing.show_ts(F.col("ts")).alias("ts")).collect()
    assert [tuple(r) for r in rows] == [
        ("Lack Of Appetite", "字" * 100 + "...", "2024-01-02 03:04:05"),
        ("Pain", "AI conversation completed", "soon")]


def test_week_and_month_bounds():
    assert [str(d.date()) for d in timing.week_bounds("2024-01-28")] == ["2024-01-22", "2024-01-29"]
    assert [str(d.date()) for d in timing.week_bounds("2024-01-22", 1)] == ["2024-01-15", "2024-01-22"]
    assert [str(d.date()) for d in timing.month_bounds("2024-01-15", 1)] == ["2023-12-01", "2024-01-01"]
    assert [str(d.date()) for d in timing.month_bounds("2024-03-31", 13)] == ["2023-02-01", "2023-03-01"]


def test_exact_week_bounds_keep_the_time_of_day(spark):
    times = ["2024-01-22 08:00:00", "2024-01-22 10:00:00", "2024-01-28 10:00:00", "2024-01-28 10:00:01"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("ts", F.to_timestamp("t"))
    kept = df.where(timing.in_week(F.col("ts"), "2024-01-24T10:00:00", exact_bounds=True)).collect()
    assert [r.t for r in kept] == times[1:3]
    assert df.where(timing.in_week(F.col("ts"), "2024-01-24T10:00:00")).count() == 4


def test_expiry_is_strict_and_unreadable_counts_as_expired(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("2024-01-01T09:59:59+00:00",), ("?",), (None,)], "t string")
    got = [r.e for r in df.select(timing.is_expired(F.col("t"), 1800, "2024-01-01 10:30:00").alias("e")).collect()]
    assert got == [False, True, True, True]


def test_conformance_and_quarantine(spark):
    df = spark.createDataFrame([(13, 13, 100), (14, 0, 101), (None, 1, 0)],
                               "sections_completed int, total_sections int, completion_percentage int")
    checked = quality.conformance(df, quality.submission_rules())
    assert [r.violations for r in checked.collect()] == [
        [], ["sections_completed", "total_sections", "completion_percentage"], ["sections_completed"]]
    valid, bad = quality.split_valid(checked)
    assert (valid.count(), bad.count()) == (1, 2)
