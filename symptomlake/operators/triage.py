"""Triage statistics, histories and insight rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims
from ..functions import rounding, symptoms as S
from .ranking import latest_per_key, newest_n

TRIAGE_FIELDS = ["alert_level", "alert_rationale", "recommended_timeline", "confidence_level",
                 "treatment_status"]


def with_triage(assessments: DataFrame) -> DataFrame:
    """Assessments that carry a triage result."""
    return assessments.where(F.col("triage").isNotNull())


def _flat(df: DataFrame, *keep: str) -> DataFrame:
    held = df.schema["triage"].dataType.fieldNames()
    return df.select(*keep, *[F.col(f"triage.{f}").alias(f) for f in TRIAGE_FIELDS],
                     F.coalesce("triage.key_symptoms", F.array().cast("array<string>"))
                     .alias("key_symptoms"),
                     F.coalesce("triage.diagnosis_predictions", F.array()).alias("diagnosis_predictions"),
                     *[(F.col(f"triage.{f}") if f in held else F.lit(None).cast("string")).alias(name)
                       for f, name in (("clinical_reasoning", "clinical_reasoning"), ("timestamp", "triage_timestamp"))])


def latest_triage(assessments: DataFrame) -> DataFrame:
    """Newest triaged assessment of every patient, triage fields flattened;
    its ``structured_assessment`` too, if assessments carry one."""
    more = [c for c in ("structured_assessment",) if c in assessments.columns]
    rows = with_triage(assessments).select("user_id", "created_at", "assessment_id",
                                           "session_id", "triage", *more)
    return _flat(latest_per_key(rows, "user_id", ["created_at", "assessment_id"]),
                 "user_id", "session_id", "created_at", *more)


def triage_history(assessments: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` triaged assessments of every patient."""
    rows = with_triage(assessments).select("user_id", "created_at", "assessment_id",
                                           "session_id", "triage")
    return _flat(newest_n(rows, "user_id", ["created_at", "assessment_id"], n),
                 "user_id", "session_id", "created_at", "newest_rank")


def confidence_score(level: Column) -> Column:
    """low / medium / high as 1 / 2 / 3; anything else counts as 2."""
    out = F.lit(dims.CONFIDENCE_DEFAULT)
    for name, score in dims.CONFIDENCE_SCORE.items():
        out = F.when(level == name, F.lit(score)).otherwise(out)
    return out


def triage_levels(assessments: DataFrame) -> DataFrame:
    """A13, long form: assessments per patient and alert level."""
    return (with_triage(assessments)
            .groupBy("user_id", F.coalesce("triage.alert_level", F.lit("UNKNOWN")).alias("alert_level"))
            .agg(F.count("*").alias("n")))


def triage_stats(users: DataFrame, assessments: DataFrame) -> DataFrame:
    """Totals, alert level counts and mean confidence of every user."""
    level = F.coalesce("triage.alert_level", F.lit("UNKNOWN"))
    stats = with_triage(assessments).groupBy("user_id").agg(
        F.count("*").alias("total_assessments"),
        *[F.count_if(level == v).alias(f"n_{v.lower()}") for v in dims.ALERT_LEVELS + ["UNKNOWN"]],
        F.sum(confidence_score(F.col("triage.confidence_level"))).alias("confidence_sum"))
    zero = F.lit(0).cast("long")
    counts = ["total_assessments"] + [f"n_{v.lower()}" for v in dims.ALERT_LEVELS + ["UNKNOWN"]]
    return users.select("user_id").join(stats, "user_id", "left").select(
        "user_id", *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce(rounding.mean_rounded("confidence_sum", "total_assessments", 2),
                   F.lit(0.0)).alias("average_confidence"))


def top_key_symptoms(assessments: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent key symptoms of every patient, first seen wins ties."""
    counts = (with_triage(assessments)
              .select("user_id", "created_at", "assessment_id",
                      F.posexplode("triage.key_symptoms").alias("pos", "symptom"))
              .groupBy("user_id", "symptom")
              .agg(F.count("*").alias("n"),
                   F.min(F.struct("created_at", "assessment_id", "pos")).alias("seen")))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "seen"))
    return (counts.withColumn("rank", rank).where(F.col("rank") <= n)
            .select("user_id", "rank", "symptom", "n"))


def insight_cards(symptoms: Column, alert_level: Column, diagnoses: Column) -> Column:
    """up to four insight cards (title, kind, icon, description) of one assessment.

    Worded severities exist only on list or text records, so numeric
    assessments never reach the severe and mild rules.
    """
    items = S.entries(symptoms)

    def mentions(words):
        def test(s):
            name = F.lower(s["symptom"])
            hit = F.lit(False)
            for w in words:
                hit = hit | name.contains(w)
            return F.coalesce(hit, F.lit(False))
        return F.exists(items, test)

    def worded(s, values):
        return F.coalesce(F.lower(s["severity_text"]).isin(*values), F.lit(False))

    mild = F.size(F.filter(items, lambda s: worded(s, ["mild", "low"])))
    some = F.size(items) > 0

    def card(title):
        icon, kind = dims.SMART_INSIGHTS[title]
        return F.struct(F.lit(title).alias("title"), F.lit(kind).alias("kind"), F.lit(icon).alias("icon"),
                        F.lit(title + dims.SMART_DESCRIPTION).alias("description"))

    shown = [
        (alert_level == "GREEN", "all_good"),
        (alert_level == "YELLOW", "monitor_closely"),
        (alert_level.isin("ORANGE", "RED"), "attention_needed"),
        (some & mentions(dims.MOOD_WORDS) & mentions(dims.SLEEP_WORDS), "mood_sleep_correlation"),
        (F.exists(items, lambda s: worded(s, ["severe", "high"])), "high_severity_symptoms"),
        (some & (mild * 10 >= F.size(items) * 7), "symptoms_improving"),
        (F.exists(F.coalesce(diagnoses, F.array()), lambda d: F.coalesce(d["urgency"], F.lit(0)) >= 4), "high_priority_conditions"),
    ]
    found = F.filter(F.array(*[F.when(cond, card(title)) for cond, title in shown]), lambda c: c.isNotNull())
    padding = F.array(card("general_health_tip"), card("wellness_reminder"))
    return F.slice(F.when(F.size(found) < 2, F.concat(found, padding)).otherwise(found), 1, 4)


def smart_insights(assessments: DataFrame) -> DataFrame:
    """F12 on the newest triaged assessment of every patient."""
    rows = with_triage(assessments).select(
        "user_id", "created_at", "assessment_id", "symptoms",
        F.col("triage.alert_level").alias("alert_level"),
        F.col("triage.diagnosis_predictions").alias("diagnoses"))
    latest = latest_per_key(rows, "user_id", ["created_at", "assessment_id"])
    cards = insight_cards(F.col("symptoms"), F.col("alert_level"), F.col("diagnoses"))
    return latest.select("user_id", cards.alias("insights"))
