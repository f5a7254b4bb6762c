"""Unified timeline, record lookup, assessment detail and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions import symptoms as S
from ..functions.text import message_counts, summary_text, title_symptom
from .ranking import newest_first

CHECKIN, CONVERSATION = "daily_checkin", "conversation"


def _has(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def _checkin_summary(answers: Column) -> Column:
    return F.concat(F.lit("Completed questionnaire with "), F.size(answers).cast("string"), F.lit(" responses"))


def timeline(checkins: DataFrame, assessments: DataFrame) -> DataFrame:
    """Check-ins and conversations in one schema, unsorted.

    Use ``newest_first(timeline(...), "date", "id")`` for display order.
    """
    answered = F.size(F.coalesce("answers", F.array().cast("array<string>")))
    left = checkins.select(
        F.col("checkin_id").cast("string").alias("id"), "user_id", F.lit(CHECKIN).alias("type"),
        F.col("timestamp").alias("date"), F.lit("Daily Check-in").alias("title"),
        _checkin_summary(F.coalesce("answers", F.array().cast("array<string>"))).alias("summary"),
        answered.alias("questions_answered"))
    history = _has(assessments, "conversation_history",
                   F.lit(None).cast("array<struct<role:string,content:string>>"))
    names = F.transform(S.entries(F.col("symptoms")), lambda s: s["symptom"])
    right = assessments.select(
        F.col("assessment_id").cast("string").alias("id"), "user_id",
        F.lit(CONVERSATION).alias("type"), F.col("created_at").alias("date"),
        F.lit("AI Chat").alias("title"),
        summary_text(_has(assessments, "assessment_summary", F.lit(None).cast("string"))).alias("summary"),
        *message_counts(history), F.size(names).alias("symptoms_assessed"),
        F.coalesce("oncologist_notification_level", F.lit("none")).alias("oncologist_notification_level"),
        F.coalesce("flag_for_oncologist", F.lit(False)).alias("flag_for_oncologist"))
    return left.unionByName(right, allowMissingColumns=True)


def timeline_sorted(checkins: DataFrame, assessments: DataFrame) -> DataFrame:
    return newest_first(timeline(checkins, assessments), "date", "id")


def timeline_counts(rows: DataFrame) -> DataFrame:
    """Entries per user and source."""
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_assessments"),
        F.count_if(F.col("type") == CHECKIN).alias("daily_checkins"),
        F.count_if(F.col("type") == CONVERSATION).alias("conversations"))


def lookup_records(ids: DataFrame, assessments: DataFrame, checkins: DataFrame) -> DataFrame:
    """The whole record of each requested (id, user_id); a conversation wins over a check-in.

    A conversation has the fields of A16 with its symptoms, a check-in its
    answers; the fields of the other kind are null.
    """
    said = summary_text(_has(assessments, "assessment_summary", F.lit(None).cast("string"))).alias("summary")
    detail = assessment_detail(assessments, said).withColumnsRenamed({"assessment_id": "id", "created_at": "date"}).withColumn(
        "id", F.col("id").cast("string"))
    answers = F.coalesce("answers", F.array().cast("array<string>"))
    left = checkins.select(
        F.col("checkin_id").cast("string").alias("id"), "user_id", F.lit(CHECKIN).alias("type"), F.lit("Daily Check-in").alias("title"),
        F.col("timestamp").alias("date"), _checkin_summary(answers).alias("summary"), answers.alias("answers"),
        F.size(answers).alias("questions_answered"),
        F.col("timestamp").alias("completion_time"))
    both = detail.unionByName(left, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in ("id", "user_id")]
    found = ids.select("id", "user_id").distinct().join(both, ["id", "user_id"])
    pick = F.min_by(F.struct(*fields), F.when(F.col("type") == CONVERSATION, 0).otherwise(1)).alias("r")
    return found.groupBy("id", "user_id").agg(pick).select("id", "user_id", "r.*")


def _known_symptoms(items: Column) -> Column:
    """The known symptoms of an assessment with names, icons and notes; missing ratings count 1."""
    def shown(values, key):
        out = F.lit(None).cast("string")
        for name, value in values.items():
            out = F.when(key == name, F.lit(value)).otherwise(out)
        return out
    return F.transform(F.filter(items, lambda s: s["symptom"].isin(*dims.TARGET_SYMPTOMS)), lambda s: F.struct(
        s["symptom"].alias("symptom"), shown(dims.SYMPTOM_DISPLAY, s["symptom"]).alias("name"),
        shown(dims.SYMPTOM_ICONS, s["symptom"]).alias("icon"),
        F.coalesce(s["frequency_rating"], F.lit(1)).alias("frequency"), F.coalesce(s["severity_rating"], F.lit(1)).alias("intensity"),
        F.coalesce(s["key_indicators"], F.array().cast("array<string>")).alias("key_indicators"),
        F.coalesce(s["additional_notes"], F.lit("")).alias("additional_notes"), F.lit(True).alias("discussed")))


def assessment_detail(assessments: DataFrame, *more: Column) -> DataFrame:
    """The detail of every assessment and the columns in ``more``, computed row by row.

    Only the five known symptoms enter the mean (missing ratings count 1);
    ``symptoms_tracked`` counts every name.
    """
    items = S.entries(F.col("symptoms"))
    known = _known_symptoms(items)
    total = F.aggregate(known, F.lit(0), lambda acc, s: acc + s["intensity"])
    flag = F.coalesce("flag_for_oncologist", F.lit(False))
    return assessments.select(
        "assessment_id", "user_id", F.lit(CONVERSATION).alias("type"), F.lit("AI Chat").alias("title"), "session_id", "created_at",
        _has(assessments, "completed_at", F.lit(None).cast("timestamp")).alias("completed_at"),
        F.coalesce(_has(assessments, "ai_powered", F.lit(None).cast("boolean")), F.lit(False)).alias("ai_powered"),
        F.size(items).alias("symptoms_tracked"), F.transform(items, lambda s: s["symptom"]).alias("symptoms_assessed"),
        F.size(known).alias("symptoms_known"), known.alias("symptoms_data"),
        (total / F.greatest(F.size(known), F.lit(1))).alias("avg_severity"),
        F.when(flag, 1).otherwise(0).alias("alerts_today"),
        F.coalesce(_has(assessments, "treatment_status", F.lit(None).cast("string")), F.lit("Currently in Treatment")).alias("treatment_status"),
        F.coalesce("oncologist_notification_level", F.lit("none")).alias("oncologist_notification_level"),
        flag.alias("flag_for_oncologist"), *more)


def symptom_detail(assessments: DataFrame) -> DataFrame:
    """A16, long form: one row per known symptom with its display name, icon, ratings, indicators and notes."""
    return assessments.select("assessment_id", "user_id", F.inline(_known_symptoms(S.entries(F.col("symptoms")))))


def patient_reports(assessments: DataFrame) -> DataFrame:
    """listing rows, one per symptom, newest assessment of a patient first.

    The order is a range-partitioned sort over (user, time), so one patient's
    rows may spread over many partitions.
    """
    def rating(field):
        return F.concat(F.coalesce(F.col(f"s.{field}").cast("string"), F.lit("N/A")), F.lit("/5"))

    return (assessments
            .select("user_id", "created_at", "assessment_id", "session_id", "language",
                    F.when(F.col("ai_powered"), "Yes").otherwise("No").alias("ai_powered"),
                    F.when(F.col("flag_for_oncologist"), "Yes").otherwise("No").alias("flagged"),
                    F.upper("oncologist_notification_level").alias("notification_level"),
                    F.posexplode_outer("symptoms").alias("pos", "s"))
            .select("user_id", "created_at", "assessment_id", "session_id", "language", "ai_powered",
                    "flagged", "notification_level", "pos",
                    title_symptom(F.col("s.symptom")).alias("symptom"),
                    F.when(F.col("s").isNotNull(), rating("frequency_rating")).alias("frequency"),
                    F.when(F.col("s").isNotNull(), rating("severity_rating")).alias("severity")))
