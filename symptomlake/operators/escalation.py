"""Clinical escalation and the assembled assessment record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions import symptoms as S

STAMP = "conversation_with_triage"


def escalate(df: DataFrame, status_col: str = "treatment_status") -> DataFrame:
    """adds ``flag``, ``level`` and ``reason`` of the first symptom over its limit."""
    rule = S.escalation(F.col("symptoms"), F.col(status_col))
    return (df.withColumn("escalation", rule)
            .select(*df.columns, "escalation.flag", "escalation.level", "escalation.reason"))


def merge_levels(df: DataFrame) -> DataFrame:
    """F3 over columns ``structured`` (flag, level) and ``triage`` (alert_level)."""
    merged = S.merge_notification(F.col("structured.level"), F.col("structured.flag"),
                                  F.col("triage").isNotNull(), F.col("triage.alert_level"))
    return (df.withColumn("merged", merged)
            .select(*df.columns, F.col("merged.alert_level").alias("alert_level"),
                    F.col("merged.level").alias("oncologist_notification_level"),
                    F.col("merged.flag").alias("flag_for_oncologist")))


def assemble_assessments(sessions: DataFrame, structured: DataFrame, triage: DataFrame) -> DataFrame:
    """one stored record per session from its two scoring results.

    ``structured`` has (session_id, structured), ``triage`` (session_id, triage);
    a session without one of them still gives a record.
    """
    rows = (sessions.join(structured, "session_id", "left").join(triage, "session_id", "left"))

    def default(name, value):
        present = name in sessions.columns
        return (F.coalesce(F.col(name), F.lit(value)) if present else F.lit(value)).alias(name)

    merged = merge_levels(rows)
    given = [c for c in merged.columns if c not in ("language", "input_mode", "state", "ai_powered")]
    return merged.select(
        *given, default("language", "en"), default("input_mode", "keyboard"),
        default("state", "completed"), default("ai_powered", False),
        F.lit(STAMP).alias("assessment_type"))


def _default_symptoms() -> Column:
    one = F.lit(1)
    return F.array(*[S._entry(F.lit(s), S.RATED, one, one, keys=F.array())
                     for s in ["cough", "nausea", "lack_of_appetite", "fatigue", "pain"]])


def with_default_records(df: DataFrame, message_count: Column) -> DataFrame:
    """conservative records where scoring failed.

    Expects ``symptoms`` (null = symptom scoring failed) and the triage fields
    ``triage_alert_level, triage_rationale, triage_timeline, triage_notes,
    triage_key_symptoms`` with ``triage_failed``. The default triage carries no
    confidence level and no urgency.
    """
    failed = F.coalesce(F.col("triage_failed"), F.lit(True))
    n = message_count.cast("string")
    return df.select(
        *[c for c in df.columns if c != "symptoms" and not c.startswith("triage_")],
        F.coalesce("symptoms", _default_symptoms()).alias("symptoms"),
        F.when(F.col("symptoms").isNull(), F.concat(F.lit("Conversation with "), n,
               F.lit(" messages completed."))).alias("conversation_notes"),
        F.when(failed, F.lit("YELLOW")).otherwise(F.col("triage_alert_level")).alias("triage_alert_level"),
        F.when(failed, F.lit("Unable to complete automated triage assessment - "
                             "recommend clinical review as precaution"))
        .otherwise(F.col("triage_rationale")).alias("triage_rationale"),
        F.when(failed, F.lit("within 24 hours")).otherwise(F.col("triage_timeline")).alias("triage_timeline"),
        F.when(failed, F.array(F.lit("System unable to analyze conversation")))
        .otherwise(F.col("triage_key_symptoms")).alias("triage_key_symptoms"),
        F.when(failed, F.concat(F.lit("Automated triage failed for conversation with "), n,
                                F.lit(" messages. Manual clinical assessment recommended.")))
        .otherwise(F.col("triage_notes")).alias("triage_notes"))


def describe_alerts(df: DataFrame, level_col: str = "alert_level",
                    language_col: str = "language") -> DataFrame:
    """Adds the sentence for the alert level in the row's language."""
    return df.withColumn("alert_description",
                         S.describe_alert(F.col(level_col), F.col(language_col)))


def flagged(df: DataFrame) -> DataFrame:
    """Flagged, or with an amber or red notification level."""
    return df.where(S.is_flagged(F.col("flag_for_oncologist"),
                                 F.col("oncologist_notification_level")))


def flatten_symptoms(df: DataFrame, json_col: str = "symptoms_json") -> DataFrame:
    """long ``symptom_reports`` from stored symptom documents of any shape."""
    keep = [c for c in df.columns if c != json_col]
    return (df.select(*keep, F.posexplode(S.symptom_entries(F.col(json_col))).alias("pos", "s"))
            .select(*keep, "pos", "s.*"))


def severity_names(df: DataFrame, level_col: str = "severity") -> DataFrame:
    """name and colour of a severity level."""
    return df.withColumns({"level_name": S.severity_level(F.col(level_col), "name"),
                           "level_color": S.severity_level(F.col(level_col), "color")})


def symptom_dimension(df: DataFrame, symptom_col: str = "symptom") -> DataFrame:
    """Display name of the five known symptoms, null for any other."""
    out = F.lit(None).cast("string")
    for key, name in dims.SYMPTOM_DISPLAY.items():
        out = F.when(F.col(symptom_col) == key, F.lit(name)).otherwise(out)
    return df.withColumn("display_name", out)
