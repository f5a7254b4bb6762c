"""Care-team views: patient panels, alert lists and access scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import escalation, triage
from .accounts import drop_sensitive
from .ranking import newest_n


def care_assignments(doctors: DataFrame) -> DataFrame:
    """(doctor_id, user_id) rows from the ``patients`` list of every doctor."""
    return doctors.select("doctor_id", F.explode("patients").alias("user_id"))


def care_panel(assignments: DataFrame, patients: DataFrame, assessments: DataFrame) -> DataFrame:
    """Profile, latest alert level and date of every assigned patient.

    Patients without a profile are dropped; without triage the alert columns
    are null. Assessments shrink to one row per patient before the join.
    """
    latest = triage.latest_triage(assessments).select(
        "user_id", F.col("alert_level").alias("latest_alert_level"),
        F.col("created_at").alias("last_assessment_date"))
    return (assignments.select("doctor_id", "user_id")
            .join(drop_sensitive(patients), "user_id")
            .join(latest, "user_id", "left"))


def doctor_alerts(assignments: DataFrame, assessments: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` flagged assessments of every doctor's patients.

    The newest ``n`` per doctor are among the newest ``n`` per patient, so each
    patient is cut to ``n`` rows first; a very active patient cannot skew the
    join. The nested alert level wins; the top-level one stands in when there
    is no triage.
    """
    rows = escalation.flagged(assessments).select(
        "user_id", "created_at", "assessment_id", "session_id", "triage",
        F.col("alert_level").alias("own_level"), "oncologist_notification_level", "assessment_type")
    per_patient = newest_n(rows, "user_id", ["created_at", "assessment_id"], n).drop("newest_rank")
    joined = assignments.select("doctor_id", "user_id").distinct().join(per_patient, "user_id")
    top = newest_n(joined, "doctor_id", ["created_at", "assessment_id"], n)
    no_list = F.array().cast("array<string>")
    return top.select(
        "doctor_id", F.col("newest_rank").alias("rank"), "session_id", "user_id",
        F.when(F.col("triage").isNotNull(), F.col("triage.alert_level"))
        .otherwise(F.col("own_level")).alias("alert_level"),
        F.col("triage.alert_rationale").alias("alert_rationale"),
        F.coalesce("triage.key_symptoms", no_list).alias("key_symptoms"),
        F.col("triage.recommended_timeline").alias("recommended_timeline"),
        F.col("triage.confidence_level").alias("confidence_level"),
        "oncologist_notification_level", "assessment_type", "created_at")


def accessible_rows(viewers: DataFrame, assignments: DataFrame, df: DataFrame) -> DataFrame:
    """Rows each viewer may see: their own, and a doctor's patients' rows.

    ``viewers`` has (viewer_id, doctor_id, user_id); either id may be null. Duplicate rights are
    removed before the join so no row is returned twice.
    """
    own = viewers.where(F.col("user_id").isNotNull()).select("viewer_id", "user_id")
    cared = (viewers.where(F.col("doctor_id").isNotNull()).select("viewer_id", "doctor_id")
             .join(assignments.select("doctor_id", "user_id"), "doctor_id")
             .select("viewer_id", "user_id"))
    return own.unionByName(cared).distinct().join(df, "user_id")
