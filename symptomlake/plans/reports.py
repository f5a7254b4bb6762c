"""Composed answers: the whole week, a scored questionnaire, a doctor's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import careteam, messages, questionnaire, scheduling, triage, weekly


def weekly_answer(users: DataFrame, assessments: DataFrame, as_of, offset: int = 0) -> dict[str, DataFrame]:
    """Everything the weekly screen shows, for all users.

    The long parts stay separate DataFrames because their size per user has no bound.
    """
    return {
        "report": weekly.weekly_report(users, assessments, as_of, offset),
        "daily": weekly.weekly_daily_series(assessments, as_of, offset),
        "by_symptom": weekly.weekly_severity_by_symptom(assessments, as_of, offset),
        "trends": weekly.symptom_trend_matrix(assessments, as_of, offset),
    }


def scored_submissions(submissions: DataFrame, assessments: DataFrame, *columns) -> DataFrame:
    """Submissions that still need scoring, enriched and rendered as messages.

    Those with too few messages are left to ``messages.triage_status``. If
    ``columns`` (with ``submission_id``) are asked for, all submissions are
    enriched where they lie, and only these columns meet the records.
    """
    if not columns:
        submissions = messages.pending_questionnaires(submissions, assessments)
    rows = messages.with_messages(questionnaire.enrich(submissions, talk=True)).where(F.size("messages") >= messages.MIN_MESSAGES)
    return messages.pending_questionnaires(rows.select(*columns), assessments) if columns else rows


def doctor_day(assignments: DataFrame, patients: DataFrame, assessments: DataFrame,
               slots: DataFrame, events: DataFrame, n_alerts: int = 50) -> dict[str, DataFrame]:
    """Panel, newest alerts, recent triage and free slots of every doctor."""
    return {
        "panel": careteam.care_panel(assignments, patients, assessments),
        "alerts": careteam.doctor_alerts(assignments, assessments, n_alerts),
        "history": assignments.select("doctor_id", "user_id").distinct()
        .join(triage.triage_history(assessments), "user_id"),
        "free": scheduling.free_slots(slots, events),
    }
