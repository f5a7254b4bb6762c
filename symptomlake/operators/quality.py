"""Record conformance: violation codes and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions import symptoms as S


def _outside(value: Column, lo: int, hi: int) -> Column:
    """Missing or not within the bounds."""
    return ~F.coalesce(value.between(lo, hi), F.lit(False))


def _not_in(value: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def assessment_rules() -> dict[str, Column]:
    """Structured assessment: five symptoms rated 1..5 and known enum values."""
    items = S.entries(F.col("symptoms"))
    names = F.transform(items, lambda s: s["symptom"])
    missing = reduce(lambda a, b: a | b, [~F.array_contains(names, n) for n in dims.TARGET_SYMPTOMS])
    return {
        "symptom_missing": F.coalesce(missing, F.lit(True)),
        "severity_range": F.exists(items, lambda s: _outside(s["severity_rating"], 1, 5)),
        "frequency_range": F.exists(items, lambda s: _outside(s["frequency_rating"], 1, 5)),
        "notification_level": _not_in(F.col("oncologist_notification_level"), dims.NOTIFICATION_LEVELS),
        "treatment_status": _not_in(F.col("treatment_status"), dims.TREATMENT_STATUSES),
        "flag_missing": F.col("flag_for_oncologist").isNull(),
    }


def triage_rules() -> dict[str, Column]:
    """Triage result: required fields, enums, urgency 1..5."""
    t = "triage."
    required = [F.col(t + f).isNull() for f in
                ("alert_rationale", "key_symptoms", "recommended_timeline", "diagnosis_predictions")]
    return {
        "triage_missing": F.col("triage").isNull(),
        "required_field": reduce(lambda a, b: a | b, required),
        "alert_level": _not_in(F.col(t + "alert_level"), dims.ALERT_LEVELS),
        "confidence_level": _not_in(F.col(t + "confidence_level"), dims.CONFIDENCE_LEVELS),
        "urgency_range": F.coalesce(F.exists(t + "diagnosis_predictions",
                                             lambda d: _outside(d["urgency"], 1, 5)), F.lit(False)),
        "probability": F.coalesce(F.exists(t + "diagnosis_predictions",
                                           lambda d: _not_in(d["probability"], dims.CONFIDENCE_LEVELS)),
                                  F.lit(False)),
    }


def submission_rules() -> dict[str, Column]:
    """Bounds of a questionnaire submission."""
    return {
        "sections_completed": _outside(F.col("sections_completed"), 0, 13),
        "total_sections": _outside(F.col("total_sections"), 1, 13),
        "completion_percentage": _outside(F.col("completion_percentage"), 0, 100),
    }


def draft_rules() -> dict[str, Column]:
    return {"current_section": ~F.coalesce(F.col("current_section") >= 0, F.lit(False))}


def signup_rules() -> dict[str, Column]:
    """Lengths required of a new account, and the shape of its e-mail."""
    def length(c):
        return F.coalesce(F.length(c), F.lit(0))
    return {
        "username": length("username") < 4,
        "access_code": length("access_code") != 4,
        "password": length("password") < 4,
        "email": ~F.coalesce(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"), F.lit(False)),
    }


def conformance(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """adds ``violations``, the codes of all broken rules in rule order."""
    codes = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()])
    return df.withColumn("violations", F.array_compact(codes))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of rows that went through ``conformance``."""
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)
