"""Monthly analytics: alert days, heat maps and severity per day of month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rounding, symptoms as S, timing


def month_of(assessments: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """Assessments of the target month."""
    return assessments.where(timing.in_month(F.col("created_at"), as_of, offset))


def monthly_alerts_by_day(assessments: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """Flagged assessments per day of month, days without any left out."""
    return (month_of(assessments, as_of, offset)
            .where(F.coalesce("flag_for_oncologist", F.lit(False)))
            .groupBy("user_id", F.dayofmonth("created_at").alias("day_of_month"))
            .agg(F.count("*").alias("alerts")))


def _reports(assessments, as_of, offset):
    return month_of(assessments, as_of, offset).select(
        "user_id", F.dayofmonth("created_at").alias("day_of_month"),
        F.explode("symptoms").alias("s"))


def monthly_symptom_heatmap(assessments: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """Highest severity per symptom and day; zeros count, floor is zero."""
    return (_reports(assessments, as_of, offset)
            .select("user_id", F.col("s.symptom").alias("symptom"), "day_of_month",
                    S.rated_severity(F.col("s")).alias("severity"))
            .where(F.col("severity").isNotNull())
            .groupBy("user_id", "symptom", "day_of_month")
            .agg(F.greatest(F.max("severity"), F.lit(0)).alias("severity")))


def monthly_severity_by_day(assessments: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """A10: per day the highest of the per-assessment mean severities."""
    total, n = S.mean_severity_parts(F.col("symptoms"))
    return (month_of(assessments, as_of, offset)
            .select("user_id", F.dayofmonth("created_at").alias("day_of_month"),
                    rounding.ratio(total, n).alias("mean"))
            .groupBy("user_id", "day_of_month").agg(F.max("mean").alias("top"))
            .where(F.col("top").isNotNull())
            .select("user_id", "day_of_month", F.greatest("top", F.lit(0.0)).alias("severity")))


def available_symptoms(assessments: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """Distinct symptom names, text entries included, as long rows."""
    return (_reports(assessments, as_of, offset)
            .select("user_id", F.col("s.symptom").alias("symptom")).distinct())


def monthly_report(users: DataFrame, assessments: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """Month header for every user, with zeros where there is no data."""
    start, end = timing.month_bounds(as_of, offset)
    counts = month_of(assessments, as_of, offset).groupBy("user_id").agg(
        F.count("*").alias("total_assessments"),
        F.count_if(F.coalesce("flag_for_oncologist", F.lit(False))).alias("total_alerts"))
    zero = F.lit(0).cast("long")
    first = F.lit(start.date())
    return users.select("user_id").join(counts, "user_id", "left").select(
        "user_id",
        F.coalesce("total_assessments", zero).alias("total_assessments"),
        F.coalesce("total_alerts", zero).alias("total_alerts"),
        F.date_format(first, "MMMM yyyy").alias("month_label"),
        F.lit(offset).alias("month_offset"),
        F.year(first).alias("year"), F.month(first).alias("month"),
        first.alias("month_start"), F.last_day(first).alias("month_end"),
        F.dayofmonth(F.last_day(first)).alias("days_in_month"))
