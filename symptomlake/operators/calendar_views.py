"""Week, month and year views of a symptom history."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from .. import dims
from ..functions import rounding, symptoms as S, timing


def severity_calendar(assessments: DataFrame, month) -> DataFrame:
    """42-cell month grid per patient with the highest severity of each day.

    The grid starts on the Monday on or before the first. Days of the month are
    conditional maxima in one aggregation; the grid is unfolded afterwards.
    """
    start, end = timing.month_bounds(month)
    n_days = (end - start).days
    first_cell = start.date() - timedelta(days=start.weekday())
    rows = assessments.where(timing.in_bounds(F.col("created_at"), (start, end))).select(
        "user_id", F.dayofmonth("created_at").alias("d"), S.max_severity(F.col("symptoms")).alias("sev"))
    per_day = (rows.groupBy("user_id", "d").agg(F.max("sev").alias("sev"), F.count("*").alias("n"))
               .groupBy("user_id").agg(F.map_from_entries(F.collect_list(
                   F.struct("d", F.struct("sev", "n")))).alias("by_day")))   # at most 31 entries
    cell = F.sequence(F.lit(first_cell), F.lit(first_cell + timedelta(days=41)))
    in_month = F.col("cell").between(F.lit(start.date()), F.lit(start.date() + timedelta(days=n_days - 1)))
    hit = F.when(in_month, F.col("by_day")[F.dayofmonth("cell")])
    return (per_day.select("user_id", "by_day", F.explode(cell).alias("cell"))
            .select("user_id", "cell", in_month.alias("in_month"),
                    hit["sev"].alias("max_severity"),
                    F.coalesce(hit["n"], F.lit(0).cast("long")).alias("assessments")))


def day_severity(assessments: DataFrame, first, last) -> DataFrame:
    """Highest severity per patient and day of an inclusive date range."""
    return (assessments.where(timing.between_dates(F.col("created_at"), first, last))
            .select("user_id", F.to_date("created_at").alias("day"),
                    S.max_severity(F.col("symptoms")).alias("sev"))
            .groupBy("user_id", "day").agg(F.max("sev").alias("max_severity")))


def monthly_symptom_averages(assessments: DataFrame, month) -> DataFrame:
    """Mean severity per symptom of a month; order by ``mean_severity`` for one patient."""
    start, end = timing.month_bounds(month)
    rows = (assessments.where(timing.in_bounds(F.col("created_at"), (start, end)))
            .select("user_id", F.explode("symptoms").alias("s"))
            .select("user_id", F.col("s.symptom").alias("symptom"),
                    S.rated_severity(F.col("s")).alias("sev")).where(F.col("sev").isNotNull()))
    sums = rows.groupBy("user_id", "symptom").agg(F.sum("sev").alias("total"), F.count("*").alias("n"))
    mean = rounding.ratio(F.col("total"), F.col("n"))
    return sums.select("user_id", "symptom", "n", mean.alias("mean_severity"),
                       rounding.mean_rounded("total", "n", 1, "up").alias("shown"))


def yearly_summary(assessments: DataFrame, year: int) -> DataFrame:
    """Twelve dense months per patient, mean severity of the five symptoms."""
    bounds = timing.month_bounds(date(year, 1, 1))[0], timing.month_bounds(date(year + 1, 1, 1))[0]
    rows = (assessments.where(timing.in_bounds(F.col("created_at"), bounds))
            .select("user_id", F.month("created_at").alias("month"),
                    F.posexplode_outer("symptoms").alias("pos", "s"))
            .select("user_id", "month", F.coalesce("pos", F.lit(0)).alias("pos"),
                    F.col("s.symptom").alias("symptom"), S.rated_severity(F.col("s")).alias("sev")))
    aggs = [F.count_if(F.col("pos") == 0).alias("assessments")]
    for s in dims.CHART_SYMPTOMS:
        aggs.append(F.avg(F.when(F.col("symptom") == s, F.col("sev"))).alias(s))
    fields = ["assessments"] + dims.CHART_SYMPTOMS
    months = (rows.groupBy("user_id", "month").agg(*aggs)
              .groupBy("user_id").agg(F.map_from_entries(F.collect_list(
                  F.struct("month", F.struct(*fields)))).alias("by_month")))  # at most 12 entries
    cell = F.col("by_month")[F.col("month")]
    return (months.select("user_id", "by_month", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
            .select("user_id", "month", F.coalesce(cell["assessments"], F.lit(0).cast("long")).alias("assessments"),
                    *[cell[s].alias(s) for s in dims.CHART_SYMPTOMS]))


def alert_days_by_month(assessments: DataFrame) -> DataFrame:
    """Assessments, alerts and distinct alert days per month.

    Days are counted first, so the distinct count is a plain sum over days.
    """
    days = assessments.groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("flag_for_oncologist", F.lit(False))).alias("alerts"))
    return days.groupBy("user_id", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("n").alias("assessments"), F.sum("alerts").alias("alerts"),
        F.count_if(F.col("alerts") > 0).alias("alert_days"))


def weekly_rollup(assessments: DataFrame, as_of) -> DataFrame:
    """Per week offset the count, alerts and mean of the per-assessment means.

    The means enter as decimals, so their sum does not depend on row order.
    """
    this_week, _ = timing.week_bounds(as_of)
    total, n = S.mean_severity_parts(F.col("symptoms"))
    back = F.expr(f"datediff(DATE'{this_week.date()}', to_date(date_trunc('week', created_at))) div 7")
    mean = rounding.ratio(total, n).cast("decimal(18,12)")
    agg = assessments.select("user_id", back.alias("weeks_back"), mean.alias("mean"),
                             F.coalesce("flag_for_oncologist", F.lit(False)).alias("flag")) \
        .groupBy("user_id", "weeks_back").agg(
            F.count("*").alias("assessments"), F.count_if("flag").alias("alerts"),
            (F.sum("mean").cast("double") / F.count("mean")).alias("mean"))
    label = (F.when(F.col("weeks_back") == 0, "Current Week").when(F.col("weeks_back") == 1, "Last Week")
             .otherwise(F.concat(F.col("weeks_back").cast("string"), F.lit(" Weeks Ago"))))
    return agg.select("user_id", "weeks_back", label.alias("week"), "assessments", "alerts",
                      F.coalesce("mean", F.lit(0.0)).alias("mean_severity"))


def severity_series(assessments: DataFrame, first, last) -> DataFrame:
    """Severity of the five charted symptoms per assessment, null when absent.

    One row per assessment, ordered per patient by time with a range-partitioned
    sort. ``charted_symptoms`` says which series a chart shows at all.
    """
    def value(name):
        hit = F.filter(S.entries(F.col("symptoms")), lambda s: s["symptom"] == name)
        return F.get(hit, F.lit(0))["severity_rating"].alias(name)

    return (assessments.where(timing.between_dates(F.col("created_at"), first, last))
            .select("user_id", "created_at", "assessment_id", *[value(s) for s in dims.CHART_SYMPTOMS]))


def charted_symptoms(series: DataFrame) -> DataFrame:
    """Which series a patient's chart shows (at least one value)."""
    return series.groupBy("user_id").agg(
        *[F.max(F.col(s).isNotNull()).alias(s) for s in dims.CHART_SYMPTOMS])
