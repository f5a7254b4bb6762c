"""Weekly analytics of every patient in one pass.

All operators start from one week of ``assessments`` (pushed-down time filter)
and aggregate straight to small keys. Partial aggregation on the map side means
that a patient holding a large share of the rows arrives at the shuffle as a
handful of rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions import rounding, symptoms as S, timing
from ..functions.text import title_symptom

TREND_STEP = 5  # tenths of a severity point


def week_of(assessments: DataFrame, as_of, offset: int = 0, exact_bounds: bool = False) -> DataFrame:
    """Assessments of the target week (P5)."""
    return assessments.where(timing.in_week(F.col("created_at"), as_of, offset, exact_bounds))


def positive_reports(week: DataFrame) -> DataFrame:
    """One row per rated symptom with severity above zero."""
    return (week.select("user_id", "created_at", "assessment_id",
                        F.posexplode_outer("symptoms").alias("pos", "s"))
            .select("user_id", "created_at", "assessment_id", "pos",
                    F.col("s.symptom").alias("symptom"),
                    S.rated_severity(F.col("s")).alias("severity"))
            .where(F.col("severity") > 0))


def _positive_parts(symptoms: Column) -> tuple[Column, Column]:
    hit = F.filter(S.entries(symptoms),
                   lambda s: (s["shape"] == S.RATED) & (s["severity_rating"] > 0))
    return F.aggregate(hit, F.lit(0), lambda acc, s: acc + s["severity_rating"]), F.size(hit)


def _user_week(week: DataFrame, as_of, offset: int) -> DataFrame:
    """One row per patient: a 7-element ``days`` array and the alert counters.

    The per-assessment parts are computed row-locally and the seven days are
    conditional sums, so the whole week costs a single shuffle.
    """
    total, n = _positive_parts(F.col("symptoms"))
    rows = week.select(
        "user_id", timing.day_in_week(F.col("created_at"), as_of, offset).alias("day"),
        total.alias("sev_sum"), n.alias("sev_n"),
        F.coalesce("flag_for_oncologist", F.lit(False)).alias("flag"),
        F.coalesce("oncologist_notification_level", F.lit("none")).alias("level"))
    aggs = []
    for d in range(7):
        aggs += [F.expr(f"count_if(day = {d}) AS n{d}"),
                 F.expr(f"sum(CASE WHEN day = {d} THEN sev_sum ELSE 0 END) AS s{d}"),
                 F.expr(f"sum(CASE WHEN day = {d} THEN sev_n ELSE 0 END) AS c{d}")]
    aggs += [F.count("*").alias("total_assessments"), F.count_if("flag").alias("total_alerts")]
    aggs += [F.count_if(F.col("level") == v).alias(f"alerts_{v}") for v in dims.NOTIFICATION_LEVELS]
    start, _ = timing.week_bounds(as_of, offset)

    raw = ", ".join(f"named_struct('day', date_add(DATE'{start.date()}', {d}), 'total', s{d}, 'n', c{d}, "
                    f"'seen', n{d})" for d in range(7))
    days = F.expr(f"transform(array({raw}), d -> named_struct('day', d.day, "
                  f"'tenths', coalesce({rounding.mean_scaled('d.total', 'd.n')}, 0L), "
                  f"'assessment_count', d.seen, 'has_data', d.seen > 0))")
    return rows.groupBy("user_id").agg(*aggs).select(
        "user_id", "total_assessments", "total_alerts",
        *[f"alerts_{v}" for v in dims.NOTIFICATION_LEVELS], days.alias("days"))


def _trend(days: Column) -> Column:
    """Last three against first three days, from the already rounded averages."""
    def side(first):
        part = F.filter(F.slice(days, first, 3), lambda d: d["has_data"] & (d["tenths"] > 0))
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, d: a + d["tenths"]), F.size(part)

    early, n_early = side(1)
    late, n_late = side(5)
    gap = late * n_early - early * n_late      # (late mean - early mean) * n_early * n_late
    step = F.lit(TREND_STEP) * n_early * n_late
    return (F.when((n_early == 0) | (n_late == 0), F.lit("Insufficient Data"))
            .when(gap < -step, F.lit("Improving"))
            .when(gap > step, F.lit("Concerning"))
            .otherwise(F.lit("Stable")))


def weekly_daily_series(assessments: DataFrame, as_of, offset: int = 0,
                        exact_bounds: bool = False) -> DataFrame:
    """A1: seven dense days per patient with data in the week."""
    week = _user_week(week_of(assessments, as_of, offset, exact_bounds), as_of, offset)
    return (week.select("user_id", F.explode_outer("days").alias("d"))
            .select("user_id", F.col("d.day").alias("day"),
                    (F.col("d.tenths") / F.lit(10.0)).alias("avg_severity"),
                    F.col("d.assessment_count").alias("assessment_count"),
                    F.col("d.has_data").alias("has_data")))


def weekly_severity_by_symptom(assessments: DataFrame, as_of, offset: int = 0,
                               exact_bounds: bool = False) -> DataFrame:
    """A2: mean severity above zero per symptom, rounded to one digit."""
    return (positive_reports(week_of(assessments, as_of, offset, exact_bounds))
            .groupBy("user_id", "symptom")
            .agg(F.sum("severity").alias("total"), F.count("*").alias("n"))
            .select("user_id", "symptom", "n",
                    rounding.mean_rounded("total", "n").alias("avg_severity")))


def most_concerning_symptom(assessments: DataFrame, as_of, offset: int = 0,
                            exact_bounds: bool = False) -> DataFrame:
    """A3: highest unrounded mean; the symptom seen first wins a tie."""
    first_seen = F.min(F.struct("created_at", "assessment_id", "pos"))
    per_symptom = (positive_reports(week_of(assessments, as_of, offset, exact_bounds))
                   .groupBy("user_id", "symptom")
                   .agg(F.sum("severity").alias("total"), F.count("*").alias("n"),
                        first_seen.alias("seen")))
    rank = F.struct((-rounding.ratio(F.col("total"), F.col("n"))).alias("mean"), F.col("seen"))
    top = per_symptom.groupBy("user_id").agg(
        F.min_by(F.struct("symptom", "total", "n"), rank).alias("top"))
    return top.select(
        "user_id", title_symptom(F.col("top.symptom")).alias("symptom_name"),
        rounding.mean_rounded("top.total", "top.n").alias("avg_severity"))


def weekly_alerts(assessments: DataFrame, as_of, offset: int = 0,
                  exact_bounds: bool = False) -> DataFrame:
    """A4: notification level distribution and number of flagged assessments."""
    level = F.coalesce("oncologist_notification_level", F.lit("none"))
    return week_of(assessments, as_of, offset, exact_bounds).groupBy("user_id").agg(
        *[F.count_if(level == v).alias(f"alerts_{v}") for v in dims.NOTIFICATION_LEVELS],
        F.count_if(F.coalesce("flag_for_oncologist", F.lit(False))).alias("total_alerts"))


def weekly_trend(assessments: DataFrame, as_of, offset: int = 0,
                 exact_bounds: bool = False) -> DataFrame:
    """A5: Improving / Concerning / Stable / Insufficient Data per patient."""
    week = _user_week(week_of(assessments, as_of, offset, exact_bounds), as_of, offset)
    return week.select("user_id", _trend(F.col("days")).alias("overall_trend"))


def symptom_trend_matrix(assessments: DataFrame, as_of, offset: int = 0,
                         exact_bounds: bool = False) -> DataFrame:
    """Last severity above zero per symptom and day."""
    return (positive_reports(week_of(assessments, as_of, offset, exact_bounds))
            .groupBy("user_id", "symptom", F.to_date("created_at").alias("day"))
            .agg(F.max_by("severity", F.struct("created_at", "assessment_id", "pos"))
                 .alias("severity")))


def weekly_insights(report: DataFrame, offset: int = 0) -> Column:
    """insight cards of a report row, in display order."""
    context = timing.week_label(offset).lower()
    now = offset == 0
    alerts, n, avg = F.col("total_alerts"), F.col("total_assessments"), F.col("top_avg_severity")
    values = {"context": F.lit(context), "alerts": alerts.cast("string"), "n": n.cast("string"), "name": F.col("top_symptom"),
              "lower_name": F.lower("top_symptom"), "avg": avg.cast("string")}
    shown = {
        "no_data": n == 0,
        "high_alerts": alerts > 3,
        "concerning_symptom": avg > 3.5,
        "improving_trend": F.col("overall_trend") == "Improving",
        "consistent_tracking": n >= 5,
        "low_engagement": (n > 0) & (n < 3) if now else F.lit(False),
    }

    def said(text):
        parts = [values[p] if k % 2 else F.lit(p) for k, p in enumerate(text.replace("}", "{").split("{")) if p]
        return F.concat(*parts)

    cards = [F.when(shown[cid], F.struct(F.lit(cid).alias("id"), F.lit(kind).alias("type"), F.lit(icon).alias("icon"), said(title).alias("title"),
                                         said(text + (more if now else "")).alias("description")))
             for cid, kind, icon, title, text, more in dims.WEEKLY_INSIGHTS]
    return F.filter(F.array(*cards), lambda c: c.isNotNull())


def _facts(week: DataFrame, as_of, offset: int) -> DataFrame:
    """Grouping sets of a week in one pass: a row per (patient, day) and one per (patient, symptom), each with its sums.

    Every assessment becomes one row of its day and one row of each symptom
    above zero; the map side reduces them to at most seven days and the
    symptoms of a patient before the shuffle, however many assessments a
    patient has.
    """
    items = F.transform(S.entries(F.col("symptoms")), lambda s, i: F.struct(
        s["symptom"].alias("symptom"), S.rated_severity(s).cast("long").alias("severity"), i.alias("pos")))
    hits = F.filter(items, lambda s: s["severity"] > 0)
    none = lambda kind: F.lit(None).cast(kind)
    day = F.struct(timing.day_in_week(F.col("created_at"), as_of, offset).cast("int").alias("day"), none("string").alias("symptom"),
                   F.aggregate(hits, F.lit(0).cast("long"), lambda acc, s: acc + s["severity"]).alias("total"),
                   F.size(hits).cast("long").alias("n"), none("int").alias("pos"))
    each = F.transform(hits, lambda s: F.struct(none("int").alias("day"), s["symptom"].alias("symptom"), s["severity"].alias("total"),
                                                F.lit(1).cast("long").alias("n"), s["pos"].alias("pos")))
    flag = F.coalesce("flag_for_oncologist", F.lit(False))
    level = F.coalesce("oncologist_notification_level", F.lit("none"))
    rows = week.select("user_id", "created_at", "assessment_id", flag.alias("flag"), level.alias("level"),
                       F.inline(F.concat(F.array(day), each)))
    of_day = F.col("day").isNotNull()
    return rows.groupBy("user_id", "day", "symptom").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.count_if(of_day).alias("seen"), F.count_if(of_day & F.col("flag")).alias("flags"),
        *[F.count_if(of_day & (F.col("level") == v)).alias(f"level_{v}") for v in dims.NOTIFICATION_LEVELS],
        F.min(F.when(~of_day, F.struct("created_at", "assessment_id", "pos"))).alias("first_seen"))


def _week_by_user(facts: DataFrame, as_of, offset: int) -> DataFrame:
    """One row per patient from ``_facts``: days, alert counters and the most concerning symptom."""
    at = lambda d, c: F.coalesce(F.sum(F.when(F.col("day") == d, F.col(c))), F.lit(0))
    of_symptom = F.col("day").isNull()
    rank = F.struct((-rounding.ratio(F.col("total"), F.col("n"))).alias("mean"), F.col("first_seen"))
    sums = [at(d, c).alias(f"{c}{d}") for d in range(7) for c in ("total", "n", "seen")]
    start, _ = timing.week_bounds(as_of, offset)
    raw = ", ".join(f"named_struct('day', date_add(DATE'{start.date()}', {d}), 'total', total{d}, 'n', n{d}, 'seen', seen{d})"
                    for d in range(7))
    days = F.expr(f"transform(array({raw}), d -> named_struct('day', d.day, "
                  f"'tenths', coalesce({rounding.mean_scaled('d.total', 'd.n')}, 0L), "
                  f"'assessment_count', d.seen, 'has_data', d.seen > 0))")
    return facts.groupBy("user_id").agg(
        *sums, F.sum("seen").alias("total_assessments"), F.sum("flags").alias("total_alerts"),
        *[F.sum(f"level_{v}").alias(f"alerts_{v}") for v in dims.NOTIFICATION_LEVELS],
        F.min_by(F.when(of_symptom, F.struct("symptom", "total", "n")), F.when(of_symptom, rank)).alias("top")).select(
        "user_id", "total_assessments", "total_alerts", *[f"alerts_{v}" for v in dims.NOTIFICATION_LEVELS], days.alias("days"),
        title_symptom(F.col("top.symptom")).alias("top_symptom"), rounding.mean_rounded("top.total", "top.n").alias("top_avg_severity"))


def weekly_report(users: DataFrame, assessments: DataFrame, as_of, offset: int = 0, exact_bounds: bool = False) -> DataFrame:
    """The whole weekly answer, one row per user, users without data included.

    The week is scanned once. Its days and its symptoms are grouping sets of one
    aggregation, and one exchange by user brings the few rows of a patient
    together; the join with the users uses the same partitioning.
    """
    start, end = timing.week_bounds(as_of, offset)
    week = _week_by_user(_facts(week_of(assessments, as_of, offset, exact_bounds), as_of, offset), as_of, offset)
    zero = F.lit(0).cast("long")
    report = users.select("user_id").join(week, "user_id", "left").select(
        "user_id",
        F.lit(timing.week_label(offset)).alias("week_label"),
        F.lit(offset).alias("week_offset"),
        F.lit(start.date()).alias("week_start"),
        F.date_sub(F.lit(end.date()), 1).alias("week_end"),
        *[F.coalesce(c, zero).alias(c) for c in
          ["total_assessments", "total_alerts"]
          + [f"alerts_{v}" for v in dims.NOTIFICATION_LEVELS]],
        "top_symptom", "top_avg_severity",
        F.when(F.col("days").isNull(), F.lit("No Data"))
        .otherwise(_trend(F.col("days"))).alias("overall_trend"),
        F.transform(F.col("days"), lambda d: F.struct(
            d["day"].alias("day"), (d["tenths"] / F.lit(10.0)).alias("avg_severity"),
            d["assessment_count"].alias("assessment_count"),
            d["has_data"].alias("has_data"))).alias("daily_data"))
    return report.withColumn("insights", weekly_insights(report, offset))
