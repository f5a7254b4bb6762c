"""Streaks and achievements.

Everything starts from distinct (user, day) pairs: however often a user checks
in, at most one row per calendar day reaches the per-user steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..functions.timing import as_datetime


def active_days(activity: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct days with activity; duplicates collapse before the shuffle."""
    return activity.select("user_id", F.to_date(ts).alias("day")).where(F.col("day").isNotNull()).distinct()


def streak_islands(days: DataFrame) -> DataFrame:
    """Runs of consecutive days per user."""
    order = Window.partitionBy("user_id").orderBy("day")
    run = F.date_sub("day", F.row_number().over(order))
    return (days.withColumn("run", run).groupBy("user_id", "run")
            .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                 F.count("*").alias("length"))
            .drop("run"))


def active_streak(users: DataFrame, islands: DataFrame, as_of) -> DataFrame:
    """Current and longest streak of every user.

    The current streak counts only if its last day is ``as_of`` or the day before.
    """
    today = F.lit(as_datetime(as_of).date())
    per_user = islands.groupBy("user_id").agg(
        F.max(F.struct("last_day", "length")).alias("last"), F.max("length").alias("longest_streak"))
    zero = F.lit(0).cast("long")
    fresh = F.col("last.last_day").between(F.date_sub(today, 1), today)
    return users.select("user_id").join(per_user, "user_id", "left").select(
        "user_id", F.when(fresh, F.col("last.length")).otherwise(zero).alias("streak"),
        F.coalesce("longest_streak", zero).alias("longest_streak"),
        F.col("last.last_day").alias("last_completion"))


def overall_longest(checkin_islands: DataFrame, questionnaire_islands: DataFrame) -> DataFrame:
    """Longest run of either kind, the number achievements are judged by."""
    return (checkin_islands.select("user_id", "length")
            .unionByName(questionnaire_islands.select("user_id", "length"))
            .groupBy("user_id").agg(F.max("length").alias("longest_streak")))


def latest_island(islands: DataFrame) -> DataFrame:
    """The most recent run of every user."""
    return (islands.groupBy("user_id")
            .agg(F.max(F.struct("last_day", "first_day", "length")).alias("i"))
            .select("user_id", "i.first_day", "i.last_day", "i.length"))


def _catalogue():
    """The achievement catalogue as a literal array: no join is planned for it."""
    return F.array(*[F.struct(
        F.lit(pos).alias("position"), F.lit(a[0]).alias("achievement_id"), F.lit(a[1]).alias("type"),
        F.lit(a[2]).alias("title"), F.lit(a[3]).alias("title_zh"), F.lit(a[4]).alias("description"),
        F.lit(a[5]).alias("description_zh"),
        F.lit(a[6]).alias("threshold"), F.lit(a[0]).alias("badge_image")) for pos, a in enumerate(dims.ACHIEVEMENTS)])


def reached(streaks: DataFrame) -> DataFrame:
    """Achievements whose threshold the longest streak has reached."""
    hit = F.filter(_catalogue(), lambda a: a["threshold"] <= F.col("longest_streak"))
    return (streaks.select("user_id", F.explode(hit).alias("a"))
            .select("user_id", "a.achievement_id", "a.threshold"))


def newly_unlocked(reached_rows: DataFrame, unlocked: DataFrame) -> DataFrame:
    """Reached but not yet stored."""
    return reached_rows.join(unlocked, ["user_id", "achievement_id"], "left_anti")


def achievement_status(streaks: DataFrame, unlocked: DataFrame) -> DataFrame:
    """The full catalogue per user with unlock state and progress."""
    rows = streaks.select("user_id", "streak", F.explode(_catalogue()).alias("a"))
    done = unlocked.select("user_id", "achievement_id", "unlocked_at")
    return (rows.select("user_id", "streak", "a.*")
            .join(done, ["user_id", "achievement_id"], "left")
            .select("user_id", "achievement_id", "type", "title", "title_zh", "description", "description_zh",
                    F.col("unlocked_at").isNotNull().alias("unlocked"), "unlocked_at",
                    F.least(F.col("streak"), F.col("threshold").cast("long")).alias("progress"),
                    F.col("threshold").alias("total"), "threshold", "badge_image"))


def unlock_dates(islands: DataFrame) -> DataFrame:
    """First day the running streak reached each threshold.

    Within a run the threshold falls on ``first_day + threshold - 1``.
    """
    hit = F.filter(_catalogue(), lambda a: a["threshold"] <= F.col("length"))
    return (islands.select("user_id", "first_day", F.explode(hit).alias("a"))
            .groupBy("user_id", F.col("a.achievement_id").alias("achievement_id"))
            .agg(F.min(F.date_add("first_day", F.col("a.threshold") - 1)).alias("unlocked_on")))
