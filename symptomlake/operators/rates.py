"""Request-rate audits over trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rate_audit(log: DataFrame, keys: list[str], ts: str, window_s: int, limit: int, inclusive: bool = True) -> DataFrame:
    """Requests per key and microsecond (``at_us``), how many preceded them
    in the trailing window, and how many of them exceed ``limit``.

    A request exactly ``window_s`` old counts if the window is ``inclusive``.
    The log is counted per microsecond first. Each is placed in a time bucket
    one window long and copied into the next one as context, so a window task
    sees one key for two windows of time, never a key's whole history.
    """
    width = window_s * 1_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    counts = log.select(*keys, F.timestamp_diff("MICROSECOND", epoch, F.col(ts)).alias("at_us")).groupBy(*keys, "at_us") \
        .agg(F.count("*").alias("requests"))
    bucket = F.expr(f"at_us div {width}")
    spread = counts.select(*keys, "at_us", "requests", bucket.alias("home"),
                           F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    trailing = (Window.partitionBy(*keys, "bucket").orderBy("at_us")
                .rangeBetween(-width if inclusive else 1 - width, -1))
    prior = F.coalesce(F.sum("requests").over(trailing), F.lit(0).cast("long"))
    rows = spread.withColumn("prior", prior).where(F.col("bucket") == F.col("home"))
    free = F.greatest(F.lit(limit) - F.col("prior"), F.lit(0))
    return rows.select(*keys, "at_us", "requests", "prior",
                       (F.col("requests") - F.least(F.col("requests"), free)).alias("over_limit"))


def too_many_issues(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """At most three codes in an hour."""
    return rate_audit(log, keys, ts, 3600, 3)


def too_many_attempts(log: DataFrame, keys: list[str], ts: str, failed: Column) -> DataFrame:
    """At most five failed attempts in less than a minute."""
    return rate_audit(log.where(failed), keys, ts, 60, 5, inclusive=False)


def early_reissues(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Requests within 30 seconds of an earlier one."""
    return rate_audit(log, keys, ts, 30, 1)
