"""Latest-row and newest-N selection per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def newest_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of every key, ``order`` newest first.

    The rank filter is planned as a group limit in front of the shuffle: each
    map task forwards at most ``n`` rows per key, however large the key is.
    """
    rank = F.row_number().over(
        Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return df.withColumn("newest_rank", rank).where(F.col("newest_rank") <= n)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of every key."""
    return newest_n(df, key, order, 1).drop("newest_rank")


def newest_first(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    """O1: newest first, rows without a date last (range-partitioned sort)."""
    return df.orderBy(F.col(ts).desc_nulls_last(), *[F.col(c).desc() for c in ties])


def newest_overall(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """O2: global newest ``n``; every task keeps only its own top ``n``."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
