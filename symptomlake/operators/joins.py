"""Join shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def salted_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str,
                salts: int = SALTS) -> DataFrame:
    """Join where one key may hold a large share of ``rows``.

    ``rows`` of a key are dealt over ``salts`` reducers by the partition they
    come from (the same again when a task is retried); ``lookup``, the smaller
    side, is repeated once per salt. The copies are never broadcast: the size
    check counts a lookup once, the driver would hold it ``salts`` times.
    """
    dealt = rows.withColumn("_salt", F.spark_partition_id() % salts)
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
