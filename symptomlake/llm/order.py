"""Global row numbers without a global window: range partitions, sorted inside, and one offset for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from symptomlake.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by ``keys`` over all partitions, with partition ``_part`` and place ``_at`` in it.

    Rows that agree in all keys are told apart by their place in the input, so
    that a key with most of the rows is cut into many ranges too.
    """
    spread = df.withColumn("_in", F.monotonically_increasing_id())
    parts = spread.repartitionByRange(*keys, "_in").sortWithinPartitions(*keys, "_in").drop("_in")
    return (parts.withColumn("_part", F.spark_partition_id())
            .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def part_offsets(parts: DataFrame, total) -> DataFrame:
    """``_part``, ``_before`` (sum of ``total`` over all earlier parts) and ``_all`` (over every part).

    One row for each partition, so the window and a broadcast of it are
    bounded by the number of partitions, not of rows.
    """
    sums = parts.groupBy("_part").agg(total.cast("long").alias("_sum"))
    return sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"),
                       F.sum("_sum").over(Window.orderBy("_part").rowsBetween(
                           Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``row_number`` (from 0, in the order of ``keys``) and ``n_rows``; written once to the shared folder."""
    parts = stored(sorted_parts(df, *keys), "numbered")
    offsets = part_offsets(parts, F.count(F.lit(1)))
    return (parts.join(F.broadcast(offsets), "_part")
            .withColumn("row_number", F.col("_before") + F.col("_at"))
            .withColumn("n_rows", F.col("_all")).drop("_part", "_at", "_before", "_all"))
