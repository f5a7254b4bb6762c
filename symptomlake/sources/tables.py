"""Table sources, sinks and maintenance."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.accounts import drop_sensitive
from ..operators.joins import salted_join
from ..operators.ranking import latest_per_key


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table stored as ``<path>/<name>.parquet`` (file or directory).

    Filters and columns chosen by the caller are pushed into the scan.
    """
    return spark.read.parquet(os.path.join(path, f"{name}.parquet"))


def write_append(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Append, one directory per partition value.

    Rows are gathered by partition value first, so that each value gets few
    files; a value with very many rows is split again.
    """
    df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per collection."""
    counts = [df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("collection"), "documents")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def sample_row(df: DataFrame, limit: int = 500) -> DataFrame:
    """One row as JSON text without secrets, cut for display."""
    doc = F.to_json(F.struct(*drop_sensitive(df).columns))
    return df.limit(1).select(F.concat(F.substring(doc, 1, limit), F.lit("...")).alias("sample"))


def latest_row(df: DataFrame, *order: str) -> DataFrame:
    """The newest row of a collection without secrets."""
    return drop_sensitive(df).orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(1)


def cascade_delete(users: DataFrame, related: dict[str, DataFrame],
                   usernames: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Survivors of every collection and the rows removed per collection.

    Names that are no user are ignored. A related collection that lost nothing
    is left out of the counts. The names are few against the documents, and a
    deleted user may own a large part of them, hence the salted joins.
    """
    doomed = usernames.select("username").distinct().join(users, "username", "left_semi")
    by_user_id = doomed.withColumnRenamed("username", "user_id")
    survivors = {"users": users.join(doomed, "username", "left_anti")}
    counts = [users.join(doomed, "username", "left_semi").agg(F.count("*").alias("removed"))
              .select(F.lit("users").alias("collection"), "removed")]
    for name, df in related.items():
        survivors[name] = salted_join(df, by_user_id, ["user_id"], "left_anti")
        counts.append(salted_join(df, by_user_id, ["user_id"], "left_semi").agg(F.count("*").alias("removed"))
                      .where(F.col("removed") > 0).select(F.lit(name).alias("collection"), "removed"))
    return survivors, reduce(DataFrame.unionByName, counts)


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows to append, the first per key by ``order`` and none whose key exists."""
    return first_per_key(new, keys, order).join(existing, keys, "left_anti").select(*new.columns)


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; a rank filter, so each task sends one row of a key at most."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_draft(drafts: DataFrame, *ties: str) -> DataFrame:
    """The last saved draft of every user."""
    return latest_per_key(drafts, "user_id", ["last_updated", *ties])


def without_users(df: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Rows of users whose draft was not deleted."""
    return salted_join(df, user_ids.select("user_id"), ["user_id"], "left_anti")


def apply_profile_updates(patients: DataFrame, updates: DataFrame, fields: list[str],
                          order: list[str]) -> DataFrame:
    """The latest update of a user overwrites its fields, nulls included;
    all other columns are kept."""
    last = latest_per_key(updates.select("user_id", *order, *[f for f in fields if f not in order]),
                          "user_id", order)
    last = last.select("user_id", F.struct(*fields).alias("_set"))
    rows = patients.join(last, "user_id", "left")
    return rows.select(*[
        F.when(F.col("_set").isNotNull(), F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in patients.columns])
