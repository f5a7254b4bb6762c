"""Accounts: search, sign-up codes, audits and shared projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .joins import salted_join

SENSITIVE = ["password", "_id", "conversation_history", "otp_code", "otp_hash"]


def drop_sensitive(df: DataFrame) -> DataFrame:
    """Without secrets and bulky texts; the scan never reads them."""
    return df.drop(*SENSITIVE)


def search_users(users: DataFrame, term: str | None) -> DataFrame:
    """Literal, case-insensitive match in username, e-mail or full name."""
    rows = drop_sensitive(users)
    if not term:
        return rows
    hits = [F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
            for c in ("username", "email", "full_name")]
    return rows.where(reduce(lambda a, b: a | b, hits))


def _first_by_code(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.groupBy("code").agg(F.min(value).alias(out))


def taken_usernames(pending: DataFrame, patients: DataFrame, doctors: DataFrame) -> DataFrame:
    """Sign-ups whose username exists already, as patient, as doctor or in
    an earlier sign-up (the one with the lesser ``pending_id``).

    Only the distinct wanted names meet the account tables.
    """
    names = _existing(pending, patients, doctors).select(
        "username", "known", F.col("pending_id").alias("_first"))
    return (salted_join(pending, names, ["username"], "inner")
            .where(F.col("known") | (F.col("pending_id") > F.col("_first"))).select(*pending.columns))


def _existing(pending: DataFrame, patients: DataFrame, doctors: DataFrame) -> DataFrame:
    """Each wanted username once: its first sign-up, and whether an account has it.

    Both sides grow with the users, so neither is sent whole to the driver.
    """
    accounts = patients.select("username").unionByName(doctors.select("username")).distinct().withColumn("known", F.lit(True))
    return (pending.groupBy("username").agg(F.min("pending_id").alias("pending_id"))
            .join(accounts.hint("merge"), "username", "left").withColumn("known", F.coalesce("known", F.lit(False))))


def resolve_access_codes(pending: DataFrame, doctors: DataFrame, hospitals: DataFrame,
                         patients: DataFrame) -> DataFrame:
    """Role of every sign-up from its access code.

    A doctor's code makes a patient of that doctor, else a hospital's code makes
    a doctor, else the code is invalid; usernames of accounts
    and of earlier sign-ups are rejected. The first occurrence of a code counts.
    """
    docs = _first_by_code(doctors, "username", "doctor")
    hosp = _first_by_code(hospitals, "name", "hospital")
    existing = _existing(pending, patients, doctors).withColumnRenamed("pending_id", "first_id")
    codes = docs.join(hosp, "code", "full")   # one row per code, so popular codes can be salted once
    rows = salted_join(pending.withColumnRenamed("access_code", "code"), codes, ["code"], "left")
    rows = salted_join(rows, existing, ["username"], "left")
    status = (F.when(F.col("known") | (F.col("pending_id") > F.col("first_id")), "duplicate")
              .when(F.col("doctor").isNotNull(), "patient")
              .when(F.col("hospital").isNotNull(), "doctor").otherwise("invalid"))
    return rows.select("pending_id", "username", "code", status.alias("status"),
                       F.when(status == "patient", F.col("doctor")).alias("doctor"),
                       F.when(status == "doctor", F.col("hospital")).alias("hospital"))


def account_audit(accounts: DataFrame) -> DataFrame:
    """EMPTY / SHORT / DUPE flags per account.

    Only usernames that occur more than once are joined back, and the rows of
    one junk name are dealt over several tasks instead of meeting in a window.
    """
    name = F.coalesce("username", F.lit(""))
    counts = duplicate_usernames(accounts)
    rows = salted_join(accounts.withColumn("username", name), counts, ["username"], "left")
    flags = F.filter(F.array(
        F.when(F.trim("username") == "", "EMPTY").when(F.length("username") <= 3, "SHORT"),
        F.when(F.col("account_id") > F.col("first_id"), "DUPE")), lambda f: f.isNotNull())
    return rows.select("account_id", "username", flags.alias("flags"))


def duplicate_usernames(accounts: DataFrame) -> DataFrame:
    """Usernames used more than once, with their count and first account."""
    return (accounts.groupBy(F.coalesce("username", F.lit("")).alias("username"))
            .agg(F.count("*").alias("n"), F.min("account_id").alias("first_id"))
            .where(F.col("n") > 1))
