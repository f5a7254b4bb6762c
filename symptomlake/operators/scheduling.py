"""Appointments: event normalization, slot parsing and free-slot search."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timing import as_datetime


def _clock(text: Column) -> Column:
    """Minutes after midnight of HHMM text; null unless hour and minute are valid."""
    hour = F.substring(text, 1, 2).try_cast("int")
    minute = F.substr(text, F.lit(3)).try_cast("int")
    ok = hour.between(0, 23) & minute.between(0, 59)
    return F.when(ok, hour * 60 + minute)


def parse_slots(slots: DataFrame) -> DataFrame:
    """(date, HHMM, HHMM) to minute bounds; unreadable slots are skipped."""
    return (slots.withColumns({"start_minute": _clock(F.col("start_time")),
                               "end_minute": _clock(F.col("end_time"))})
            .where(F.col("start_minute").isNotNull() & F.col("end_minute").isNotNull())
            .withColumn("duration_minutes", F.col("end_minute") - F.col("start_minute")))


def _at(day: Column, minute: Column) -> Column:
    return F.timestamp_add("MINUTE", minute, day.cast("timestamp_ntz"))


def busy_reach(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Per asked day of a doctor and start minute: how far busy time reaches.

    Cancelled and all-day events do not block. An event over midnight counts on
    each asked day it touches, one that ends before it starts on its start day.
    Events are cut to the span of days asked of their doctor before they are
    spread over days. At most 1440 rows per doctor and day remain.
    """
    days = asked.select("doctor_id", "date").distinct()
    span = days.groupBy("doctor_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    first, last = F.to_date("start"), F.greatest(F.to_date("start"), F.to_date("end"))
    blocking = events.where(F.coalesce(F.col("status") != "cancelled", F.lit(True))
                            & F.col("start").isNotNull() & F.col("end").isNotNull()).join(span, "doctor_id")
    inside = blocking.where((first <= F.col("hi")) & (last >= F.col("lo")))
    spread = inside.select("doctor_id", "start", "end", F.explode(
        F.sequence(F.greatest(first, "lo"), F.least(last, "hi"))).alias("date")).join(days, ["doctor_id", "date"], "left_semi")
    opens = F.greatest(F.col("start"), F.col("date").cast("timestamp_ntz"))
    return (spread.select("doctor_id", "date", "end",
                          (F.hour(opens) * 60 + F.minute(opens)).alias("minute"))
            .groupBy("doctor_id", "date", "minute").agg(F.max("end").alias("reach")))


def free_slots(slots: DataFrame, events: DataFrame) -> DataFrame:
    """Slots no busy interval overlaps (start < slot_end and end > slot_start).

    A slot overlaps iff the furthest end among events starting before the slot
    ends lies after the slot start. That is a running maximum over the minutes
    of one (doctor, day), so no pair of slot and event is ever formed and a
    crowded calendar day stays at 1440 event rows. Every request is answered,
    repeated ones too.
    """
    asked = parse_slots(slots).select("doctor_id", "date", "start_time", "end_time", "start_minute",
                                      "end_minute", "duration_minutes")
    none = F.lit(None)
    busy = busy_reach(events, asked).select(
        "doctor_id", "date", "minute", "reach", F.lit(1).alias("side"),
        none.cast("string").alias("start_time"), none.cast("string").alias("end_time"),
        none.cast("int").alias("start_minute"), none.cast("int").alias("end_minute"),
        none.cast("int").alias("duration_minutes"))
    want = asked.select("doctor_id", "date", F.col("end_minute").alias("minute"),
                        none.cast("timestamp_ntz").alias("reach"), F.lit(0).alias("side"),
                        "start_time", "end_time", "start_minute", "end_minute", "duration_minutes")
    # on equal minutes the slot comes first: an event starting at its end does not touch it
    upto = (Window.partitionBy("doctor_id", "date").orderBy("minute", "side")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = want.unionByName(busy).withColumn("reached", F.max("reach").over(upto))
    start = _at(F.col("date"), F.col("start_minute"))
    return (swept.where((F.col("side") == 0)
                        & (F.col("reached").isNull() | (F.col("reached") <= start)))
            .select("doctor_id", start.alias("start"),
                    _at(F.col("date"), F.col("end_minute")).alias("end"), "duration_minutes"))


def normalize_events(raw: DataFrame, start, end=None) -> DataFrame:
    """calendar entries in one shape within [start, end), 30 days by default.

    All-day entries cover 00:00:00-23:59:59; entries without any start are left
    out; title and status get defaults. Order with ``orderBy("start")`` and
    limit where a page is wanted.
    """
    first = as_datetime(start)
    last = as_datetime(end) if end else first + timedelta(days=30)
    begin = F.coalesce("start", F.col("start_date").cast("timestamp_ntz"))
    close = F.when(F.col("start").isNotNull(), F.col("end")).otherwise(
        F.timestamp_add("SECOND", F.lit(86399), F.col("end_date").cast("timestamp_ntz")))

    def at(v):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")

    mails = F.transform(F.col("attendees"), lambda a: F.coalesce(a["email"], F.lit(""))) \
        if "attendees" in raw.columns else F.array().cast("array<string>")
    return (raw.where(begin.isNotNull() & (begin < at(last)) & (close > at(first)))
            .select("event_id", "doctor_id",
                    F.coalesce("summary", F.lit("No Title")).alias("summary"),
                    begin.alias("start"), close.alias("end"),
                    F.coalesce("status", F.lit("confirmed")).alias("status"),
                    F.coalesce(mails, F.array().cast("array<string>")).alias("attendees")))


def upcoming(raw: DataFrame, start, n: int = 10, end=None) -> DataFrame:
    """First ``n`` events of the window by start time."""
    return normalize_events(raw, start, end).orderBy("start", "event_id").limit(n)
