"""Calendar windows, timestamp parsing and expiry."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, functions as F


def as_datetime(as_of) -> datetime:
    if isinstance(as_of, datetime):
        return as_of
    if isinstance(as_of, date):
        return datetime.combine(as_of, time())
    return datetime.fromisoformat(as_of)


def week_bounds(as_of, offset: int = 0) -> tuple[datetime, datetime]:
    """Half-open Monday..Monday calendar week, ``offset`` weeks before ``as_of``.

    The bounds are plain values, so the filter built from them reaches the scan.
    """
    day = as_datetime(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    start = day - timedelta(days=day.weekday(), weeks=offset)
    return start, start + timedelta(days=7)


def month_bounds(as_of, offset: int = 0) -> tuple[datetime, datetime]:
    """Half-open calendar month, ``offset`` months before ``as_of``."""
    day = as_datetime(as_of)
    months = day.year * 12 + day.month - 1 - offset
    start = datetime(months // 12, months % 12 + 1, 1)
    months += 1
    return start, datetime(months // 12, months % 12 + 1, 1)


def _ts(value: datetime) -> Column:
    # a zone-less literal compares with either timestamp type without casting the column
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_bounds(ts: Column, bounds: tuple[datetime, datetime]) -> Column:
    return (ts >= _ts(bounds[0])) & (ts < _ts(bounds[1]))


def in_week(ts: Column, as_of, offset: int = 0, exact_bounds: bool = False) -> Column:
    """Rows of the target week.

    ``exact_bounds`` keeps the time of day of ``as_of`` on both ends (Monday at
    that time up to and including Sunday at that time), which loses early
    Monday and late Sunday rows; the default is the whole calendar week.
    """
    start, end = week_bounds(as_of, offset)
    if not exact_bounds:
        return in_bounds(ts, (start, end))
    day = as_datetime(as_of)
    clock = timedelta(hours=day.hour, minutes=day.minute, seconds=day.second,
                      microseconds=day.microsecond)
    return ts.between(_ts(start + clock), _ts(start + clock + timedelta(days=6)))


def in_month(ts: Column, as_of, offset: int = 0) -> Column:
    return in_bounds(ts, month_bounds(as_of, offset))


def week_label(offset: int) -> str:
    return {0: "This Week", 1: "Last Week"}.get(offset, f"{offset} Weeks Ago")


def day_in_week(ts: Column, as_of, offset: int = 0) -> Column:
    """0 for Monday of the target week .. 6 for Sunday."""
    start, _ = week_bounds(as_of, offset)
    return F.datediff(ts, F.lit(start.date()))


def week_start(ts: Column) -> Column:
    """Monday of the row's week; a Sunday belongs to the Monday before it."""
    return F.date_trunc("week", ts).cast("date")


def between_dates(ts: Column, first, last) -> Column:
    """Inclusive range of calendar days, written as a range on ``ts`` itself."""
    lo = as_datetime(first).replace(hour=0, minute=0, second=0, microsecond=0)
    hi = as_datetime(last).replace(hour=0, minute=0, second=0, microsecond=0)
    return in_bounds(ts, (lo, hi + timedelta(days=1)))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text, with ``T`` or blank, offset or ``Z``, as zone-less UTC time.

    Text without a zone is UTC, whatever zone the session has; null when
    unparsable.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zoned = F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(text)), epoch)
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), zoned).otherwise(text.try_cast("timestamp_ntz"))


def show_ts(text: Column) -> Column:
    """Display form of ISO text; text that does not parse is shown as it is."""
    return F.coalesce(F.date_format(parse_iso(text), "yyyy-MM-dd HH:mm:ss"), text)


def is_expired(ts_text: Column, ttl_seconds: int, as_of) -> Column:
    """Older than the time to live, or without a readable start."""
    limit = as_datetime(as_of) - timedelta(seconds=ttl_seconds)
    return F.coalesce(parse_iso(ts_text) < _ts(limit), F.lit(True))


def split_expired(rows, ts_text: Column, ttl_seconds: int, as_of) -> tuple:
    """Live rows and expired rows."""
    gone = is_expired(ts_text, ttl_seconds, as_of)
    return rows.where(~gone), rows.where(gone)


def is_past(ts: Column, as_of) -> Column:
    """An explicit expiry moment that has gone by."""
    return F.coalesce(ts < _ts(as_datetime(as_of)), F.lit(True))
