"""Column expressions shared by the operators.

Everything works on ``timestamp_ntz`` and ``date`` values, so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER = "user_pseudo_id"
DAY = "event_date"
GRAINS = ("day", "week", "month")
DOW_LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def local_datetime(micros: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` for microseconds since the epoch.

    The shifted instant is read back as a number, so the session zone plays no
    part; this is several times faster than ``convert_timezone``.
    """
    shifted = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), tz))
    return F.timestamp_add("MICROSECOND", shifted, _ntz("1970-01-01 00:00:00"))


def whole_seconds(ts: Column) -> Column:
    """Second number on a fixed axis; subtracting two counts second boundaries.

    Built from the fields of the wall-clock value, because ``timestamp_diff``
    would go through the session time zone.
    """
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(utc: Column) -> Column:
    """Microseconds since the epoch of a UTC wall-clock value."""
    fraction_of_minute = (F.date_part(F.lit("SECOND"), utc) * 1_000_000).cast("bigint")
    return (whole_seconds(utc) - F.second(utc)) * 1_000_000 + fraction_of_minute


def clock_time(ts: Column) -> Column:
    """``HH:mm:ss.SSSSSS`` as text (Spark has no usable TIME column yet)."""
    text = F.substring(ts.cast("string"), 12, 15)
    padded = F.rpad(F.concat(text, F.when(F.length(text) == 8, ".").otherwise("")), 15, "0")
    return padded


def week_start(day: Column) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(day, "WEEK")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def iso_dow(day: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + 1


def sunday_week(day: Column) -> Column:
    """Running number of the Sunday-started week.

    Week *differences* count Sunday boundaries while week *labels* are Mondays;
    1970-01-01 was a Thursday, hence the offset of 4.
    """
    return F.floor((F.unix_date(day) + 4) / 7)


def period(grain: str, day: str = DAY) -> Column:
    """Named period column: event_date, event_week or event_month."""
    if grain == "day":
        return F.col(day).alias("event_date")
    if grain == "week":
        return week_start(F.col(day)).alias("event_week")
    if grain == "month":
        return month_start(F.col(day)).alias("event_month")
    raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def period_name(grain: str) -> str:
    return {"day": "event_date", "week": "event_week", "month": "event_month"}[grain]


def broadcast_days(days: DataFrame) -> DataFrame:
    """Broadcast a table with one row per date, week or month.

    The hint is safe at any scale of the log: the key is a DATE column without
    duplicates, so the table cannot have more rows than the calendar has days
    (36,525 per century, 3.65 million for all dates there are).
    """
    return F.broadcast(days)


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """Rounded percentage, NULL when the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def fraction(part: Column, whole: Column, digits: int | None = None) -> Column:
    """Ratio, NULL when the whole is 0; unrounded unless ``digits`` is given."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return ratio if digits is None else F.round(ratio, digits)
