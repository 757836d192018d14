"""Exact distinct users of any period from stored bitmaps, after one pass over the log.

A set of users is a handful of bitmaps of 32,768 users each, and sets merge by
bitwise or. Two tables hold them, in partitions by calendar span: one with sets per
date, from which weeks, months and stickiness follow, and one with sets per span,
weekday and hour, from which all times of day follow. Late or repeated dates
replace their span only. Users are numbered once and keep their number, so sets
written at different times agree.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, DOW_LABELS, USER, broadcast_days, iso_dow, percent, period, period_name
from loomlog.operators.userdays import SPAN, span_of, span_starts
from loomlog.sources.tables import cut_lineage, read_table, replace_partitions, write_table

NUMBER, BUCKET, USERS, ROWS = "user_no", "bucket", "users", "records"
_ACTIVE = {"day": "dau", "week": "wau", "month": "mau"}


def number_users(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user, user_no) for all users of the log and of ``known``, from 1 without gaps; known numbers stay.

    Each partition numbers its own users; the sums of the earlier partitions, one
    row for each, are added. Rows without a user get no number.
    """
    fresh = log.select(USER).where(F.col(USER).isNotNull()).distinct()
    start = 0
    if known is not None:
        fresh = fresh.join(known, USER, "left_anti")
        start = known.agg(F.max(NUMBER)).first()[0] or 0
    rows = cut_lineage(fresh.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        USER, (F.col("_offset") + place + 1 + start).alias(NUMBER))
    return numbered if known is None else known.select(USER, NUMBER).unionByName(numbered)


def _seen(log: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per user, date and hour with the number of the log's rows, written once."""
    hours = log.groupBy(USER, DAY, F.hour("event_datetime").alias("event_hour")).agg(F.count("*").alias(ROWS))
    return cut_lineage(hours.join(numbers, USER, "left").drop(USER))


def _sets(seen: DataFrame, *keys) -> DataFrame:
    return seen.groupBy(*keys, F.bitmap_bucket_number(NUMBER).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias(USERS), F.sum(ROWS).alias(ROWS))


def _day_sets(seen: DataFrame, span: str) -> DataFrame:
    return _sets(seen, span_of(span), DAY)


def _clock_sets(seen: DataFrame, span: str) -> DataFrame:
    return _sets(seen, span_of(span), iso_dow(F.col(DAY)).alias("event_dow"), "event_hour")


def write_sets(log: DataFrame, folder: str, span: str = "month") -> None:
    """Number the users of a log and write their sets: ``folder/users``, ``folder/days``, ``folder/clock``.

    Rows without a user count as records and belong to no set. ``span`` is the month
    or year that a partition covers.
    """
    write_table(number_users(log), f"{folder}/users", None)
    seen = _seen(log, read_table(log.sparkSession, f"{folder}/users"))
    write_table(_day_sets(seen, span), f"{folder}/days", SPAN)
    write_table(_clock_sets(seen, span), f"{folder}/clock", SPAN)


def update_sets(spark: SparkSession, folder: str, log: DataFrame, dates: list[date], span: str = "month") -> None:
    """Make the sets of the spans that ``dates`` fall into anew from the log.

    The log is read for these spans only. The sets of other spans keep their
    files, known users their numbers, and the call can be repeated.
    """
    spans = span_starts(dates, span)
    touched = log.where(span_of(span).isin(spans))
    numbers = cut_lineage(number_users(touched, read_table(spark, f"{folder}/users")))
    write_table(numbers, f"{folder}/users", None)
    seen = _seen(touched, numbers)
    replace_partitions(_day_sets(seen, span), f"{folder}/days", spans, SPAN)
    replace_partitions(_clock_sets(seen, span), f"{folder}/clock", spans, SPAN)


def day_sets(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/days")


def clock_sets(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/clock")


def distinct_users(sets: DataFrame, *keys, name: str = "user_cnt") -> DataFrame:
    """Different users per key: sets of a bucket merge, then buckets add up. ``records`` adds up, too."""
    merged = sets.groupBy(*keys, BUCKET).agg(F.bitmap_count(F.bitmap_or_agg(USERS)).alias("_n"), F.sum(ROWS).alias(ROWS))
    names = [c for c in merged.columns if c not in (BUCKET, "_n", ROWS)]
    return merged.groupBy(*names).agg(F.sum("_n").alias(name), F.sum(ROWS).alias(ROWS))


def active_users(days: DataFrame, grain: str = "day") -> DataFrame:
    """Distinct users per day, Monday week or month, from the sets by date."""
    return distinct_users(days, period(grain), name=_ACTIVE[grain]).where(F.col(_ACTIVE[grain]) > 0).drop(ROWS)


def stickiness(days: DataFrame, grain: str = "month") -> DataFrame:
    """Daily users as a percentage of the week's or month's users, from the sets by date."""
    key, wide = period_name(grain), _ACTIVE[grain]
    daily = active_users(days, "day").withColumn(key, period(grain))
    sums = daily.groupBy(key).agg(F.sum("dau").alias("sum_of_dau"))
    span = active_users(days, grain).join(broadcast_days(sums), key)
    return daily.join(broadcast_days(span), key).select(
        DAY, "dau", wide, percent(F.col("dau"), F.col(wide), 4).alias("stickiness"), "sum_of_dau")


def hourly_users(clock: DataFrame) -> DataFrame:
    return distinct_users(clock, "event_hour").drop(ROWS)


def _dow_label(dow):
    return F.element_at(F.array(*[F.lit(x) for x in DOW_LABELS]), dow)


def dow_users(clock: DataFrame) -> DataFrame:
    """Distinct users per ISO weekday, with its label."""
    return distinct_users(clock, "event_dow").select(_dow_label(F.col("event_dow")).alias("event_dow_str"), "event_dow", "user_cnt")


def dow_hour_users(clock: DataFrame) -> DataFrame:
    """Distinct users per weekday and hour, with the rank of the cell over raw rows (see the log's operator)."""
    earlier = Window.orderBy("event_dow", "event_hour").rowsBetween(Window.unboundedPreceding, -1)  # 168 rows
    hour = F.lpad(F.col("event_hour").cast("string"), 2, "0")
    return distinct_users(clock, "event_dow", "event_hour").select(
        F.concat(_dow_label(F.col("event_dow")), F.lit(" "), hour, F.lit("h")).alias("event_dow_hour"),
        (F.coalesce(F.sum(ROWS).over(earlier), F.lit(0)) + 1).alias("order_num"), "user_cnt")
