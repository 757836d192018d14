"""Active users, visit gaps, time-of-day, session and dwell measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.columns import (
    DAY,
    DOW_LABELS,
    USER,
    broadcast_days,
    percent,
    period,
    period_name,
    week_start,
    whole_seconds,
)
from loomlog.operators.userdays import user_days


# ------------------------------------------------------------- active users

# Names of the result columns.
_ACTIVE = {"day": "dau", "week": "wau", "month": "mau"}


def active_users(log: DataFrame, grain: str = "day") -> DataFrame:
    """Distinct users per day, Monday week or month."""
    return log.groupBy(period(grain)).agg(F.count_distinct(USER).alias(_ACTIVE[grain]))


def active_user_summary(active: DataFrame, column: str) -> DataFrame:
    """Mean (3 digits) and exact median over the periods."""
    return active.agg(
        F.round(F.avg(column), 3).alias(f"avg_{column}"),
        F.percentile(column, F.lit(0.5)).alias(f"median_{column}"),
    )


def stickiness(log: DataFrame, grain: str = "month") -> DataFrame:
    """Daily users as a percentage of the week's or month's users.

    Both counts start from the same user-day base, whose shuffle the plan
    reuses, so the log is read once; the join is between calendar-sized
    tables. The visit days of all users of a period add up to the sum of its
    daily users.
    """
    days = user_days(log)
    key, wide = period_name(grain), _ACTIVE[grain]
    dau = days.groupBy(DAY).agg(F.count("*").alias("dau"))
    per_user = days.groupBy(period(grain), USER).agg(F.count("*").alias("visit_days"))
    span = per_user.groupBy(key).agg(F.count("*").alias(wide), F.sum("visit_days").alias("sum_of_dau"))
    return dau.withColumn(key, period(grain)).join(broadcast_days(span), key).select(
        DAY, "dau", wide, percent(F.col("dau"), F.col(wide), 4).alias("stickiness"), "sum_of_dau"
    )


# --------------------------------------------------------------- visit gaps

def visit_sequence(log: DataFrame, first: bool = False) -> DataFrame:
    """Each visit day of a user with the visit day before it."""
    by_day = Window.partitionBy(USER).orderBy(DAY)
    seq = user_days(log).withColumn("prev_event_date", F.lag(DAY).over(by_day))
    if first:
        seq = seq.withColumn("first_event_date", F.first_value(DAY).over(by_day))
    return seq


def visit_intervals(log: DataFrame) -> DataFrame:
    """Gaps in days between consecutive visit days; always positive."""
    return (
        visit_sequence(log)
        .where(F.col("prev_event_date").isNotNull())
        .withColumn("day_diff", F.datediff(DAY, "prev_event_date"))
    )


def _gap_counts(intervals: DataFrame) -> DataFrame:
    """Gap histogram; the number of different gaps is limited by the calendar."""
    return intervals.groupBy("day_diff").agg(F.count("*").alias("n"))


def interval_fences(intervals: DataFrame) -> DataFrame:
    """Quartiles cut to whole days, and Tukey fences built from them.

    A negative lower fence becomes the smallest gap that is not an outlier;
    both fences are cut to whole days at the end.
    """
    counts = _gap_counts(intervals)
    quartiles = counts.agg(
        F.percentile("day_diff", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"),
        F.min("day_diff").alias("smallest"),
    ).select(
        *[F.col("q")[i].cast("int").alias(f"q{i + 1}") for i in range(3)], "smallest"
    )
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    # With a negative lower fence no gap is too small, so the smallest gap
    # overall is the smallest one inside the fences.
    return quartiles.select(
        "q1", "q2", "q3",
        F.when(low < 0, F.col("smallest")).otherwise(low).cast("int").alias("lower_fence"),
        high.cast("int").alias("upper_fence"),
    )


def interval_histogram(intervals: DataFrame, value: str = "day_diff", bins: int = 50) -> DataFrame:
    """Counts in equally wide bins from minimum to maximum, empty bins included.

    Bins are closed on the left, the last one on both sides. Whole numbers are
    binned with integer arithmetic, so edges are exact; others as doubles.
    """
    whole = isinstance(intervals.schema[value].dataType, T.IntegralType)
    kind = "bigint" if whole else "double"
    counts = intervals.where(F.col(value).isNotNull()).groupBy(F.col(value).cast(kind).alias("x")).agg(
        F.count("*").alias("n"))
    span = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    placed = counts.crossJoin(F.broadcast(span))
    place = f"(x - lo) * {bins} div (hi - lo)" if whole else f"floor((x - lo) / (hi - lo) * {bins})"
    bin_no = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
        F.least(F.expr(place), F.lit(bins - 1))
    )
    filled = placed.groupBy(bin_no.cast("int").alias("bin"), "lo", "hi").agg(F.sum("n").alias("cnt"))
    # one row: the count of every bin, zero where the map has no entry
    table = filled.groupBy("lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("m")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    start = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5 + F.col("bin") / F.lit(float(bins))).otherwise(
        F.col("lo") + width * F.col("bin")
    )
    end = F.when(
        F.col("hi") == F.col("lo"), F.col("lo") - 0.5 + (F.col("bin") + 1) / F.lit(float(bins))
    ).otherwise(F.col("lo") + width * (F.col("bin") + 1))
    return table.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin",
        start.cast("double").alias("bin_start"),
        end.cast("double").alias("bin_end"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("cnt"),
    )


# ------------------------------------------------------------- time of day

def hourly_users(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("event_datetime").alias("event_hour")).agg(F.count_distinct(USER).alias("user_cnt"))


def _dow_label(dow):
    return F.element_at(F.array(*[F.lit(x) for x in DOW_LABELS]), dow)


def dow_users(log: DataFrame) -> DataFrame:
    """Distinct users per ISO weekday, with its label."""
    return (
        log.groupBy("event_dow")
        .agg(F.count_distinct(USER).alias("user_cnt"))
        .select(_dow_label(F.col("event_dow")).alias("event_dow_str"), "event_dow", "user_cnt")
    )


def dow_hour_users(log: DataFrame) -> DataFrame:
    """Distinct users per weekday and hour.

    ``order_num`` is the rank of the cell over raw rows: one plus the number of
    rows in earlier cells. At most 168 cells exist when the window runs.
    """
    cells = log.groupBy("event_dow", F.hour("event_datetime").alias("event_hour")).agg(
        F.count_distinct(USER).alias("user_cnt"), F.count("*").alias("n")
    )
    earlier = Window.orderBy("event_dow", "event_hour").rowsBetween(Window.unboundedPreceding, -1)
    hour = F.lpad(F.col("event_hour").cast("string"), 2, "0")
    return cells.select(
        F.concat(_dow_label(F.col("event_dow")), F.lit(" "), hour, F.lit("h")).alias("event_dow_hour"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1).alias("order_num"),
        "user_cnt",
    )


# ------------------------------------------------------ sessions and dwell

def sessions_per_user(log: DataFrame) -> DataFrame:
    """Mean number of sessions per user, by day."""
    per_user = log.groupBy(DAY, USER).agg(F.count_distinct("session_id").alias("n"))
    return per_user.groupBy(DAY).agg(F.round(F.avg("n"), 2).alias("avg_sessions_per_user"))


def screen_views_per_session(log: DataFrame) -> DataFrame:
    """Mean screen views and different screens per session, by day."""
    per_session = (
        log.where(F.col("event_name") == "screen_view")
        .groupBy(DAY, USER, "session_id")
        .agg(F.count("*").alias("views"), F.count_distinct("firebase_screen").alias("screens"))
    )
    return per_session.groupBy(DAY).agg(
        F.round(F.avg("views"), 2).alias("avg_screen_view_per_sess"),
        F.round(F.avg("screens"), 2).alias("avg_unique_view_per_sess"),
    )


def dwell_per_screen(log: DataFrame) -> DataFrame:
    """Mean seconds between first and last event of a screen in a session, by day."""
    second = whole_seconds(F.col("event_datetime"))
    per_screen = log.groupBy(DAY, USER, "session_id", "firebase_screen").agg(
        (F.max(second) - F.min(second)).alias("seconds")
    )
    return per_screen.groupBy(DAY).agg(F.round(F.avg("seconds"), 2).alias("avg_duration_time_per_screen"))


# ------------------------------------------------- retention, whole base

def range_retention(log: DataFrame) -> DataFrame:
    """Users by weeks since their first Monday week, against week 0."""
    weeks = log.select(USER, week_start(F.col(DAY)).alias("w")).distinct()
    gap = (F.datediff("w", F.min("w").over(Window.partitionBy(USER))) / 7).cast("bigint")
    counts = weeks.select(gap.alias("week_diff")).groupBy("week_diff").agg(F.count("*").alias("retain_user"))
    every = Window.partitionBy()  # over one row per week difference
    base = F.max(F.when(F.col("week_diff") == 0, F.col("retain_user"))).over(every)
    return counts.withColumn("first_week_retain_user", base).withColumn(
        "retention_ratio", percent(F.col("retain_user"), F.col("first_week_retain_user"))
    )
