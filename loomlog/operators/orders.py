"""Order counts, order rates, holidays and the per-user order table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, USER, broadcast_days, percent, period, period_name, week_start
from loomlog.operators.userdays import is_order, ordered, ordered_days

_VISITORS = {"day": "dau", "week": "wau", "month": "mau"}


def orders_daily(log: DataFrame) -> DataFrame:
    """Orders and ordering users per day."""
    return (
        log.where(is_order())
        .groupBy(DAY)
        .agg(F.count("*").alias("order_cnt"), F.count_distinct("user_id").alias("order_users_cnt"))
    )


def repeat_order_days(orders: DataFrame) -> DataFrame:
    """Days on which somebody ordered more than once."""
    return orders.where(F.col("order_cnt") != F.col("order_users_cnt"))


def order_users(log: DataFrame, grain: str = "month") -> DataFrame:
    """Ordering users per period."""
    return log.where(is_order()).groupBy(period(grain)).agg(F.count_distinct("user_id").alias("order_users_cnt"))


def order_rate(log: DataFrame, grain: str = "day", buyer: str = "user_id") -> DataFrame:
    """Ordering users as a percentage of the period's users.

    Periods without an order row are left out. A period whose buyers all lack
    a ``user_id`` stays, with 0 ordering users.

    With the same id on both sides one pass over (period, user) rows is
    enough, and a store serves as well as a log. With two ids the log is read
    twice, the second time only its orders (the filter reaches the files), which
    avoids expanding every row per distinct count; only calendar-sized tables
    meet in the join.
    """
    key, visitors = period_name(grain), _VISITORS[grain]
    if buyer == USER:
        per_user = log.groupBy(period(grain), USER).agg(F.bool_or(ordered(log)).alias("ordered"))
        counted = (
            per_user.groupBy(key)
            .agg(F.count("*").alias(visitors), F.count_if("ordered").alias("order_users_cnt"))
            .where("order_users_cnt > 0")
        )
    else:
        present = log.groupBy(period(grain)).agg(F.count_distinct(USER).alias(visitors))
        buyers = log.where(is_order()).groupBy(period(grain)).agg(F.count_distinct(buyer).alias("order_users_cnt"))
        counted = present.join(broadcast_days(buyers), key)
    return counted.select(
        key, visitors, "order_users_cnt", percent(F.col("order_users_cnt"), F.col(visitors)).alias("order_ratio")
    )


def segment_order_rate(log: DataFrame, seg: DataFrame, grain: str = "week") -> DataFrame:
    """Order rate per segment and period, buyers counted by device.

    The log shrinks to one row per user and period before it meets the segment
    map, so a user with very many events is a handful of rows in the join.
    """
    key, visitors = period_name(grain), _VISITORS[grain]
    per_user = log.groupBy(USER, period(grain)).agg(F.bool_or(ordered(log)).alias("ordered"))
    return (
        per_user.join(seg, USER)
        .groupBy("user_segment", key)
        .agg(F.count("*").alias(visitors), F.count_if("ordered").alias("order_users_cnt"))
        .where("order_users_cnt > 0")
        .select(
            "user_segment", key,
            percent(F.col("order_users_cnt"), F.col(visitors)).alias("order_ratio"),
        )
    )


def high_rate(rate: DataFrame, threshold: float = 12) -> DataFrame:
    return rate.where(F.col("order_ratio") > threshold)


def holidays(log: DataFrame, threshold: float = 30, buyer: str = "user_id") -> DataFrame:
    """Days whose rounded order rate is above the threshold, with their week."""
    return (
        order_rate(log, "day", buyer)
        .where(F.col("order_ratio") > threshold)
        .select(F.col(DAY).alias("holiday_date"), week_start(F.col(DAY)).alias("holiday_week"))
    )


def order_segments(log: DataFrame, hol: DataFrame) -> DataFrame:
    """Visit days, order days, and order days outside and inside holidays."""
    days = ordered_days(log)
    flag = hol.select(F.col("holiday_date").alias(DAY), F.lit(True).alias("holiday")).distinct()
    marked = days.join(broadcast_days(flag), DAY, "left")
    per_user = marked.groupBy(USER).agg(
        F.count("*").alias("visit_day_cnt"),
        F.count_if("ordered").alias("order_day_cnt"),
        F.count_if(F.col("ordered") & F.col("holiday").isNull()).alias("order_normal_cnt"),
        F.count_if(F.col("ordered") & F.col("holiday").isNotNull()).alias("order_holiday_cnt"),
    )
    return per_user.select(
        F.when(F.col("order_day_cnt") > 0, "ordered").otherwise("non_ordered").alias("user_segment"),
        USER, "visit_day_cnt", "order_day_cnt", "order_normal_cnt", "order_holiday_cnt",
    )
