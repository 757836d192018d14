"""Queries on stored bases: user-days, user sets, and their upkeep by date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators import activity as act
from loomlog.operators import preparation_tables as tables
from loomlog.operators import userdays as ud
from loomlog.operators import usersets as us
from loomlog.plans import activity as plain
from loomlog.plans import orders as order_plans
from loomlog.plans.oracle import with_ctes
from loomlog.sources import adapters
from loomlog.sources.adapters import events_target as ev
from loomlog.sources.adapters import orders_log as od
from loomlog.sources.tables import fresh_path, read_table, replace_partitions, stored_folder, write_table


def _last_dates(log: DataFrame, count: int) -> list[date]:
    """The last ``count`` calendar days of a log, latest first."""
    last = log.agg(F.max("event_date")).first()[0]
    return [last - timedelta(days=n) for n in range(count)] if last else []


def _fresh_table(spark: SparkSession, name: str) -> tuple[str, str]:
    path = fresh_path(spark, name)
    return f"loomlog_{path.rsplit('/', 1)[1].replace('-', '_')}", path


def late_days(span: str, log_of, count: int):
    """A store made before the last ``count`` days were complete, after these days were merged."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        log = log_of(spark, d)
        dates = _last_dates(log, count)
        early = log.where(~F.col("event_date").isin(dates) | (F.hash("user_pseudo_id") % 2 == 0))
        table, path = _fresh_table(spark, "late_days")
        ud.create_store(early, table, path, span)
        ud.merge_days(spark, table, log, dates, span)
        return spark.table(table)

    return run


def rerun_dates(spark: SparkSession, d: str) -> DataFrame:
    """The log after its last two dates came again: the last with its screen views only, the other empty."""
    log = ev(spark, d)
    path = fresh_path(spark, "rerun")
    write_table(log, path)
    dates = _last_dates(log, 2)
    again = read_table(spark, path, log.schema).where((F.col("event_date") == F.lit(dates[0])) & (F.col("event_name") == "screen_view"))
    replace_partitions(again, path, dates)
    return read_table(spark, path, log.schema).groupBy("event_date", "event_name").agg(F.count("*").alias("records"))


def orders_sets(spark: SparkSession, d: str) -> str:
    return stored_folder(spark, "sets_orders", d, lambda path: us.write_sets(od(spark, d), path, "year"))


def events_sets(spark: SparkSession, d: str) -> str:
    return stored_folder(spark, "sets_events", d, lambda path: us.write_sets(ev(spark, d), path))


def _days(s, d):
    return us.day_sets(s, orders_sets(s, d))


def _clock(s, d):
    return us.clock_sets(s, events_sets(s, d))


def _summary(grain, column):
    return lambda s, d: act.active_user_summary(us.active_users(_days(s, d), grain), column)


def updated_sets(spark: SparkSession, d: str) -> DataFrame:
    """Weekly users after the last ten days of the log, of which half was known before, came in."""
    log = od(spark, d)
    dates = _last_dates(log, 10)
    path = fresh_path(spark, "updated_sets")
    us.write_sets(log.where(~F.col("event_date").isin(dates) | (F.col("user_id") % 2 == 0)), path, "year")
    us.update_sets(spark, path, log, dates, "year")
    return us.active_users(us.day_sets(spark, path), "week")


def order_segments_stored(spark: SparkSession, d: str) -> DataFrame:
    """The per-user order table, written from a stored log and read back."""
    source, target = fresh_path(spark, "order_log"), fresh_path(spark, "order_segments")
    write_table(od(spark, d), source, None)
    tables.build_order_segments(spark, source, target, adapters.ORDERS_HOLIDAY)
    return read_table(spark, target)


QUERIES = {
    "user_day_store": lambda s, d: adapters.orders_days(s, d),
    "user_day_store_events": lambda s, d: adapters.events_days(s, d),
    "user_day_store_late_days": late_days("year", od, 20),
    "user_day_store_late_days_events": late_days("month", ev, 3),
    "rerun_dates": rerun_dates,
    "order_segments_stored": order_segments_stored,
    "sets_daily_users_orders": lambda s, d: us.active_users(_days(s, d), "day"),
    "sets_weekly_users_orders": lambda s, d: us.active_users(_days(s, d), "week"),
    "sets_monthly_users_orders": lambda s, d: us.active_users(_days(s, d), "month"),
    "sets_dau_summary_orders": _summary("day", "dau"),
    "sets_wau_summary_orders": _summary("week", "wau"),
    "sets_mau_summary_orders": _summary("month", "mau"),
    "sets_stickiness_month_orders": lambda s, d: us.stickiness(_days(s, d), "month"),
    "sets_stickiness_week_orders": lambda s, d: us.stickiness(_days(s, d), "week"),
    "sets_weekly_users_updated": updated_sets,
    "sets_hourly_users": lambda s, d: us.hourly_users(_clock(s, d)),
    "sets_dow_users": lambda s, d: us.dow_users(_clock(s, d)),
    "sets_dow_hour_users": lambda s, d: us.dow_hour_users(_clock(s, d)),
}


def _store_sql(log: str, unit: str) -> str:
    return with_ctes(
        f"""SELECT user_pseudo_id, event_date, len(names) AS events,
                   len(list_filter(names, lambda n: n = 'click_payment')) AS orders,
                   CAST(date_trunc('{unit}', event_date) AS DATE) AS span_start
            FROM (SELECT user_pseudo_id, event_date, list(event_name) AS names FROM {log} GROUP BY ALL)""",
        log,
    )


ORACLES = {
    "user_day_store": _store_sql("od", "year"),
    "user_day_store_events": _store_sql("ev", "month"),
    "user_day_store_late_days": _store_sql("od", "year"),
    "user_day_store_late_days_events": _store_sql("ev", "month"),
    "rerun_dates": with_ctes(
        """SELECT event_date, event_name, count(*) AS records FROM ev CROSS JOIN (SELECT max(event_date) AS last FROM ev)
           WHERE event_date < last - 1 OR (event_date = last AND event_name = 'screen_view') GROUP BY 1, 2""",
        "ev",
    ),
    "order_segments_stored": order_plans.ORACLES["order_segments_orders"],
    "sets_daily_users_orders": with_ctes(plain.active_sql("event_date", "day", "dau", "od"), "od"),
    "sets_weekly_users_orders": with_ctes(plain.active_sql("event_week", "week", "wau", "od"), "od"),
    "sets_monthly_users_orders": with_ctes(plain.active_sql("event_month", "month", "mau", "od"), "od"),
    "sets_dau_summary_orders": plain.summary_sql("event_date", "day", "dau", "od"),
    "sets_wau_summary_orders": plain.summary_sql("event_week", "week", "wau", "od"),
    "sets_mau_summary_orders": plain.summary_sql("event_month", "month", "mau", "od"),
    "sets_stickiness_month_orders": plain.sticky_sql("event_month", "month", "mau", "od"),
    "sets_stickiness_week_orders": plain.sticky_sql("event_week", "week", "wau", "od"),
    "sets_weekly_users_updated": with_ctes(plain.active_sql("event_week", "week", "wau", "od"), "od"),
    "sets_hourly_users": plain.ORACLES["hourly_users"],
    "sets_dow_users": plain.ORACLES["dow_users"],
    "sets_dow_hour_users": plain.ORACLES["dow_hour_users"],
}
