"""The user-day store: what each user did on each day, bucketed by user, and its upkeep.

A store is a catalog table with one row per user and date: ``events`` and
``orders`` count the log's rows and its payments. It is partitioned by calendar
span and bucketed by user, so operators that group, order or join by user read
it without an exchange. Every operator that starts from a log's visit days
takes a store's table as well. New and repeated days go in by :func:`merge_days`,
which rewrites the spans they fall into and nothing else.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, USER
from loomlog.sources.tables import create_bucketed, replace_partitions, shared_dir

ORDER_EVENT = "click_payment"
SPAN = "span_start"
_UNITS = {"month": "MM", "year": "YEAR"}


def is_order() -> Column:
    return F.col("event_name") == ORDER_EVENT


def is_store(log: DataFrame) -> bool:
    """Whether the rows are user-days of a store and not events."""
    return {"events", "orders"} <= set(log.columns)


def user_days(log: DataFrame) -> DataFrame:
    """Distinct (user, date).

    The common base of everything about visits. Duplicates of a log collapse before
    the shuffle, and afterwards one user has at most one row per calendar day, so
    work grouped by user stays small even for a user with very many events. A
    store holds these rows as they are.
    """
    days = log.select(USER, DAY)
    return days if is_store(log) else days.distinct()


def ordered(log: DataFrame) -> Column:
    """Whether a row of a log or store means a payment."""
    return F.col("orders") > 0 if is_store(log) else is_order()


def ordered_days(log: DataFrame) -> DataFrame:
    """Distinct (user, date) with ``ordered``: a payment on that day."""
    if is_store(log):
        return log.select(USER, DAY, ordered(log).alias("ordered"))
    return log.groupBy(USER, DAY).agg(F.bool_or(is_order()).alias("ordered"))


def span_of(span: str) -> Column:
    """First day of the month or year."""
    return F.trunc(DAY, _UNITS[span]).alias(SPAN)


def span_starts(dates: list[date], span: str) -> list[date]:
    """The spans that dates fall into."""
    return sorted({d.replace(day=1) if span == "month" else d.replace(month=1, day=1) for d in dates})


def store_rows(log: DataFrame, span: str = "month") -> DataFrame:
    """Rows of a store: user, date, events, orders, and the month or year as ``span_start``."""
    rows = log.groupBy(USER, DAY).agg(F.count("*").alias("events"), F.count_if(is_order()).alias("orders"))
    return rows.select(USER, DAY, "events", "orders", span_of(span))


def create_store(log: DataFrame, table: str, path: str | None = None, span: str = "month", buckets: int | None = None) -> None:
    """Write the store of ``log`` as the catalog table ``table``.

    ``buckets`` (the session's shuffle partitions unless given) stays as it is for
    the life of the table: choose it so that a bucket of the whole history fits
    a task. A span should be long enough that its files are not small: with
    few users a year, with many a month.
    """
    spark = log.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    create_bucketed(store_rows(log, span), table, path or f"{shared_dir(spark)}/{table}", USER, [USER, DAY], buckets, SPAN)


def merge_days(spark: SparkSession, table: str, log: DataFrame, dates: list[date], span: str = "month") -> None:
    """Bring the days ``dates`` of a store up to date with ``log``.

    The rows of these dates are counted anew from the log and replace what the store
    has for them; a date without rows in the log ends up without rows. Other dates of
    the same spans are carried over, other spans keep their files. The call can
    be repeated; rows of the log on other dates are not looked at.
    """
    spans = span_starts(dates, span)
    fresh = store_rows(log.where(F.col(DAY).isin(list(dates))), span)
    carried = spark.table(table).where(F.col(SPAN).isin(spans) & ~F.col(DAY).isin(list(dates)))
    replace_partitions(carried.unionByName(fresh), table, spans, SPAN)
