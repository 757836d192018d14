"""Weekly retention, cohorts, and their link to order rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, USER, percent, sunday_week, week_start
from loomlog.operators.userdays import user_days
from loomlog.sources.tables import cut_lineage


def week_diffs(log: DataFrame) -> DataFrame:
    """Visit days with the user's first date and the weeks (Sunday boundaries) since."""
    first = F.min(DAY).over(Window.partitionBy(USER))
    return (
        user_days(log)
        .withColumn("first_date", first)
        .withColumn("week_diff", sunday_week(F.col(DAY)) - sunday_week(F.col("first_date")))
        .select(USER, "first_date", DAY, "week_diff")
    )


def user_weeks(log: DataFrame) -> DataFrame:
    """One row per user and week since the first date, with the cohort week.

    The log shrinks to user-weeks in the first shuffle; later counts by week
    need no distinct because every user appears once per week.
    """
    weeks = log.groupBy(USER, sunday_week(F.col(DAY)).alias("week_no")).agg(F.min(DAY).alias("d"))
    first = F.min("d").over(Window.partitionBy(USER))
    return weeks.withColumn("first_date", first).select(
        USER,
        week_start(F.col("first_date")).alias("cohort_week"),
        (F.col("week_no") - sunday_week(F.col("first_date"))).alias("week_diff"),
    )


def weekly_retention(log: DataFrame, seg: DataFrame) -> DataFrame:
    """Users of a segment by weeks since the first visit, against week 0."""
    counts = (
        user_weeks(log)
        .join(seg, USER)
        .groupBy("user_segment", "week_diff")
        .agg(F.count("*").alias("retain_users"))
    )
    start = F.max(F.when(F.col("week_diff") == 0, F.col("retain_users"))).over(Window.partitionBy("user_segment"))
    return counts.withColumn("first_users", start).select(
        "user_segment", "week_diff", "retain_users", "first_users",
        percent(F.col("retain_users"), F.col("first_users")).alias("retention_rate"),
    )


def cohort_retention(log: DataFrame, seg: DataFrame | None = None) -> DataFrame:
    """Retention by cohort (Monday week of the first date), optionally by segment."""
    weeks = user_weeks(log)
    keys = ["cohort_week"]
    if seg is not None:
        weeks = weeks.join(seg, USER)
        keys = ["user_segment", "cohort_week"]
    counts = weeks.groupBy(*keys, "week_diff").agg(F.count("*").alias("retain_users"))
    start = F.first_value("retain_users").over(Window.partitionBy(*keys).orderBy("week_diff"))
    return counts.withColumn("first_week_users", start).select(
        *keys, "week_diff", "retain_users", "first_week_users",
        percent(F.col("retain_users"), F.col("first_week_users")).alias("cohort_retention_rate"),
    )


def _cohort_keys(cohorts: DataFrame) -> list[str]:
    return [c for c in ("user_segment", "cohort_week") if c in cohorts.columns]


def cohort_cells(cohorts: DataFrame, value: str, drop_week0: bool = False) -> DataFrame:
    """A cohort matrix in one pass: per cohort (and segment, if there is one) the map ``cells``
    from week difference to mean value.

    Nothing runs while this is planned: the columns of the matrix are the keys of
    the maps. A map has as many entries as the log has weeks.
    """
    keys = _cohort_keys(cohorts)
    means = cohorts.groupBy(*keys, "week_diff").agg(F.avg(F.col(value).cast("double")).alias("v"))
    kept = F.lit(True) if not drop_week0 else F.col("week_diff") != 0
    entry = F.when(kept & F.col("v").isNotNull(), F.struct("week_diff", "v"))
    week = F.when(kept, F.col("week_diff"))
    return means.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("cells"), F.collect_list(week).alias("weeks"))


def cell_rows(cells: DataFrame) -> DataFrame:
    """Long form of :func:`cohort_cells`: a row for every cohort and every week of any cohort, absent cells included.

    The weeks of all cohorts meet in one window over a row per cohort, which the
    calendar and the number of segments bound.
    """
    keys = _cohort_keys(cells)
    every = F.array_distinct(F.flatten(F.collect_list("weeks").over(Window.partitionBy())))
    rows = cells.select(*keys, "cells", every.alias("every")).select(*keys, "cells", F.explode("every").alias("week_diff"))
    return rows.select(
        *keys, "week_diff", F.try_element_at("cells", F.col("week_diff")).alias("value"))


def cohort_matrix(
    cohorts: DataFrame, value: str, drop_week0: bool = False, weeks: Sequence[int] | None = None
) -> DataFrame:
    """One row per cohort (and segment, if there is one), one column per week
    difference, NULL where a cell is absent.

    Without ``weeks`` the week differences in the data become the columns. A table
    cannot be planned without its columns, so the maps of :func:`cohort_cells` are
    then written, once, and their keys looked up; given weeks need no job.
    """
    cells = cohort_cells(cohorts, value, drop_week0)
    if weeks is None:
        cells = cut_lineage(cells)
        weeks = sorted(r[0] for r in cells.select(F.explode("weeks")).distinct().collect())
    return cells.select(*_cohort_keys(cohorts), *[F.try_element_at("cells", F.lit(w).cast("bigint")).alias(str(w)) for w in weeks])


def matrix_cells(matrix: DataFrame) -> DataFrame:
    """Long form of a cohort matrix: a row for every cell, absent ones included."""
    keys = _cohort_keys(matrix)
    weeks = [c for c in matrix.columns if c not in keys]
    cells = matrix.unpivot(keys, weeks, "week_diff", "value")
    return cells.withColumn("week_diff", F.col("week_diff").cast("bigint"))


def cohort_center(cohorts: DataFrame, value: str, how: str = "median") -> DataFrame:
    """Median or mean over the weeks of each cohort (and segment, if there is one)."""
    keys = _cohort_keys(cohorts)
    center = {"median": F.median, "mean": F.avg}[how]
    return cohorts.groupBy(*keys).agg(center(F.col(value).cast("double")).alias(value))


def align_groups(center: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """One row per cohort with a column per group, 0 where a group has no value."""
    wide = center.groupBy("cohort_week").pivot("user_segment", list(groups)).agg(F.first(value))
    return wide.fillna(0.0, subset=list(groups))


def stack_groups(aligned: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Long form of an aligned table, as the group tests take it."""
    return aligned.unpivot(["cohort_week"], list(groups), "user_segment", value)


def join_rates(center: DataFrame, rate: DataFrame, key: str = "cohort_week") -> DataFrame:
    """Retention of a cohort (or calendar week) beside that week's order rate."""
    on = ["event_week"] + (["user_segment"] if "user_segment" in center.columns else [])
    left = center.withColumnRenamed(key, "event_week").withColumnRenamed("cohort_retention_rate", "retention_rate")
    joined = left.join(rate.select(*on, "order_ratio"), on)
    return joined.withColumnRenamed("event_week", key).select(
        *[c for c in ("user_segment", key) if c in (key, *on)], "retention_rate", "order_ratio"
    )


def calendar_center(cohorts: DataFrame) -> DataFrame:
    """Median retention over all cohort cells that fall on a calendar week."""
    week = F.date_add("cohort_week", (F.col("week_diff") * 7).cast("int")).alias("calendar_week")
    keys = ["user_segment"] if "user_segment" in cohorts.columns else []
    return cohorts.groupBy(*keys, week).agg(F.median("cohort_retention_rate").alias("cohort_retention_rate"))
