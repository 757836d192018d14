"""Stored bases: user-days without exchanges, user sets, partitions replaced by date."""

import os
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.operators import activity as act
from loomlog.operators import orders as ords
from loomlog.operators import userdays as ud
from loomlog.operators import usersets as us
from loomlog.plans import catalog
from loomlog.sources import tables as tb

SF_DIR = "/root/testdata/sf0.001"


def files(folder):
    """Data files and their times of change, by directory."""
    found = defaultdict(dict)
    for top, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.relpath(top, folder)][n] = os.stat(os.path.join(top, n)).st_mtime_ns
    return dict(found)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def days_of(spark, rows):
    return spark.createDataFrame([(date.fromisoformat(d), n) for d, n in rows], "event_date date, n int")


def test_one_date_is_replaced_and_no_other_file_changes(spark, tmp_path):
    path = str(tmp_path / "log")
    tb.write_table(days_of(spark, [("2022-01-01", 1), ("2022-01-02", 2), ("2022-01-02", 3), ("2022-01-03", 4)]), path)
    before = files(path)
    log = tb.read_table(spark, path)
    again = log.withColumn("n", F.col("n") + 10)  # reads the table it goes into, and holds other dates
    tb.replace_partitions(again, path, [date(2022, 1, 2)])
    after = files(path)
    assert before.pop("event_date=2022-01-02") != after.pop("event_date=2022-01-02") and before == after
    assert sorted(r.n for r in tb.read_table(spark, path).collect()) == [1, 4, 12, 13]


def test_a_date_without_rows_goes_and_a_new_one_comes(spark, tmp_path):
    path = str(tmp_path / "log")
    tb.write_table(days_of(spark, [("2022-01-01", 1), ("2022-01-02", 2)]), path)
    load = days_of(spark, [("2022-01-05", 5)])
    for _ in range(2):  # repeated after a failure
        tb.replace_partitions(load, path, [date(2022, 1, 2), date(2022, 1, 5), date(2022, 1, 6)])
        got = sorted((str(r.event_date), r.n) for r in tb.read_table(spark, path).collect())
        assert got == [("2022-01-01", 1), ("2022-01-05", 5)]
        assert set(files(path)) == {"event_date=2022-01-01", "event_date=2022-01-05"}


def random_log(make_log, seed, users=40, days=400, rows=600):
    rng = random.Random(seed)
    start = date(2021, 11, 3)
    made = []
    for _ in range(rows):
        user = "hot" if rng.random() < 0.3 else f"u{rng.randrange(users)}"
        made.append((user, str(start + timedelta(days=rng.randrange(days))), rng.choice(["click_payment", "screen_view"])))
    return make_log(made)


def key_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("span", ["month", "year"])
def test_merged_days_equal_a_store_made_anew(spark, make_log, tmp_path, span):
    log, changed = random_log(make_log, 1), random_log(make_log, 2)
    dates = [date(2022, 3, n) for n in (1, 2, 30)] + [date(2022, 5, 9), date(2023, 7, 1)]  # the last has no rows at all
    table, path = f"merged_{span}", str(tmp_path / "store")
    ud.create_store(log, table, path, span, buckets=3)
    before = files(path)
    for _ in range(2):
        ud.merge_days(spark, table, changed, dates, span)
    mixed = log.where(~F.col("event_date").isin(dates)).unionByName(changed.where(F.col("event_date").isin(dates)))
    assert key_rows(spark.table(table)) == key_rows(ud.store_rows(mixed, span))
    touched = {f"{ud.SPAN}={d}" for d in ud.span_starts(dates, span)}
    after = files(path)
    assert {k: v for k, v in before.items() if k not in touched} == {k: v for k, v in after.items() if k not in touched}
    assert all(len(v) <= 3 for v in after.values())  # a file for each bucket
    assert "hashpartitioning(user_pseudo_id" not in plan(act.visit_intervals(spark.table(table)))
    spark.sql(f"DROP TABLE {table}")


def test_operators_take_a_store_like_a_log(spark, make_log, tmp_path):
    log = random_log(make_log, 3)
    ud.create_store(log, "like_a_log", str(tmp_path / "store"), "year")
    store = spark.table("like_a_log")
    hol = ords.holidays(log, 20, "user_pseudo_id")
    for operator in (act.visit_sequence, act.range_retention, lambda x: ords.order_segments(x, hol),
                     lambda x: ords.order_rate(x, "week", "user_pseudo_id"),
                     lambda x: ords.segment_order_rate(x, log.select("user_pseudo_id", F.lit("a").alias("user_segment")).distinct())):
        assert sorted(map(repr, operator(log).collect())) == sorted(map(repr, operator(store).collect()))
    spark.sql("DROP TABLE like_a_log")


@pytest.mark.parametrize("name", ["visit_sequence_first", "visit_intervals_orders", "range_retention_orders", "revisit_split",
                                  "visit_segments", "inflow_day", "inflow_revisit_day", "inflow_week", "order_segments_orders", "week_diffs",
                                  "cohort_retention", "cohort_retention_visit", "weekly_retention_visit", "order_rate_weekly_inflow"])
def test_no_exchange_by_user(spark, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    df.collect()
    shown = plan(df)
    assert "Bucketed: true" in shown
    assert "Exchange hashpartitioning(user_pseudo_id" not in shown and "Exchange hashpartitioning(user_id" not in shown.split("holiday")[0]


def test_payment_filter_reaches_the_files(spark):
    for name in ("holidays_orders", "inflow_day", "order_segments_orders"):
        assert "EqualTo(event_name,click_payment)" in plan(catalog.QUERIES[name](spark, SF_DIR))


def by_hand(rows, key):
    found = defaultdict(set)
    for user, day in rows:
        found[key(day)].add(user)
    return {k: len(v - {None}) for k, v in found.items() if v - {None}}


def test_sets_count_like_sets_and_keep_numbers(spark, make_log, tmp_path):
    rng = random.Random(4)
    start = date(2021, 12, 20)
    first = [(f"u{rng.randrange(50)}", start + timedelta(days=rng.randrange(60))) for _ in range(300)] + [(None, start)] * 3
    later = [(f"u{rng.randrange(90)}", start + timedelta(days=rng.randrange(90))) for _ in range(300)]
    folder = str(tmp_path / "sets")
    us.write_sets(make_log([(u, str(d)) for u, d in first]), folder)
    numbers = {r.user_pseudo_id: r.user_no for r in spark.read.parquet(f"{folder}/users").collect()}
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1))
    dates = [date(2022, 1, 31), date(2022, 2, 1), date(2022, 3, 2)]
    us.update_sets(spark, folder, make_log([(u, str(d)) for u, d in later]), dates)
    spans = {(d.year, d.month) for d in dates}
    rows = [r for r in first if (r[1].year, r[1].month) not in spans] + [r for r in later if (r[1].year, r[1].month) in spans]
    grown = {r.user_pseudo_id: r.user_no for r in spark.read.parquet(f"{folder}/users").collect()}
    assert numbers.items() <= grown.items() and sorted(grown.values()) == list(range(1, len(grown) + 1))
    days = us.day_sets(spark, folder)
    assert {r[0]: r[1] for r in us.active_users(days, "day").collect()} == by_hand(rows, lambda d: d)
    assert {r[0]: r[1] for r in us.active_users(days, "week").collect()} == by_hand(rows, lambda d: d - timedelta(days=d.weekday()))
    assert {r[0]: r[1] for r in us.active_users(days, "month").collect()} == by_hand(rows, lambda d: d.replace(day=1))
    got = {r.event_dow: r.user_cnt for r in us.dow_users(us.clock_sets(spark, folder)).collect()}
    assert got == by_hand(rows, lambda d: d.isoweekday())
    assert sum(r.records for r in us.distinct_users(days, "event_date").collect()) == len(rows)


def test_sets_beyond_one_bitmap(spark, tmp_path):
    users = 70_000  # three bitmaps
    log = spark.range(users * 2).select(
        (F.col("id") % users).cast("string").alias("user_pseudo_id"),
        F.expr("date_add(date'2022-01-30', cast(id div 70000 as int) * 3)").alias("event_date"),
        F.expr("timestamp_ntz'2022-01-30 10:00:00'").alias("event_datetime"))
    us.write_sets(log, str(tmp_path / "many"))
    days = us.day_sets(spark, str(tmp_path / "many"))
    assert days.select("bucket").distinct().count() == 3
    assert [tuple(r) for r in us.active_users(days, "week").orderBy("event_week").collect()] == [
        (date(2022, 1, 24), users), (date(2022, 1, 31), users)]
    assert {r.mau for r in us.active_users(days, "month").collect()} == {users}


def test_an_empty_log_has_empty_stores(spark, make_log, tmp_path):
    log = make_log([("u", "2022-01-01")]).limit(0)
    us.write_sets(log, str(tmp_path / "none"))
    ud.create_store(log, "no_days", str(tmp_path / "no_days"))
    assert spark.table("no_days").count() == 0 and spark.read.parquet(str(tmp_path / "none/users")).count() == 0
    ud.merge_days(spark, "no_days", make_log([("u", "2022-01-01")]), [date(2022, 1, 1)])
    assert [r.events for r in spark.table("no_days").collect()] == [1]
    spark.sql("DROP TABLE no_days")


def test_dropping_stored_tables(spark):
    """In a session of its own name space: another application id would be another folder."""
    made = tb.stored_bucketed(spark, "to_drop", "somewhere", lambda: spark.range(9).select(F.col("id").alias("u")), "u", ["u"])
    path = tb.table_location(spark, made).removeprefix("file:")
    assert os.path.isdir(path) and spark.catalog.tableExists(made)
    catalog.QUERIES["user_day_store"](spark, SF_DIR).count()
    tb.drop_stored(spark)
    assert not os.path.exists(path) and not spark.catalog.tableExists(made) and not tb._TABLES and not tb._STORED
    assert catalog.QUERIES["user_day_store"](spark, SF_DIR).count() > 0  # built again
