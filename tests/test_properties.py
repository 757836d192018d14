"""Rewritten forms against literal ones, and identities that hold on any log."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomlog.operators import activity as act
from loomlog.operators import funnel as fn
from loomlog.operators import orders as ords
from loomlog.operators import ranks as rk
from loomlog.operators import retention as rt
from loomlog.operators import segments as sg
from loomlog.operators import stats as st

EVENTS = [(e.split(": ")[0], e.split(": ")[1]) for keys in fn.FUNNEL.values() for e in keys] + [
    ("search_result", "screen_view"), ("welcome", "screen_view"),
]


def random_log(make_log, seed, users=25, rows=400, days=120, hot=False):
    """With ``hot`` one user and one day hold about a third of all rows each."""
    rng = random.Random(seed)
    start = dt.date(2022, 8, 1)
    out = []
    for _ in range(rows):
        user = 0 if hot and rng.random() < 0.34 else rng.randrange(users)
        day = 7 if hot and rng.random() < 0.34 else rng.randrange(days)
        screen, event = rng.choice(EVENTS)
        out.append((f"u{user}", str(start + dt.timedelta(days=day)), event, screen, user if rng.random() < 0.9 else None))
    return make_log(out)


@pytest.fixture(params=[(1, False), (2, True)], ids=["even", "hot"])
def log(request, make_log):
    seed, hot = request.param
    return random_log(make_log, seed, hot=hot).cache()


def pandas_segments(log, short, mid):
    """One user at a time, as the rule is told."""
    pdf = log.select("user_pseudo_id", "event_date").distinct().toPandas().sort_values("event_date")
    out = {}
    for user, g in pdf.groupby("user_pseudo_id"):
        gaps = [d.days for d in pd.to_datetime(g.event_date).diff().dropna()]
        names = ["short" if x <= short else "mid" if x <= mid else "long" for x in gaps]
        if not names:
            out[user] = "one_day"
            continue
        top = max(names.count(n) for n in set(names))
        modes = [n for n in set(names) if names.count(n) == top]
        out[user] = modes[0] if len(modes) == 1 else names[-1]
    return out


@pytest.mark.parametrize("cuts", [(14, 30), (1, 3), (5, 8)])
def test_visit_segments(log, cuts):
    assert dict(map(tuple, sg.visit_segments(log, *cuts).collect())) == pandas_segments(log, *cuts)


def test_segments_partition_the_users(log):
    users = log.select("user_pseudo_id").distinct().count()
    seg = sg.visit_segments(log)
    sizes = sg.segment_sizes(seg, {n: [n] for n in sg.VISIT_LABELS}).first()
    assert sum(sizes) == users == seg.count()
    split = {r.user_segment: r["n"] for r in sg.revisit_split(log).groupBy("user_segment").agg(F.count("*").alias("n")).collect()}
    assert split.get("one_day", 0) == sizes.one_day
    hol = ords.holidays(log, 10)
    inflow = sg.inflow_segments(log, hol)
    assert inflow.count() == users and inflow.select("user_pseudo_id").distinct().count() == users
    segs = ords.order_segments(log, hol)
    assert segs.count() == users
    assert segs.where("order_day_cnt <> order_normal_cnt + order_holiday_cnt OR order_day_cnt > visit_day_cnt").count() == 0


def test_retention_starts_at_100_percent_and_cohorts_add_up(log):
    seg = sg.visit_segments(log)
    start = rt.weekly_retention(log, seg).where("week_diff = 0").collect()
    assert all(r.retention_rate == 100.0 and r.retain_users == r.first_users for r in start)
    users = log.select("user_pseudo_id").distinct().count()
    assert sum(r.retain_users for r in start) == users
    cohorts = rt.cohort_retention(log).where("week_diff = 0")
    assert cohorts.agg(F.sum("retain_users")).first()[0] == users
    # user-weeks and visit days tell the same story
    days = rt.week_diffs(log).groupBy("week_diff").agg(F.count_distinct("user_pseudo_id").alias("n"))
    weeks = rt.user_weeks(log).groupBy("week_diff").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, weeks.collect()))


def test_funnel_bounds_and_literal_counts(log):
    seg = sg.revisit_split(log)
    got = fn.open_funnel(log, seg, digits=None).collect()
    assert all(0 < r.funnel_users <= r.tot_users for r in got)
    literal = (
        fn.funnel_steps(log).join(seg, "user_pseudo_id").groupBy("user_segment", "funnel_step")
        .agg(F.count_distinct("user_pseudo_id").alias("n")).collect()
    )
    assert {(r.user_segment, r.funnel_step): r.funnel_users for r in got} == {
        (r.user_segment, r.funnel_step): r["n"] for r in literal
    }
    paid = log.where("firebase_screen = 'cart' AND event_name = 'click_payment'").count()
    assert fn.order_counts(log, seg).agg(F.sum("order_cnt")).first()[0] == paid


def test_stickiness_against_pandas(log):
    pdf = log.select("user_pseudo_id", "event_date").toPandas()
    pdf["m"] = pd.to_datetime(pdf.event_date).dt.to_period("M")
    dau, mau = pdf.groupby("event_date").user_pseudo_id.nunique(), pdf.groupby("m").user_pseudo_id.nunique()
    for r in act.stickiness(log).collect():
        month = pd.Period(r.event_date, "M")
        assert (r.dau, r.mau) == (dau[r.event_date], mau[month])
        assert r.sum_of_dau == dau[[d for d in dau.index if pd.Period(d, "M") == month]].sum()
        assert r.stickiness == pytest.approx(round(r.dau / r.mau * 100, 4), abs=1e-4)


def test_ranks_against_pandas(spark):
    rng = random.Random(5)
    data = [(i % 3, float(0 if rng.random() < 0.4 else rng.randrange(60))) for i in range(600)]
    df = spark.createDataFrame(data, "g int, v double").repartition(6)
    got = rk.avg_ranks(df, "v", by=["g"]).toPandas()
    assert len(got) == 600
    expected = got.groupby("g").v.rank(ascending=False)
    assert (got.avg_rank - expected).abs().max() == 0
    whole = rk.mean_ranks(df, "g", "v").collect()
    assert sum(r.mean_rank * r.n for r in whole) == 600 * 601 / 2


def test_mann_whitney_against_pair_counting(spark):
    rng = random.Random(9)
    a, b = [rng.randrange(8) for _ in range(40)], [rng.randrange(10) for _ in range(70)]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "user_segment string, v int")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    one = st.mann_whitney(df, "a", "b", "v").first()
    two = st.mann_whitney(df, "b", "a", "v").first()
    assert one.u == u and one.u + two.u == 40 * 70
    assert one.p_value == pytest.approx(two.p_value) and one.rank_biserial == pytest.approx(-two.rank_biserial)
    # two groups: H is the square of the z without continuity correction
    h = st.kruskal(df, "v").first().h
    sigma = (max(u, 2800 - u) - 1400 - 0.5) / one.z
    assert h == pytest.approx(((u - 1400) / sigma) ** 2)


def test_write_table_keeps_a_hot_day_whole(spark, make_log, tmp_path):
    from loomlog.sources.tables import read_table, write_table

    log = random_log(make_log, 3, hot=True)
    path = str(tmp_path / "log")
    write_table(log, path)
    back = read_table(spark, path, log.schema)
    assert dict(back.dtypes) == dict(log.dtypes)
    assert sorted(map(repr, back.select(*log.columns).collect())) == sorted(map(repr, log.collect()))


def test_plans_prune_columns_and_read_once(spark):
    """DAU reads two columns; stickiness scans the log in one stage."""
    from loomlog.plans import catalog

    d = "/root/testdata/sf0.001"

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    dau = plan(catalog.QUERIES["daily_active_users"](spark, d))
    assert "ReadSchema: struct<user_pseudo_id:string>" in dau
    sticky = catalog.QUERIES["stickiness_month"](spark, d)
    sticky.collect()
    assert "ReusedExchange" in plan(sticky)
    pay = plan(catalog.QUERIES["orders_daily"](spark, d))
    assert "EqualTo(event_name,click_payment)" in pay
    for name in ("visit_segments", "open_funnel_inflow", "cohort_retention_visit", "order_rate_daily"):
        text = plan(catalog.QUERIES[name](spark, d))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("kind", ["path", "name"])
def test_stored_tables_build_on_each_other(spark, tmp_path, kind):
    from loomlog.operators import preparation_tables as tables
    from loomlog.sources.adapters import events_raw
    from loomlog.sources.tables import read_table

    if kind == "path":
        def at(name):
            return str(tmp_path / name)
    else:
        spark.sql(f"CREATE DATABASE app LOCATION '{tmp_path}/app'")

        def at(name):
            return f"app.{name}"

    tables.build_cleaned(events_raw(spark, "/root/testdata/sf0.001"), at("cleaned"))
    tables.build_target(spark, at("cleaned"), at("target"))
    tables.build_visit_segments(spark, at("target"), at("visit_seg"))
    tables.build_order_segments(spark, at("target"), at("order_seg"), threshold=40)
    cleaned, target = read_table(spark, at("cleaned")), read_table(spark, at("target"))
    assert cleaned.count() == 1000 and target.count() == 940
    assert dict(target.dtypes)["event_date"] == "date"
    users = target.select("user_pseudo_id").distinct().count()
    assert read_table(spark, at("visit_seg")).count() == users == 14
    assert read_table(spark, at("order_seg")).count() == users
    pruned = target.where("event_date = date'2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in pruned
