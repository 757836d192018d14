"""Small cases with results worked out by hand."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from loomlog.operators import activity as act
from loomlog.operators import funnel as fn
from loomlog.operators import orders as ords
from loomlog.operators import preparation as prep
from loomlog.operators import ranks as rk
from loomlog.operators import retention as rt
from loomlog.operators import segments as sg
from loomlog.operators import stats as st

D = dt.date
MICROS = 1659312000000000  # 2022-08-01 00:00 UTC
RAW = (
    "event_timestamp bigint, event_name string, user_id bigint, user_pseudo_id string, "
    "event_params array<struct<key:string, value:struct<string_value:string, int_value:bigint>>>"
)


def text(key, value):
    return (key, (value, None))


def number(key, value):
    return (key, (None, value))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ----------------------------------------------------------- preparation

def test_pivot(spark):
    raw = spark.createDataFrame(
        [
            (MICROS, "a", 1, "u", [text("p", "1")]),
            (MICROS, "a", 1, "u", [text("p", "2"), number("n", 7)]),
            (MICROS, "a", None, "u", [text("p", "x")]),
            (MICROS, "empty", 1, "u", []),
            (MICROS, "none", 1, "u", None),
            (MICROS, "twice", 1, "u", [text("p", "b"), text("p", "c"), text("p", "a"), number("n", 5)]),
            (MICROS, "keyless", 1, "u", [(None, ("z", None))]),
            (MICROS, "blank", 1, "u", [("p", (None, None))]),
        ],
        RAW,
    )
    assert prep.param_keys(raw) == ["n", "p"]
    flat = prep.pivot_params(raw)
    assert flat.columns == [
        "event_datetime", "event_date", "event_time", "event_week", "event_dow", "user_pseudo_id", "user_id",
        "event_name", "n", "p",
    ]
    assert rows(flat, "event_name", "user_id", "n", "p") == sorted(
        [
            ("a", 1, "7", "2"), ("a", None, None, "x"), ("twice", 1, "5", "c"), ("keyless", 1, None, None),
            ("blank", 1, None, None),
        ],
        key=repr,
    )
    first = flat.first()
    assert first.event_datetime == dt.datetime(2022, 8, 1, 9) and first.event_time == "09:00:00.000000"
    assert (first.event_date, first.event_week, first.event_dow) == (D(2022, 8, 1), D(2022, 8, 1), 1)


def test_pivot_of_a_dotted_key_and_of_no_keys(spark):
    raw = spark.createDataFrame([(MICROS, "a", 1, "u", [text("x.y", "1")])], RAW)
    assert prep.pivot_params(raw).select("`x.y`").first()[0] == "1"
    assert prep.pivot_params(raw, keys=[]).count() == 1


def test_time_does_not_depend_on_the_session_zone(spark):
    from loomlog.functions.columns import epoch_micros, whole_seconds

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 on this day does not exist in New York
        df = spark.sql("SELECT timestamp_ntz'2022-03-13 02:30:00.000123' ts")
        micros = df.select(epoch_micros(F.col("ts"))).first()[0]
        assert micros == 1647138600000123
        back = prep.enrich_time(
            spark.createDataFrame([(micros,)], "event_timestamp bigint"), tz="UTC"
        ).first()
        assert back.event_datetime == dt.datetime(2022, 3, 13, 2, 30, 0, 123)
        assert back.event_time == "02:30:00.000123"
        span = spark.sql("SELECT timestamp_ntz'2022-03-13 01:30:00' a, timestamp_ntz'2022-03-13 03:30:00' b")
        assert span.select(whole_seconds(F.col("b")) - whole_seconds(F.col("a"))).first()[0] == 7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_device_classes_and_target(spark, make_log):
    log = make_log([
        ("both", "2022-08-01", "x", "welcome", None), ("both", "2022-08-01", "x", "home", 5),
        ("guest", "2022-08-01", "x", "welcome", None), ("member", "2022-08-01", "x", "home", 6),
    ])
    classes = prep.device_classes(log)
    assert rows(classes, "user_pseudo_id", "device_class") == [
        ("both", "both"), ("guest", "anonymous_only"), ("member", "identified_only"),
    ]
    assert rows(prep.analysis_target(log).select("user_pseudo_id").distinct(), "user_pseudo_id") == [
        ("both",), ("member",),
    ]
    assert prep.uncovered_devices(log, classes).count() == 0
    left = prep.uncovered_devices(log, classes.where("device_class = 'both'"))
    assert rows(left, "user_pseudo_id") == [("guest",), ("member",)]
    assert rows(prep.behaviour_profile(log, prep.anonymous_devices(log)), "firebase_screen", "event_name") == [
        ("welcome", "x")
    ]


def test_cast_params(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "food_id string")
    assert [r[0] for r in prep.cast_params(df, {"food_id": "bigint"}).collect()] == [7, None, None]


# -------------------------------------------------------------- activity

def test_dwell_counts_second_boundaries(make_log):
    log = make_log([
        ("u", "2022-08-01", "x", "home", 1, "00:00:10.999"), ("u", "2022-08-01", "x", "home", 1, "00:00:11.001"),
    ]).withColumn("session_id", F.lit(None).cast("string"))
    assert rows(act.dwell_per_screen(log), "avg_duration_time_per_screen") == [(1.0,)]


def test_sequence_and_intervals_ignore_repeats_on_a_day(make_log):
    log = make_log([("u", "2022-08-01"), ("u", "2022-08-01"), ("u", "2022-08-04"), ("u", "2022-08-04")])
    assert rows(act.visit_sequence(log), "event_date", "prev_event_date") == [
        (D(2022, 8, 1), None), (D(2022, 8, 4), D(2022, 8, 1)),
    ]
    assert rows(act.visit_intervals(log), "day_diff") == [(3,)]


def test_fences_and_histogram(spark):
    gaps = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 4, 100)], "day_diff int")
    # quartiles 2, 2.5, 3.75 -> 2, 2, 3; fences 0.5 and 4.5 -> 0 and 4
    assert act.interval_fences(gaps).collect() == [(2, 2, 3, 0, 4)]
    wide = spark.createDataFrame([(x,) for x in (5, 10, 40, 80)], "day_diff int")
    # quartiles 8.75, 25, 50 -> 8, 25, 50; lower fence negative -> smallest gap
    assert act.interval_fences(wide).collect() == [(8, 25, 50, 5, 113)]
    bins = act.interval_histogram(gaps, "day_diff", 3).orderBy("bin").collect()
    assert [(r.bin, r.bin_start, r.bin_end, r.cnt) for r in bins] == [(0, 1.0, 34.0, 5), (1, 34.0, 67.0, 0), (2, 67.0, 100.0, 1)]
    one = act.interval_histogram(spark.createDataFrame([(7,), (7,)], "day_diff int"), "day_diff", 50)
    assert one.agg(F.sum("cnt"), F.min("bin_start"), F.max("bin_end")).first() == (2, 6.5, 7.5)
    assert one.where("cnt > 0").first().bin == 25


def test_dow_hour_rank_jumps_by_cell_size(make_log):
    log = make_log([
        ("u", "2022-08-01", "x", "h", 1, "07:10:00"), ("u", "2022-08-01", "x", "h", 1, "07:20:00"),
        ("v", "2022-08-01", "x", "h", 1, "08:00:00"), ("v", "2022-08-02", "x", "h", 1, "00:00:00"),
    ])
    assert rows(act.dow_hour_users(log), "order_num", "event_dow_hour", "user_cnt") == [
        (1, "Mon 07h", 1), (3, "Mon 08h", 1), (4, "Tue 00h", 1),
    ]


# ---------------------------------------------------------------- orders

def test_order_rate_edges(spark, make_log):
    pay = "click_payment"
    log = make_log([
        ("a", "2022-08-01", pay, "cart", None), ("b", "2022-08-01"),  # buyer without id
        ("a", "2022-08-02"),  # no order: no row
        ("a", "2022-08-03", pay, "cart", 1), ("a", "2022-08-03", pay, "cart", 1), ("b", "2022-08-03"),
    ])
    assert rows(ords.order_rate(log), "event_date", "dau", "order_users_cnt", "order_ratio") == [
        (D(2022, 8, 1), 2, 0, 0.0), (D(2022, 8, 3), 2, 1, 50.0),
    ]
    assert rows(ords.order_rate(log, buyer="user_pseudo_id"), "event_date", "order_users_cnt") == [
        (D(2022, 8, 1), 1), (D(2022, 8, 3), 1),
    ]
    daily = ords.orders_daily(log)
    assert rows(ords.repeat_order_days(daily), "order_cnt", "order_users_cnt") == [(1, 0), (2, 1)]


def test_holiday_uses_the_rounded_rate(make_log):
    # 30.0004 % rounds to 30.000 and is not a holiday; 30.0006 % rounds to 30.001
    def day(date, buyers, visitors):
        return [(f"u{i}", date, "click_payment" if i < buyers else "x", "c", i) for i in range(visitors)]

    log = make_log(day("2022-08-01", 3, 10) + day("2022-08-02", 4, 10))
    assert rows(ords.holidays(log, 30), "holiday_date", "holiday_week") == [(D(2022, 8, 2), D(2022, 8, 1))]
    from loomlog.functions.columns import percent

    ratio = log.sparkSession.range(1).select(
        percent(F.lit(300004), F.lit(1_000_000)).alias("a"), percent(F.lit(300006), F.lit(1_000_000)).alias("b")
    ).first()
    assert ratio.a == 30.0 and ratio.b == 30.001


def test_order_segments(make_log):
    pay = "click_payment"
    log = make_log([
        ("a", "2022-08-01", pay), ("a", "2022-08-02", pay), ("a", "2022-08-02", pay), ("a", "2022-08-03"),
        ("b", "2022-08-01"),
    ])
    hol = log.sparkSession.createDataFrame([(D(2022, 8, 2), D(2022, 8, 1))], "holiday_date date, holiday_week date")
    assert sorted(map(tuple, ords.order_segments(log, hol).collect())) == [
        ("non_ordered", "b", 1, 0, 0, 0), ("ordered", "a", 3, 2, 1, 1),
    ]


# -------------------------------------------------------------- segments

def dates(user, start, *gaps):
    day = D.fromisoformat(start)
    out = [(user, str(day))]
    for gap in gaps:
        day += dt.timedelta(days=gap)
        out.append((user, str(day)))
    return out


def test_visit_segments(make_log):
    log = make_log(
        dates("g14", "2022-08-01", 14) + dates("g15", "2022-08-01", 15) + dates("g30", "2022-08-01", 30)
        + dates("g31", "2022-08-01", 31)
        + dates("tie_mid", "2022-08-01", 3, 20, 3, 20)  # two short, two mid, latest mid
        + dates("tie_long", "2022-08-01", 3, 3, 20, 20, 40)  # latest is no mode
        + dates("clear", "2022-08-01", 3, 3, 40)  # mode beats the latest
        + [("once", "2022-08-01")] * 3
    )
    assert dict(map(tuple, sg.visit_segments(log).collect())) == {
        "g14": "short", "g15": "mid", "g30": "mid", "g31": "long", "tie_mid": "mid", "tie_long": "long",
        "clear": "short", "once": "one_day",
    }


def test_inflow_by_day_and_week(make_log):
    log = make_log([("a", "2022-08-02"), ("a", "2022-08-09"), ("b", "2022-08-04"), ("c", "2022-08-08")])
    hol = log.sparkSession.createDataFrame([(D(2022, 8, 2), D(2022, 8, 1))], "holiday_date date, holiday_week date")
    assert dict(map(tuple, sg.inflow_segments(log, hol).collect())) == {
        "a": "holiday", "b": "normal_day", "c": "normal_day",
    }
    assert dict(map(tuple, sg.inflow_segments(log, hol, by="week").collect())) == {
        "a": "holiday", "b": "holiday", "c": "normal_day",
    }
    assert dict(map(tuple, sg.inflow_segments(log, hol, base="revisit").collect())) == {"a": "holiday"}
    with pytest.raises(ValueError):
        sg.inflow_segments(log, hol, by="month")


def test_segment_shares(spark):
    seg = spark.createDataFrame(
        [("a", "one_day"), ("b", "short"), ("c", "short"), ("d", "long")], "user_pseudo_id string, user_segment string"
    )
    got = {r.label: (r.parent, r.users, r.percent_of_parent) for r in
           sg.segment_shares(seg, {"short": "revisit", "long": "revisit"}).collect()}
    assert got == {
        "one_day": ("", 1, 25.0), "revisit": ("", 3, 75.0), "short": ("revisit", 2, 66.667),
        "long": ("revisit", 1, 33.333),
    }


# ---------------------------------------------------------------- funnel

def test_open_funnel(make_log):
    log = make_log([
        ("pay", "2022-08-01", "click_payment", "cart"),
        ("walk", "2022-08-01", "screen_view", "home"), ("walk", "2022-08-01", "click_food", "restaurant"),
        ("walk", "2022-08-02", "screen_view", "home"),
        ("out", "2022-08-01", "screen_view", "search_result"),
        ("null", "2022-08-01", "screen_view", None),
    ])
    seg = sg.revisit_split(log).withColumn("user_segment", F.lit("all"))
    assert rows(fn.open_funnel(log, seg), "funnel_step", "funnel_users", "tot_users", "conversion_rate") == [
        (1, 1, 2, 0.5), (2, 1, 2, 0.5), (4, 1, 2, 0.5),
    ]
    assert rows(fn.order_counts(log, seg), "user_pseudo_id", "order_cnt") == [("pay", 1), ("walk", 0)]
    assert rows(fn.order_counts(log, seg, base="all"), "user_pseudo_id", "order_cnt") == [
        ("null", 0), ("out", 0), ("pay", 1), ("walk", 0),
    ]
    steps = fn.funnel_steps(log)
    assert rows(steps.where("funnel_step = 0"), "screen_event") == []
    assert rows(fn.screen_event(log).where("user_pseudo_id = 'null'"), "screen_event") == [(None,)]


# ------------------------------------------------------------- retention

def test_weeks_change_on_sunday_and_cohorts_on_monday(make_log):
    log = make_log([("u", "2022-08-06"), ("u", "2022-08-07"), ("u", "2022-08-08")])
    assert [r.week_diff for r in rt.week_diffs(log).orderBy("event_date").collect()] == [0, 1, 1]
    assert rows(rt.cohort_retention(log), "cohort_week", "week_diff", "retain_users", "cohort_retention_rate") == [
        (D(2022, 8, 1), 0, 1, 100.0), (D(2022, 8, 1), 1, 1, 100.0),
    ]
    assert rows(act.range_retention(log), "week_diff", "retain_user") == [(0, 1), (1, 1)]


def test_cohort_matrix_and_centers(spark):
    c = spark.createDataFrame(
        [("s", D(2022, 8, 1), 0, 10, 100.0), ("s", D(2022, 8, 1), 2, 4, 40.0), ("m", D(2022, 8, 8), 0, 3, 100.0)],
        "user_segment string, cohort_week date, week_diff bigint, retain_users bigint, cohort_retention_rate double",
    )
    m = rt.cohort_matrix(c.drop("user_segment"), "retain_users").orderBy("cohort_week")
    assert m.columns == ["cohort_week", "0", "2"]
    assert [tuple(r)[1:] for r in m.collect()] == [(10.0, 4.0), (3.0, None)]
    assert rt.cohort_matrix(c, "retain_users", drop_week0=True).columns == ["user_segment", "cohort_week", "2"]
    center = rt.cohort_center(c, "cohort_retention_rate")
    wide = rt.align_groups(center, "cohort_retention_rate", ["s", "m"]).orderBy("cohort_week").collect()
    assert [tuple(r)[1:] for r in wide] == [(70.0, 0.0), (0.0, 100.0)]
    cal = rt.calendar_center(c).where("user_segment = 's'").orderBy("calendar_week").collect()
    assert [(r.calendar_week, r.cohort_retention_rate) for r in cal] == [(D(2022, 8, 1), 100.0), (D(2022, 8, 15), 40.0)]


# ------------------------------------------------------------ statistics

def sample(spark, **groups):
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(data, "user_segment string, v double")


def test_mann_whitney_exact(spark):
    r = st.mann_whitney(sample(spark, a=[1, 2, 3], b=[4, 5, 6]), "a", "b", "v", method="exact").first()
    assert (r.n1, r.n2, r.u, r.rank_biserial) == (3, 3, 0.0, -1.0)
    assert r.p_value == pytest.approx(0.1)
    tied = st.mann_whitney(sample(spark, a=[1, 2], b=[2, 3]), "a", "b", "v", method="exact").first()
    assert tied.u == 0.5 and tied.p_value is None
    with pytest.raises(ValueError):
        st.mann_whitney(sample(spark, a=[1], b=[2]), "a", "b", "v", method="auto")


def test_histogram_of_fractions(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(2, 56)] + [(None,)], "v double")
    rows = act.interval_histogram(df, "v", 10).orderBy("bin").collect()
    assert sum(r.cnt for r in rows) == 54 and len(rows) == 10
    assert (rows[0].bin_start, rows[-1].bin_end) == (0.2, pytest.approx(5.5)) and all(5 <= r.cnt <= 6 for r in rows)


def test_repeated_holiday_counts_once(spark, make_log):
    log = make_log([("a", "2022-08-01", "click_payment"), ("a", "2022-08-02")])
    hol = spark.createDataFrame([(D(2022, 8, 1), D(2022, 8, 1))] * 2, "holiday_date date, holiday_week date")
    r = ords.order_segments(log, hol).first()
    assert (r.visit_day_cnt, r.order_day_cnt, r.order_holiday_cnt) == (2, 1, 1)


def test_matrix_keeps_segments_and_weeks(spark):
    rows = [("x", D(2022, 8, 1), 0, 10.0), ("y", D(2022, 8, 1), 0, 30.0), ("y", D(2022, 8, 8), 5, 1.0)]
    df = spark.createDataFrame(rows, "user_segment string, cohort_week date, week_diff bigint, v double")
    cells = {(r.user_segment, r.cohort_week.day, r.week_diff): r.value
             for r in rt.matrix_cells(rt.cohort_matrix(df, "v")).collect()}
    assert cells == {("x", 1, 0): 10.0, ("x", 1, 5): None, ("y", 1, 0): 30.0, ("y", 1, 5): None, ("y", 8, 0): None, ("y", 8, 5): 1.0}


def test_mann_whitney_undefined(spark):
    r = st.mann_whitney(sample(spark, a=[1, 1], b=[1]), "a", "b", "v").first()
    assert r.z is None and r.p_value is None
    r = st.mann_whitney(sample(spark, a=[1, 2]), "a", "b", "v").first()
    assert r.u is None and r.p_value is None


def test_chi_square(spark):
    counts = spark.createDataFrame([("a", 10, 20), ("b", 20, 10)], "user_segment string, yes bigint, no bigint")
    r = st.chi_square(counts).first()
    assert r.chi2 == pytest.approx(5.4) and r.dof == 1 and r.p_value == pytest.approx(math.erfc(math.sqrt(2.7)))
    none = spark.createDataFrame([("a", 0, 20), ("b", 0, 10)], "user_segment string, yes bigint, no bigint")
    assert st.chi_square(none).first().chi2 is None
    z = st.proportion_ztest(counts, "a", "b").first()
    assert z.z == pytest.approx((1 / 3 - 2 / 3) / math.sqrt(0.5 * 0.5 * (2 / 30)))


def test_kruskal(spark):
    df = sample(spark, a=[1, 2], b=[3, 4], c=[5, 6])
    r = st.kruskal(df, "v").first()
    assert r.h == pytest.approx(32 / 7) and r.p_value == pytest.approx(math.exp(-16 / 7))
    pairs = st.kruskal_pairs(df, "v", ["a", "b", "c"]).collect()
    assert sorted((p.group_a, p.group_b) for p in pairs) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert all(p.h == pytest.approx(2.4) and p.alpha == pytest.approx(0.05 / 3) for p in pairs)
    same = st.kruskal(sample(spark, a=[1, 1], b=[1]), "v").first()
    assert same.h is None and same.p_value is None


def test_dunn(spark):
    got = {(r.group_a, r.group_b): r for r in
           st.dunn(sample(spark, a=[1, 2], b=[3, 4], c=[5, 6]), "v", ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "a"].p_value == 1.0
    z = 4 / math.sqrt(3.5)  # mean ranks 1.5 and 5.5; 6*7/12 * (1/2 + 1/2)
    assert got["a", "c"].z == pytest.approx(z)
    assert got["a", "c"].p_value == pytest.approx(3 * math.erfc(z / math.sqrt(2)))
    assert got["a", "c"].p_value == got["c", "a"].p_value


def test_average_ranks(spark):
    df = sample(spark, a=[5, 3, 3, 1])
    got = rk.avg_ranks(df, "v").orderBy(F.desc("v")).collect()
    assert [r.avg_rank for r in got] == [1, 2.5, 2.5, 4]
    assert rk.mean_ranks(df, "user_segment", "v").first().mean_rank == 2.5


def test_correlations(spark):
    df = spark.createDataFrame([(float(x), float(x**3)) for x in range(1, 6)], "x double, y double")
    r = st.spearman(df, "x", "y").first()
    assert r.spearman_r == pytest.approx(1.0) and r.p_value == pytest.approx(0.0, abs=1e-9)
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
    assert st.pearson(flat, "x", "y").first().pearson_r is None
    assert st.pearson(df.limit(2), "x", "y").first().pearson_r is None


def test_risk_ratio(spark):
    f = spark.createDataFrame(
        [("a", 4, 1, 2, 0.5), ("b", 4, 1, 4, 0.25), ("b", 1, 4, 4, 1.0)],
        "user_segment string, funnel_step int, funnel_users bigint, tot_users bigint, conversion_rate double",
    )
    assert st.risk_ratio(f, "a", "b").first()[0] == 2.0
    counts = rows(st.conversion_counts(f), "user_segment", "yes", "no")
    assert counts == [("a", 1, 1), ("b", 1, 3)]


def test_schema_report(spark):
    df = spark.createDataFrame([(1, "a")], "n bigint not null, t string")
    (row,) = prep.schema_report(df).collect()
    assert json.loads(row["schema"]) == [
        {"mode": "REQUIRED", "name": "n", "type": "bigint"}, {"mode": "NULLABLE", "name": "t", "type": "string"}]
