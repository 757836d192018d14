"""Order and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions.columns import USER
from loomlog.operators import orders as ords
from loomlog.operators import segments as sg
from loomlog.plans.oracle import visit_segments_sql, with_ctes
from loomlog.sources import adapters
from loomlog.sources.adapters import events_days as ev_days
from loomlog.sources.adapters import events_target as ev
from loomlog.sources.adapters import orders_days as od_days
from loomlog.sources.adapters import orders_log as od
from loomlog.sources.adapters import orders_visit_segments as seg

VISIT_PARENTS = {"short": "revisit", "mid": "revisit", "long": "revisit"}
_REVISIT = ["short", "mid", "long"]


def ev_holidays(s, d, buyer="user_id"):
    return ords.holidays(ev(s, d), adapters.EVENTS_HOLIDAY, buyer)


def od_holidays(s, d, buyer="user_id"):
    return ords.holidays(od(s, d), adapters.ORDERS_HOLIDAY, buyer)


inflow_day, inflow_week = adapters.orders_inflow_day, adapters.orders_inflow_week


def inflow(kind):
    """The stored map that the other analyses start from."""
    return lambda s, d: adapters.stored_inflow(s, d, kind)


#: Three levels: how users came in, whether they came back, and after how long.
TREE_PARENTS = {
    f"{inflow}/{label}": f"{inflow}/revisit" if label in _REVISIT else inflow
    for inflow in sg.INFLOW_LABELS for label in ("one_day", "revisit", *_REVISIT)
}


def inflow_tree(s, d):
    """Shares of the tree inflow, one-day or revisit, short, mid or long."""
    visits = seg(s, d).withColumnRenamed("user_segment", "visit")
    leaves = inflow("day")(s, d).join(visits, USER).select(USER, F.concat_ws("/", "user_segment", "visit").alias("user_segment"))
    return sg.segment_shares(leaves, TREE_PARENTS)


def _inflow_sizes(segments):
    return sg.segment_sizes(segments, {"holiday_inflow": ["holiday"], "normal_day_inflow": ["normal_day"]})


QUERIES = {
    "orders_daily": lambda s, d: ords.orders_daily(ev(s, d)),
    "repeat_order_days": lambda s, d: ords.repeat_order_days(ords.orders_daily(ev(s, d))),
    "repeat_order_days_orders": lambda s, d: ords.repeat_order_days(ords.orders_daily(od(s, d))),
    "monthly_order_users_orders": lambda s, d: ords.order_users(od(s, d), "month"),
    "high_order_rate_weeks_some": lambda s, d: ords.high_rate(ords.order_rate(ev(s, d), "week"), 33),
    "order_rate_daily": lambda s, d: ords.order_rate(ev(s, d), "day"),
    "order_rate_weekly": lambda s, d: ords.order_rate(ev(s, d), "week"),
    "monthly_order_users": lambda s, d: ords.order_users(ev(s, d), "month"),
    "high_order_rate_weeks": lambda s, d: ords.high_rate(ords.order_rate(ev(s, d), "week"), 12),
    "high_order_rate_weeks_orders": lambda s, d: ords.high_rate(ords.order_rate(od(s, d), "week"), 20),
    "revisit_split": lambda s, d: sg.revisit_split(od_days(s, d)),
    "revisit_split_sizes": lambda s, d: sg.segment_sizes(
        sg.revisit_split(od_days(s, d)), {"one_day_users": ["one_day"], "revisit_users": ["revisit"]}
    ),
    "visit_segments": lambda s, d: sg.visit_segments(od_days(s, d), *adapters.ORDERS_CUTS),
    "visit_segments_default_cuts": lambda s, d: sg.visit_segments(ev_days(s, d)),
    "visit_segments_short_cuts": lambda s, d: sg.visit_segments(ev_days(s, d), 1, 3),
    "visit_segment_sizes": lambda s, d: sg.segment_sizes(
        seg(s, d),
        {"oneday_users": ["one_day"], "revisit_users": _REVISIT, "short_term_users": ["short"],
         "mid_term_users": ["mid"], "long_term_users": ["long"]},
    ),
    "visit_segment_sizes_four": lambda s, d: sg.segment_sizes(
        seg(s, d),
        {"one_day_users": ["one_day"], "short_term_users": ["short"], "mid_term_users": ["mid"],
         "long_term_users": ["long"]},
    ),
    "interval_segment_sizes": lambda s, d: sg.segment_sizes(
        seg(s, d), {"short_term_users": ["short"], "mid_term_users": ["mid"], "long_term_users": ["long"]}
    ),
    "visit_segment_shares": lambda s, d: sg.segment_shares(seg(s, d), VISIT_PARENTS),
    "inflow_visit_tree": inflow_tree,
    "inflow_shares": lambda s, d: sg.segment_shares(inflow("day")(s, d)),
    "holidays": ev_holidays,
    "holidays_by_device": lambda s, d: ev_holidays(s, d, USER),
    "holidays_orders": od_holidays,
    "inflow_revisit_day": lambda s, d: inflow_day(s, d, "revisit"),
    "inflow_day": inflow_day,
    "inflow_week": inflow_week,
    "inflow_sizes_revisit": lambda s, d: _inflow_sizes(inflow("revisit_day")(s, d)),
    "inflow_sizes": lambda s, d: _inflow_sizes(inflow("day")(s, d)),
    "inflow_sizes_week": lambda s, d: _inflow_sizes(inflow("week")(s, d)),
    "order_segments": lambda s, d: ords.order_segments(ev_days(s, d), ev_holidays(s, d)),
    "order_segments_orders": lambda s, d: ords.order_segments(od_days(s, d), od_holidays(s, d)),
}


def _rate(log, unit, column, visitors, buyer="user_id"):
    return f"""SELECT {column}, v.n AS {visitors}, b.n AS order_users_cnt,
                      round(CAST(b.n AS DOUBLE) / v.n * 100, 3) AS order_ratio
               FROM (SELECT CAST(date_trunc('{unit}', event_date) AS DATE) AS {column},
                            count(DISTINCT user_pseudo_id) AS n FROM {log} GROUP BY 1) v
               JOIN (SELECT CAST(date_trunc('{unit}', event_date) AS DATE) AS {column},
                            count(DISTINCT {buyer}) AS n FROM {log}
                     WHERE event_name = 'click_payment' GROUP BY 1) b USING ({column})"""


def _holiday(log, threshold, buyer="user_id"):
    return f"""SELECT event_date AS holiday_date, CAST(date_trunc('week', event_date) AS DATE) AS holiday_week
               FROM ({_rate(log, 'day', 'event_date', 'dau', buyer)}) WHERE order_ratio > {threshold}"""


_DAILY = """SELECT event_date, count(*) AS order_cnt, count(DISTINCT user_id) AS order_users_cnt
            FROM ev WHERE event_name = 'click_payment' GROUP BY 1"""


def _sizes(source, names):
    cols = ", ".join(
        f"count(DISTINCT CASE WHEN user_segment IN ({labels}) THEN user_pseudo_id END) AS {name}"
        for name, labels in names.items()
    )
    return f"SELECT {cols} FROM {source}"


_INFLOW_SIZES = {"holiday_inflow": "'holiday'", "normal_day_inflow": "'normal_day'"}
_TERM_SIZES = {"short_term_users": "'short'", "mid_term_users": "'mid'", "long_term_users": "'long'"}


def _order_seg(log, threshold):
    """Flags per user and day, summed per user."""
    return with_ctes(
        f"""SELECT CASE WHEN bool_or(paid) THEN 'ordered' ELSE 'non_ordered' END AS user_segment, user_pseudo_id,
                   count(*) AS visit_day_cnt, count(*) FILTER (paid) AS order_day_cnt,
                   count(*) FILTER (paid AND NOT special) AS order_normal_cnt,
                   count(*) FILTER (paid AND special) AS order_holiday_cnt
            FROM (SELECT user_pseudo_id, event_date, bool_or(event_name = 'click_payment') AS paid,
                         event_date IN (SELECT holiday_date FROM h) AS special
                  FROM {log} GROUP BY user_pseudo_id, event_date)
            GROUP BY user_pseudo_id""",
        log, h=_holiday(log, threshold),
    )


_SHARES = """SELECT label, parent, users,
                    round(CAST(users AS DOUBLE) / sum(users) OVER (PARTITION BY parent) * 100, 3)
                      AS percent_of_parent
             FROM n"""

ORACLES = {
    "orders_daily": with_ctes(_DAILY, "ev"),
    "repeat_order_days": with_ctes(_DAILY + " HAVING order_cnt <> order_users_cnt", "ev"),
    "repeat_order_days_orders": with_ctes(
        _DAILY.replace("FROM ev", "FROM od") + " HAVING order_cnt <> order_users_cnt", "od"),
    "monthly_order_users_orders": with_ctes(
        """SELECT CAST(date_trunc('month', event_date) AS DATE) AS event_month,
                  count(DISTINCT user_id) AS order_users_cnt
           FROM od WHERE event_name = 'click_payment' GROUP BY 1""",
        "od",
    ),
    "high_order_rate_weeks_some": with_ctes(
        f"SELECT * FROM ({_rate('ev', 'week', 'event_week', 'wau')}) WHERE order_ratio > 33", "ev"
    ),
    "order_rate_daily": with_ctes(_rate("ev", "day", "event_date", "dau"), "ev"),
    "order_rate_weekly": with_ctes(_rate("ev", "week", "event_week", "wau"), "ev"),
    "monthly_order_users": with_ctes(
        """SELECT CAST(date_trunc('month', event_date) AS DATE) AS event_month,
                  count(DISTINCT user_id) AS order_users_cnt
           FROM ev WHERE event_name = 'click_payment' GROUP BY 1""",
        "ev",
    ),
    "high_order_rate_weeks": with_ctes(
        f"SELECT * FROM ({_rate('ev', 'week', 'event_week', 'wau')}) WHERE order_ratio > 12", "ev"
    ),
    "high_order_rate_weeks_orders": with_ctes(
        f"SELECT * FROM ({_rate('od', 'week', 'event_week', 'wau')}) WHERE order_ratio > 20", "od"
    ),
    "revisit_split": with_ctes(
        """SELECT user_pseudo_id, 'one_day' AS user_segment FROM od GROUP BY 1 HAVING count(DISTINCT event_date) = 1
           UNION
           SELECT user_pseudo_id, 'revisit' FROM od GROUP BY 1 HAVING count(DISTINCT event_date) > 1""",
        "od",
    ),
    "revisit_split_sizes": with_ctes(
        _sizes("split", {"one_day_users": "'one_day'", "revisit_users": "'revisit'"}), "split"
    ),
    "visit_segments": with_ctes("SELECT * FROM seg", "seg"),
    "visit_segments_default_cuts": with_ctes("SELECT * FROM s", "ev", s=visit_segments_sql("ev", 14, 30)),
    "visit_segments_short_cuts": with_ctes("SELECT * FROM s", "ev", s=visit_segments_sql("ev", 1, 3)),
    "visit_segment_sizes": with_ctes(
        _sizes("seg", {"oneday_users": "'one_day'", "revisit_users": "'short', 'mid', 'long'"} | _TERM_SIZES), "seg"
    ),
    "visit_segment_sizes_four": with_ctes(_sizes("seg", {"one_day_users": "'one_day'"} | _TERM_SIZES), "seg"),
    "interval_segment_sizes": with_ctes(_sizes("seg", _TERM_SIZES), "seg"),
    "visit_segment_shares": with_ctes(
        _SHARES, "seg", "split",
        n="""SELECT user_segment AS label, CASE user_segment WHEN 'one_day' THEN '' ELSE 'revisit' END AS parent,
                    count(*) AS users FROM seg GROUP BY 1
             UNION ALL
             SELECT 'revisit', '', count(*) FROM split WHERE user_segment = 'revisit'""",
    ),
    "inflow_visit_tree": with_ctes(
        _SHARES, "inflow_day", "seg",
        u="""SELECT i.user_segment AS way, s.user_segment AS visit, s.user_segment <> 'one_day' AS back
             FROM inflow_day i JOIN seg s USING (user_pseudo_id)""",
        n="""SELECT way AS label, '' AS parent, count(*) AS users FROM u GROUP BY way
             UNION ALL
             SELECT way || CASE WHEN back THEN '/revisit' ELSE '/one_day' END, way, count(*) FROM u GROUP BY way, back
             UNION ALL
             SELECT way || '/' || visit, way || '/revisit', count(*) FROM u WHERE back GROUP BY way, visit""",
    ),
    "inflow_shares": with_ctes(
        _SHARES, "inflow_day",
        n="SELECT user_segment AS label, '' AS parent, count(*) AS users FROM inflow_day GROUP BY 1",
    ),
    "holidays": with_ctes(_holiday("ev", 40), "ev"),
    "holidays_by_device": with_ctes(_holiday("ev", 40, "user_pseudo_id"), "ev"),
    "holidays_orders": with_ctes("SELECT * FROM od_hol", "od_hol"),
    "inflow_revisit_day": with_ctes("SELECT * FROM inflow_revisit", "inflow_revisit"),
    "inflow_day": with_ctes("SELECT * FROM inflow_day", "inflow_day"),
    "inflow_week": with_ctes("SELECT * FROM inflow_week", "inflow_week"),
    "inflow_sizes_revisit": with_ctes(_sizes("inflow_revisit", _INFLOW_SIZES), "inflow_revisit"),
    "inflow_sizes": with_ctes(_sizes("inflow_day", _INFLOW_SIZES), "inflow_day"),
    "inflow_sizes_week": with_ctes(_sizes("inflow_week", _INFLOW_SIZES), "inflow_week"),
    "order_segments": _order_seg("ev", 40),
    "order_segments_orders": _order_seg("od", 30),
}
