"""Funnel queries on the orders log (and the step spec on the events log)."""

from __future__ import annotations

from loomlog.operators import funnel as fn
from loomlog.operators import segments as sg
from loomlog.plans.oracle import with_ctes
from loomlog.plans.orders import ev_holidays, inflow
from loomlog.sources.adapters import events_target as ev
from loomlog.sources.adapters import orders_log as od
from loomlog.sources.adapters import orders_visit_segments as seg

REVISIT = sg.REVISIT_LABELS

_STEP_COLUMNS = ["event_datetime", "user_pseudo_id", "firebase_screen", "event_name", "screen_event"]


def split(s, d):
    return sg.with_revisit(seg(s, d))


def intervals(s, d):
    return sg.only(seg(s, d), REVISIT)


FUNNELS = {
    "open_funnel_visit": lambda s, d: fn.open_funnel(od(s, d), seg(s, d)),
    "open_funnel_interval": lambda s, d: fn.open_funnel(od(s, d), intervals(s, d)),
    "open_funnel_revisit_split": lambda s, d: fn.open_funnel(od(s, d), split(s, d)),
    "open_funnel_revisit_inflow": lambda s, d: fn.open_funnel(od(s, d), inflow("revisit_day")(s, d), None),
    "open_funnel_inflow": lambda s, d: fn.open_funnel(od(s, d), inflow("day")(s, d), None),
}

COUNTS = {
    "order_counts_split": lambda s, d: fn.order_counts(od(s, d), split(s, d)),
    "order_counts_interval": lambda s, d: fn.order_counts(od(s, d), intervals(s, d)),
    "order_counts_revisit_inflow": lambda s, d: fn.order_counts(od(s, d), inflow("revisit_day")(s, d)),
    "order_counts_inflow": lambda s, d: fn.order_counts(od(s, d), inflow("day")(s, d), base="all"),
}

QUERIES = {
    "screen_event": lambda s, d: fn.screen_event(ev(s, d)).select(*_STEP_COLUMNS),
    "funnel_steps": lambda s, d: fn.funnel_steps(ev(s, d)).select(*_STEP_COLUMNS, "funnel_step"),
    **FUNNELS,
    "open_funnel_events_inflow": lambda s, d: fn.open_funnel(
        ev(s, d), sg.inflow_segments(ev(s, d), ev_holidays(s, d)), None
    ),
    **COUNTS,
}

_PAIR = """SELECT event_datetime, user_pseudo_id, firebase_screen, event_name,
                  firebase_screen || ': ' || event_name AS screen_event FROM ev"""

ORACLES = {
    "screen_event": with_ctes(_PAIR, "ev"),
    "funnel_steps": with_ctes(f"SELECT p.*, funnel_step FROM ({_PAIR}) p JOIN steps USING (screen_event)", "ev", "steps"),
    "open_funnel_visit": with_ctes("SELECT * FROM fun_visit", "fun_visit"),
    "open_funnel_interval": with_ctes("SELECT * FROM fun_interval", "fun_interval"),
    "open_funnel_revisit_split": with_ctes("SELECT * FROM fun_split", "fun_split"),
    "open_funnel_revisit_inflow": with_ctes("SELECT * FROM fun_inflow_revisit", "fun_inflow_revisit"),
    "open_funnel_inflow": with_ctes("SELECT * FROM fun_inflow", "fun_inflow"),
    "open_funnel_events_inflow": with_ctes(
        """SELECT user_segment, funnel_step, count(DISTINCT user_pseudo_id) AS funnel_users, tot_users,
                  CAST(count(DISTINCT user_pseudo_id) AS DOUBLE) / tot_users AS conversion_rate
           FROM e JOIN (SELECT user_segment, count(DISTINCT user_pseudo_id) AS tot_users FROM e GROUP BY 1)
             USING (user_segment)
           GROUP BY user_segment, funnel_step, tot_users""",
        "ev", "steps",
        h="""SELECT event_date FROM ev GROUP BY 1
             HAVING round(CAST(count(DISTINCT CASE WHEN event_name = 'click_payment' THEN user_id END) AS DOUBLE)
                    / count(DISTINCT user_pseudo_id) * 100, 3) > 40""",
        i="""SELECT user_pseudo_id, CASE WHEN min(event_date) IN (SELECT event_date FROM h) THEN 'holiday'
                                         ELSE 'normal_day' END AS user_segment FROM ev GROUP BY 1""",
        e=f"SELECT * FROM ({_PAIR}) JOIN steps USING (screen_event) JOIN i USING (user_pseudo_id)",
    ),
    "order_counts_split": with_ctes("SELECT * FROM cnt_split", "cnt_split"),
    "order_counts_interval": with_ctes("SELECT * FROM cnt_interval", "cnt_interval"),
    "order_counts_revisit_inflow": with_ctes("SELECT * FROM cnt_inflow_revisit", "cnt_inflow_revisit"),
    "order_counts_inflow": with_ctes("SELECT * FROM cnt_inflow", "cnt_inflow"),
}
