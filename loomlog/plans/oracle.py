"""Building blocks of the SQL counterparts.

The SQL starts from the definition of each measure and uses the database's own
means (sorted lists per user, list functions, filtered aggregates), not the
plan of the Spark operators, so that agreement tests both.
"""

from __future__ import annotations

from loomlog.operators.funnel import FUNNEL


def visit_segments_sql(log: str, short: int, mid: int) -> str:
    """Segment of every user from the sorted list of visit days.

    A gap is of class 1 (up to ``short`` days), 2 (up to ``mid``) or 3; the class
    with most gaps names the user, the latest gap's class where several have most.
    """
    return f"""
        SELECT user_pseudo_id,
               CASE WHEN len(days) = 1 THEN 'one_day'
                    ELSE ['short', 'mid', 'long'][CASE WHEN len(list_filter(votes, lambda v: v = list_max(votes))) = 1
                                                       THEN list_position(votes, list_max(votes))
                                                       ELSE list_last(kinds) END] END AS user_segment
        FROM (SELECT *, list_transform([1, 2, 3], lambda c: len(list_filter(kinds, lambda k: k = c))) AS votes
              FROM (SELECT *, list_transform(range(2, len(days) + 1), lambda i: CASE
                                WHEN days[i] - days[i - 1] <= {short} THEN 1
                                WHEN days[i] - days[i - 1] <= {mid} THEN 2 ELSE 3 END) AS kinds
                    FROM (SELECT user_pseudo_id, list_sort(list(DISTINCT event_date)) AS days
                          FROM {log} GROUP BY user_pseudo_id)))"""


_STEPS = ", ".join(f"('{key}', {step})" for step, keys in FUNNEL.items() for key in keys)

# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev_raw": ((), """
        SELECT ts,
               ts + INTERVAL 9 HOUR AS dt,
               'p' || user_id AS device,
               CASE WHEN user_id % 20 = 0 OR event_type = 'error' THEN NULL ELSE user_id END AS uid,
               event_type AS kind,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
        FROM events"""),
    "ev_named": (("ev_raw",), """
        SELECT *,
               CASE kind
                 WHEN 'view' THEN CASE WHEN k % 3 = 1 THEN 'restaurant: screen_view' ELSE 'home: screen_view' END
                 WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'home: click_banner'
                                              WHEN 1 THEN 'restaurant: click_food'
                                              ELSE 'home: click_search' END
                 WHEN 'signup' THEN CASE WHEN k % 3 = 2 THEN 'cart: click_recommend_extra_food'
                                         ELSE 'food_detail: click_cart' END
                 WHEN 'purchase' THEN 'cart: click_payment'
                 ELSE 'welcome: screen_view' END AS pair,
               device || '-' || strftime(dt, '%Y%m%d') || '-' || (hour(dt) // 6) AS sess
        FROM ev_raw"""),
    "ev_params": (("ev_named",), """
        SELECT dt, device, uid, split_part(pair, ': ', 2) AS name,
               unnest(CASE WHEN kind = 'click'
                      THEN [{'key': 'firebase_screen', 'val': split_part(pair, ': ', 1)},
                            {'key': 'session_id', 'val': sess},
                            {'key': 'food_id', 'val': CAST(k AS VARCHAR)}]
                      ELSE [{'key': 'firebase_screen', 'val': split_part(pair, ': ', 1)},
                            {'key': 'session_id', 'val': sess}] END) AS p
        FROM ev_named"""),
    "clean": (("ev_params",), """
        SELECT dt AS event_datetime,
               CAST(dt AS DATE) AS event_date,
               strftime(dt, '%H:%M:%S.%f') AS event_time,
               CAST(date_trunc('week', dt) AS DATE) AS event_week,
               CAST(isodow(dt) AS INTEGER) AS event_dow,
               device AS user_pseudo_id,
               uid AS user_id,
               name AS event_name,
               max(CASE WHEN p.key = 'firebase_screen' THEN p.val END) AS firebase_screen,
               max(CASE WHEN p.key = 'food_id' THEN p.val END) AS food_id,
               max(CASE WHEN p.key = 'session_id' THEN p.val END) AS session_id
        FROM ev_params GROUP BY dt, device, uid, name"""),
    "members": (("clean",), """
        SELECT DISTINCT user_pseudo_id FROM clean WHERE user_id IS NOT NULL"""),
    "guests": (("clean", "members"), """
        SELECT DISTINCT user_pseudo_id FROM clean
        WHERE user_id IS NULL AND user_pseudo_id NOT IN (SELECT user_pseudo_id FROM members)"""),
    "ev": (("clean", "guests"), """
        SELECT * FROM clean WHERE user_pseudo_id NOT IN (SELECT user_pseudo_id FROM guests)"""),
    "od": ((), """
        SELECT o_orderdate AS event_datetime,
               CAST(o_orderdate AS DATE) AS event_date,
               CAST(date_trunc('week', o_orderdate) AS DATE) AS event_week,
               'c' || o_custkey AS user_pseudo_id,
               o_custkey AS user_id,
               split_part(pair, ': ', 2) AS event_name,
               split_part(pair, ': ', 1) AS firebase_screen,
               pair AS screen_event
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'cart: click_payment'
                                             WHEN '2-HIGH' THEN 'food_detail: click_cart'
                                             WHEN '3-MEDIUM' THEN 'restaurant: click_food'
                                             WHEN '4-NOT SPECIFIED' THEN 'home: screen_view'
                                             ELSE 'search_result: screen_view' END AS pair
              FROM orders)"""),
    "seg": (("od",), visit_segments_sql("od", 90, 240)),
    "split": (("seg",), """
        SELECT user_pseudo_id, CASE user_segment WHEN 'one_day' THEN 'one_day' ELSE 'revisit' END AS user_segment
        FROM seg"""),
    "od_hol": (("od",), """
        SELECT v.event_date AS holiday_date, CAST(date_trunc('week', v.event_date) AS DATE) AS holiday_week
        FROM (SELECT event_date, count(DISTINCT user_pseudo_id) AS c FROM od GROUP BY 1) v
        JOIN (SELECT event_date, count(DISTINCT user_id) AS c FROM od
              WHERE event_name = 'click_payment' GROUP BY 1) b USING (event_date)
        WHERE round(CAST(b.c AS DOUBLE) / v.c * 100, 3) > 30"""),
    "od_hol_device": (("od",), """
        SELECT v.event_date AS holiday_date, CAST(date_trunc('week', v.event_date) AS DATE) AS holiday_week
        FROM (SELECT event_date, count(DISTINCT user_pseudo_id) AS c FROM od GROUP BY 1) v
        JOIN (SELECT event_date, count(DISTINCT user_pseudo_id) AS c FROM od
              WHERE event_name = 'click_payment' GROUP BY 1) b USING (event_date)
        WHERE round(CAST(b.c AS DOUBLE) / v.c * 100, 3) > 30"""),
    "inflow_day": (("od", "od_hol"), """
        SELECT user_pseudo_id,
               CASE WHEN min(event_date) IN (SELECT holiday_date FROM od_hol) THEN 'holiday'
                    ELSE 'normal_day' END AS user_segment
        FROM od GROUP BY user_pseudo_id"""),
    "inflow_revisit": (("inflow_day", "seg"), """
        SELECT * FROM inflow_day
        WHERE user_pseudo_id NOT IN (SELECT user_pseudo_id FROM seg WHERE user_segment = 'one_day')"""),
    "inflow_week": (("od", "od_hol_device"), """
        SELECT user_pseudo_id,
               CASE WHEN CAST(date_trunc('week', min(event_date)) AS DATE)
                         IN (SELECT holiday_week FROM od_hol_device) THEN 'holiday'
                    ELSE 'normal_day' END AS user_segment
        FROM od GROUP BY user_pseudo_id"""),
    # funnel
    "steps": ((), f"SELECT * FROM (VALUES {_STEPS}) AS t(screen_event, funnel_step)"),
    "od_steps": (("od", "steps"), """
        SELECT od.*, steps.funnel_step FROM od JOIN steps USING (screen_event)"""),
    # weeks since the first date, counted at Sunday boundaries
    "diffs": (("od",), """
        SELECT user_pseudo_id, first_date, event_date,
               CAST(date_trunc('week', first_date) AS DATE) AS cohort_week,
               CAST(floor((event_date - DATE '1970-01-01' + 4) / 7.0)
                    - floor((first_date - DATE '1970-01-01' + 4) / 7.0) AS BIGINT) AS week_diff
        FROM (SELECT user_pseudo_id, days[1] AS first_date, unnest(days) AS event_date
              FROM (SELECT user_pseudo_id, list_sort(list(DISTINCT event_date)) AS days FROM od GROUP BY user_pseudo_id))"""),
    "coh": (("diffs",), """
        SELECT cohort_week, week_diff, n AS retain_users, f AS first_week_users,
               round(CAST(n AS DOUBLE) / f * 100, 3) AS cohort_retention_rate
        FROM (SELECT cohort_week, week_diff, n,
                     first_value(n) OVER (PARTITION BY cohort_week ORDER BY week_diff) AS f
              FROM (SELECT cohort_week, week_diff, count(DISTINCT user_pseudo_id) AS n
                    FROM diffs GROUP BY 1, 2))"""),
}


def _segmented_cohorts(seg: str, where: str = "") -> str:
    return f"""
        SELECT user_segment, cohort_week, week_diff, n AS retain_users, f AS first_week_users,
               round(CAST(n AS DOUBLE) / f * 100, 3) AS cohort_retention_rate
        FROM (SELECT *, first_value(n) OVER (PARTITION BY user_segment, cohort_week ORDER BY week_diff) AS f
              FROM (SELECT user_segment, cohort_week, week_diff, count(DISTINCT user_pseudo_id) AS n
                    FROM diffs JOIN {seg} USING (user_pseudo_id) {where} GROUP BY 1, 2, 3))"""


_REVISIT = "WHERE user_segment <> 'one_day'"
CTES["coh_visit"] = (("diffs", "seg"), _segmented_cohorts("seg", _REVISIT))
CTES["coh_inflow"] = (("diffs", "inflow_week"), _segmented_cohorts("inflow_week"))


def _funnel(seg: str, where: str, digits: int | None) -> str:
    rate = "CAST(funnel_users AS DOUBLE) / tot_users"
    rate = rate if digits is None else f"round({rate}, {digits})"
    return f"""
        SELECT user_segment, funnel_step, funnel_users, tot_users, {rate} AS conversion_rate
        FROM (SELECT user_segment, funnel_step, count(DISTINCT user_pseudo_id) AS funnel_users
              FROM od_steps JOIN {seg} USING (user_pseudo_id) {where} GROUP BY 1, 2)
        JOIN (SELECT user_segment, count(DISTINCT user_pseudo_id) AS tot_users
              FROM od_steps JOIN {seg} USING (user_pseudo_id) {where} GROUP BY 1) USING (user_segment)"""


CTES["fun_visit"] = (("od_steps", "seg"), _funnel("seg", "", 3))
CTES["fun_interval"] = (("od_steps", "seg"), _funnel("seg", _REVISIT, 3))
CTES["fun_split"] = (("od_steps", "split"), _funnel("split", "", 3))
CTES["fun_inflow_revisit"] = (("od_steps", "inflow_revisit"), _funnel("inflow_revisit", "", None))
CTES["fun_inflow"] = (("od_steps", "inflow_day"), _funnel("inflow_day", "", None))


def _counts(source: str, seg: str, where: str = "") -> str:
    return f"""
        SELECT user_segment, user_pseudo_id,
               count(*) FILTER (WHERE screen_event = 'cart: click_payment') AS order_cnt
        FROM {source} JOIN {seg} USING (user_pseudo_id) {where} GROUP BY 1, 2"""


CTES["cnt_split"] = (("od_steps", "split"), _counts("od_steps", "split"))
CTES["cnt_interval"] = (("od_steps", "seg"), _counts("od_steps", "seg", _REVISIT))
CTES["cnt_inflow_revisit"] = (("od_steps", "inflow_revisit"), _counts("od_steps", "inflow_revisit"))
CTES["cnt_inflow"] = (("od", "inflow_day"), _counts("od", "inflow_day"))


def _retention(seg: str, where: str = "") -> str:
    return f"""
        SELECT user_segment, week_diff, len(users) AS retain_users, first_users,
               round(CAST(len(users) AS DOUBLE) / first_users * 100, 3) AS retention_rate
        FROM (SELECT user_segment, week_diff, list(DISTINCT user_pseudo_id) AS users,
                     max(CASE WHEN week_diff = 0 THEN len(list(DISTINCT user_pseudo_id)) END)
                       OVER (PARTITION BY user_segment) AS first_users
              FROM diffs JOIN {seg} USING (user_pseudo_id) {where} GROUP BY 1, 2)"""


CTES["ret_visit"] = (("diffs", "seg"), _retention("seg", _REVISIT))
CTES["ret_inflow_revisit"] = (("diffs", "inflow_revisit"), _retention("inflow_revisit"))
CTES["ret_inflow"] = (("diffs", "inflow_day"), _retention("inflow_day"))


def _weekly_rate(seg: str, where: str = "") -> str:
    return f"""
        SELECT v.user_segment, v.event_week, round(CAST(b.n AS DOUBLE) / v.n * 100, 3) AS order_ratio
        FROM (SELECT user_segment, event_week, count(DISTINCT user_pseudo_id) AS n
              FROM od JOIN {seg} USING (user_pseudo_id) {where} GROUP BY 1, 2) v
        JOIN (SELECT user_segment, event_week, count(DISTINCT user_pseudo_id) AS n
              FROM od JOIN {seg} USING (user_pseudo_id)
              WHERE event_name = 'click_payment' GROUP BY 1, 2) b
        ON b.user_segment = v.user_segment AND b.event_week = v.event_week"""


CTES["rate_visit"] = (("od", "seg"), _weekly_rate("seg", _REVISIT))
CTES["rate_inflow"] = (("od", "inflow_week"), _weekly_rate("inflow_week"))
CTES["rate_all"] = (("od",), """
        SELECT v.event_week, round(CAST(b.n AS DOUBLE) / v.n * 100, 3) AS order_ratio
        FROM (SELECT event_week, count(DISTINCT user_pseudo_id) AS n FROM od GROUP BY 1) v
        JOIN (SELECT event_week, count(DISTINCT user_id) AS n FROM od
              WHERE event_name = 'click_payment' GROUP BY 1) b USING (event_week)""")


def with_ctes(body: str, *needs: str, **extra: str) -> str:
    """``body`` preceded by the blocks it needs, in order; ``extra`` come last."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                add(dep)
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# ---- tail probabilities by Simpson's rule on 2000 intervals

def _simpson(density: str, upper: str) -> str:
    return (
        "list_sum(list_transform(range(0, 2001), lambda i: "
        f"(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density}))"
        f" * ({upper}) / 6000"
    )


def normal_p(z: str) -> str:
    """Two-sided normal p of an expression."""
    mass = _simpson(f"exp(-power(abs({z}) * i / 2000.0, 2) / 2)", f"abs({z})")
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {mass}) END"


def chi2_p(x: str, dof: str) -> str:
    """Upper tail for up to 2 degrees of freedom (a single group has none)."""
    root = f"sqrt({x})"
    return f"CASE {dof} WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN {normal_p(root)} WHEN 2 THEN exp(-({x}) / 2) END"


def t_p(r: str, n: str) -> str:
    """Two-sided p of a correlation."""
    dof = f"({n} - 2)"
    t = f"abs({r} * sqrt({dof} / (1 - {r} * {r})))"
    mass = _simpson(f"power(1 + power({t} * i / 2000.0, 2) / {dof}, -({dof} + 1) / 2.0)", t)
    scale = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return f"CASE WHEN {r} IS NOT NULL THEN greatest(0.0, 1 - 2 * {scale} * {mass}) END"
