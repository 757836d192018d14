"""Retention, cohort and rate-join queries on the orders log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import orders as ords
from loomlog.operators import retention as rt
from loomlog.operators import segments as sg
from loomlog.plans.funnel import intervals
from loomlog.plans.oracle import with_ctes
from loomlog.plans.orders import inflow
from loomlog.sources.adapters import orders_days as od_days
from loomlog.sources.adapters import orders_log as od

GROUPS = list(sg.REVISIT_LABELS)
RATE, USERS = "cohort_retention_rate", "retain_users"


def cohorts(s, d):
    return rt.cohort_retention(od_days(s, d))


def cohorts_visit(s, d):
    return rt.cohort_retention(od_days(s, d), intervals(s, d))


def cohorts_inflow(s, d):
    return rt.cohort_retention(od_days(s, d), inflow("week")(s, d))


def aligned(value, how):
    return lambda s, d: rt.align_groups(rt.cohort_center(cohorts_visit(s, d), value, how), value, GROUPS)


def rates_all(s, d):
    return rt.join_rates(rt.cohort_center(cohorts(s, d), RATE), ords.order_rate(od(s, d), "week"))


def rates_visit(s, d):
    return rt.join_rates(
        rt.cohort_center(cohorts_visit(s, d), RATE), ords.segment_order_rate(od_days(s, d), intervals(s, d))
    )


def rates_inflow(s, d):
    return rt.join_rates(
        rt.calendar_center(cohorts_inflow(s, d)),
        ords.segment_order_rate(od_days(s, d), inflow("week")(s, d)),
        key="calendar_week",
    )


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _matrix(make, value, label=None):
    """Every cell of a matrix, of one segment if it is named."""

    def run(s, d):
        table = make(s, d)
        if label is not None:
            table = table.where(F.col("user_segment") == label)
        return _round(rt.cell_rows(rt.cohort_cells(table, value, drop_week0=value == RATE)), "value")

    return run


def _center(make, value, how):
    return lambda s, d: _round(rt.cohort_center(make(s, d), value, how), value)


QUERIES = {
    "week_diffs": lambda s, d: rt.week_diffs(od_days(s, d)),
    "weekly_retention_visit": lambda s, d: rt.weekly_retention(od_days(s, d), intervals(s, d)),
    "weekly_retention_revisit_inflow": lambda s, d: rt.weekly_retention(od_days(s, d), inflow("revisit_day")(s, d)),
    "weekly_retention_inflow": lambda s, d: rt.weekly_retention(od_days(s, d), inflow("day")(s, d)),
    "cohort_retention": cohorts,
    "cohort_retention_visit": cohorts_visit,
    "cohort_retention_inflow_week": cohorts_inflow,
    "cohort_matrix_users": _matrix(cohorts, USERS),
    "cohort_matrix_rate": _matrix(cohorts, RATE),
    "cohort_matrix_rate_visit": _matrix(cohorts_visit, RATE),
    **{
        f"cohort_matrix_{name}_{label}": _matrix(make, value, label)
        for make, labels in ((cohorts_visit, GROUPS), (cohorts_inflow, sg.INFLOW_LABELS))
        for label in labels
        for name, value in (("users", USERS), ("rate", RATE))
    },
    "cohort_center_rate_median": _center(cohorts, RATE, "median"),
    "cohort_center_visit_rate_median": _center(cohorts_visit, RATE, "median"),
    "cohort_center_visit_rate_mean": _center(cohorts_visit, RATE, "mean"),
    "cohort_center_visit_users_median": _center(cohorts_visit, USERS, "median"),
    "cohort_center_visit_users_mean": _center(cohorts_visit, USERS, "mean"),
    "cohort_center_inflow_rate_median": _center(cohorts_inflow, RATE, "median"),
    "cohort_center_inflow_users_median": _center(cohorts_inflow, USERS, "median"),
    "align_groups_rate_median": lambda s, d: _round(aligned(RATE, "median")(s, d), *GROUPS),
    "align_groups_users_mean": lambda s, d: _round(aligned(USERS, "mean")(s, d), *GROUPS),
    "order_rate_weekly_visit": lambda s, d: ords.segment_order_rate(od_days(s, d), intervals(s, d)),
    "order_rate_weekly_inflow": lambda s, d: ords.segment_order_rate(od_days(s, d), inflow("week")(s, d)),
    "retention_order_rate": lambda s, d: _round(rates_all(s, d), "retention_rate"),
    "retention_order_rate_visit": lambda s, d: _round(rates_visit(s, d), "retention_rate"),
    "calendar_center_inflow": lambda s, d: _round(rt.calendar_center(cohorts_inflow(s, d)), RATE),
    "retention_order_rate_inflow": lambda s, d: _round(rates_inflow(s, d), "retention_rate"),
}


def _matrix_sql(source, value, where="", drop0=False):
    """All weeks beside all cohorts, with the cell where there is one."""
    keys = "cohort_week" if source == "coh" else "user_segment, cohort_week"
    return with_ctes(
        f"""SELECT {keys}, week_diff, round(v, 6) AS value
            FROM (SELECT DISTINCT {keys} FROM cells)
            CROSS JOIN (SELECT DISTINCT week_diff FROM cells {'WHERE week_diff <> 0' if drop0 else ''})
            LEFT JOIN cells USING ({keys}, week_diff)""",
        source,
        cells=f"""SELECT {keys}, week_diff, avg(CAST({value} AS DOUBLE)) AS v FROM {source}
                  {'WHERE ' + where if where else ''} GROUP BY {keys}, week_diff""",
    )


def _center_sql(source, value, fn):
    keys = "cohort_week" if source == "coh" else "user_segment, cohort_week"
    return with_ctes(
        f"SELECT {keys}, round({fn}(CAST({value} AS DOUBLE)), 6) AS {value} FROM {source} GROUP BY ALL", source
    )


def centers_sql(source, value, fn):
    """CTE text: one value v per segment and cohort."""
    return f"""SELECT user_segment, cohort_week, {fn}(CAST({value} AS DOUBLE)) AS v
               FROM {source} GROUP BY 1, 2"""


def aligned_sql(value, fn):
    one = "(SELECT cohort_week, v FROM c WHERE user_segment = '{}')"
    return {
        "c": centers_sql("coh_visit", value, fn),
        "al": f"""SELECT cohort_week, coalesce(a.v, 0.0::DOUBLE) AS short, coalesce(b.v, 0.0::DOUBLE) AS mid,
                         coalesce(e.v, 0.0::DOUBLE) AS long
                  FROM {one.format('short')} a FULL JOIN {one.format('mid')} b USING (cohort_week)
                  FULL JOIN {one.format('long')} e USING (cohort_week)""",
    }


RATES_SQL = {
    "all": dict(
        needs=("coh", "rate_all"),
        text="""SELECT cohort_week, m AS retention_rate, order_ratio
                FROM (SELECT cohort_week, median(cohort_retention_rate) AS m FROM coh GROUP BY 1)
                JOIN rate_all ON event_week = cohort_week""",
    ),
    "visit": dict(
        needs=("coh_visit", "rate_visit"),
        text="""SELECT c.user_segment, cohort_week, m AS retention_rate, order_ratio
                FROM (SELECT user_segment, cohort_week, median(cohort_retention_rate) AS m
                      FROM coh_visit GROUP BY 1, 2) c
                JOIN rate_visit r ON r.event_week = cohort_week AND r.user_segment = c.user_segment""",
    ),
    "inflow": dict(
        needs=("coh_inflow", "rate_inflow"),
        text="""SELECT c.user_segment, calendar_week, m AS retention_rate, order_ratio
                FROM (SELECT user_segment, cohort_week + CAST(7 * week_diff AS INTEGER) AS calendar_week,
                             median(cohort_retention_rate) AS m
                      FROM coh_inflow GROUP BY 1, 2) c
                JOIN rate_inflow r ON r.event_week = calendar_week AND r.user_segment = c.user_segment""",
    ),
}


def _rates(name):
    spec = RATES_SQL[name]
    return with_ctes(
        "SELECT * REPLACE (round(retention_rate, 6) AS retention_rate) FROM j", *spec["needs"], j=spec["text"]
    )


_ROUND_ALIGNED = "SELECT cohort_week, round(short, 6) AS short, round(mid, 6) AS mid, round(long, 6) AS long FROM al"

ORACLES = {
    "week_diffs": with_ctes("SELECT user_pseudo_id, first_date, event_date, week_diff FROM diffs", "diffs"),
    "weekly_retention_visit": with_ctes("SELECT * FROM ret_visit", "ret_visit"),
    "weekly_retention_revisit_inflow": with_ctes("SELECT * FROM ret_inflow_revisit", "ret_inflow_revisit"),
    "weekly_retention_inflow": with_ctes("SELECT * FROM ret_inflow", "ret_inflow"),
    "cohort_retention": with_ctes("SELECT * FROM coh", "coh"),
    "cohort_retention_visit": with_ctes("SELECT * FROM coh_visit", "coh_visit"),
    "cohort_retention_inflow_week": with_ctes("SELECT * FROM coh_inflow", "coh_inflow"),
    "cohort_matrix_users": _matrix_sql("coh", USERS),
    "cohort_matrix_rate": _matrix_sql("coh", RATE, drop0=True),
    "cohort_matrix_rate_visit": _matrix_sql("coh_visit", RATE, drop0=True),
    **{
        f"cohort_matrix_{name}_{label}": _matrix_sql(source, value, f"user_segment = '{label}'", drop0=value == RATE)
        for source, labels in (("coh_visit", GROUPS), ("coh_inflow", sg.INFLOW_LABELS))
        for label in labels
        for name, value in (("users", USERS), ("rate", RATE))
    },
    "cohort_center_rate_median": _center_sql("coh", RATE, "median"),
    "cohort_center_visit_rate_median": _center_sql("coh_visit", RATE, "median"),
    "cohort_center_visit_rate_mean": _center_sql("coh_visit", RATE, "avg"),
    "cohort_center_visit_users_median": _center_sql("coh_visit", USERS, "median"),
    "cohort_center_visit_users_mean": _center_sql("coh_visit", USERS, "avg"),
    "cohort_center_inflow_rate_median": _center_sql("coh_inflow", RATE, "median"),
    "cohort_center_inflow_users_median": _center_sql("coh_inflow", USERS, "median"),
    "align_groups_rate_median": with_ctes(_ROUND_ALIGNED, "coh_visit", **aligned_sql(RATE, "median")),
    "align_groups_users_mean": with_ctes(_ROUND_ALIGNED, "coh_visit", **aligned_sql(USERS, "avg")),
    "order_rate_weekly_visit": with_ctes("SELECT * FROM rate_visit", "rate_visit"),
    "order_rate_weekly_inflow": with_ctes("SELECT * FROM rate_inflow", "rate_inflow"),
    "retention_order_rate": _rates("all"),
    "retention_order_rate_visit": _rates("visit"),
    "calendar_center_inflow": with_ctes(
        """SELECT user_segment, cohort_week + CAST(7 * week_diff AS INTEGER) AS calendar_week,
                  round(median(cohort_retention_rate), 6) AS cohort_retention_rate
           FROM coh_inflow GROUP BY 1, 2""",
        "coh_inflow",
    ),
    "retention_order_rate_inflow": _rates("inflow"),
}
