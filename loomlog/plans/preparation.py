"""Preparation queries on the events log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import preparation as prep
from loomlog.plans.oracle import with_ctes
from loomlog.sources import adapters
from loomlog.sources.tables import read_table, table_path, write_table

# The columns of the flat log.
_LOG_COLUMNS = (
    "event_datetime", "event_date", "event_time", "event_week", "event_dow", "user_pseudo_id", "user_id",
    "event_name", "firebase_screen", "food_id", "session_id",
)


def _pivot(spark, d):
    return prep.pivot_params(adapters.events_raw(spark, d))


def _pivot_lines(spark, d):
    return prep.pivot_params(adapters.nest_lineitem(spark, d), tz="UTC")


def _enrich(spark, d):
    raw = adapters.events_raw(spark, d).drop("event_params")
    return prep.enrich_time(raw)


def _written(spark, d):
    """Rows per date directory of a freshly written target table."""
    target = adapters.events_target(spark, d)
    path = table_path(spark, "target-copy", d)
    write_table(target, path)
    return read_table(spark, path, target.schema).groupBy("event_date").agg(F.count("*").alias("records"))


def _uncovered(spark, d):
    log = adapters.events_cleaned(spark, d)
    classes = prep.device_classes(log)
    every = ["both", "identified_only", "anonymous_only"]
    return prep.uncovered_devices(log, classes.where(F.col("device_class").isin(every)))


def _uncovered_some(spark, d):
    """With the anonymous-only devices left out of the sets."""
    log = adapters.events_cleaned(spark, d)
    classes = prep.device_classes(log)
    return prep.uncovered_devices(log, classes.where(F.col("device_class").isin("both", "identified_only")))


def _profile(spark, d):
    log = adapters.events_cleaned(spark, d)
    return prep.behaviour_profile(log, prep.anonymous_devices(log))


def _preview(spark, d):
    order = ["event_datetime", "user_pseudo_id", "event_name", "user_id"]
    return prep.preview(adapters.events_target(spark, d).select(*_LOG_COLUMNS), 10, order)


QUERIES = {
    "param_keys": lambda s, d: prep.param_key_table(adapters.events_raw(s, d)),
    "pivot_params": _pivot,
    "pivot_params_merging": _pivot_lines,
    "enrich_time": _enrich,
    "write_target_by_date": _written,
    "cast_params": lambda s, d: prep.cast_params(
        adapters.events_cleaned(s, d), {"food_id": "bigint"}
    ).select(*_LOG_COLUMNS),
    "user_mapping": lambda s, d: prep.user_mapping(adapters.events_cleaned(s, d)),
    "device_classes": lambda s, d: prep.device_classes(adapters.events_cleaned(s, d)),
    "analysis_target": lambda s, d: prep.analysis_target(adapters.events_cleaned(s, d)).select(*_LOG_COLUMNS),
    "uncovered_devices": _uncovered,
    "uncovered_devices_some": _uncovered_some,
    "anonymous_behaviour": _profile,
    "preview": _preview,
    "record_count": lambda s, d: prep.record_count(adapters.events_target(s, d)),
    "period_span": lambda s, d: prep.period_span(adapters.events_target(s, d)),
    "event_list": lambda s, d: prep.event_list(adapters.events_target(s, d)),
}

_ALL = ", ".join(_LOG_COLUMNS)

ORACLES = {
    "param_keys": with_ctes("SELECT DISTINCT p.key AS param_key FROM ev_params", "ev_params"),
    "pivot_params": with_ctes(f"SELECT {_ALL} FROM clean", "clean"),
    "pivot_params_merging": """
        SELECT dt AS event_datetime, CAST(dt AS DATE) AS event_date, '00:00:00.000000' AS event_time,
               CAST(date_trunc('week', dt) AS DATE) AS event_week, CAST(isodow(dt) AS INTEGER) AS event_dow,
               'o' || l_orderkey AS user_pseudo_id, l_orderkey AS user_id, 'line_' || l_linestatus AS event_name,
               flag_A, flag_N, flag_R, quantity, supplier
        FROM (SELECT TIMESTAMP '1970-01-01' + to_days(CAST(l_orderkey % 1000 AS INTEGER)) AS dt, l_orderkey, l_linestatus,
                     max(CAST(l_linenumber AS VARCHAR)) FILTER (l_returnflag = 'A') AS flag_A,
                     max(CAST(l_linenumber AS VARCHAR)) FILTER (l_returnflag = 'N') AS flag_N,
                     max(CAST(l_linenumber AS VARCHAR)) FILTER (l_returnflag = 'R') AS flag_R,
                     max(CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)) AS quantity, max('s' || l_suppkey) AS supplier
              FROM lineitem GROUP BY ALL)""",
    "enrich_time": with_ctes(
        """SELECT epoch_us(ts) AS event_timestamp, split_part(pair, ': ', 2) AS event_name, uid AS user_id,
                  device AS user_pseudo_id,
                  CASE WHEN CAST(substr(device, 2) AS BIGINT) % 2 = 0 THEN 'IOS' ELSE 'ANDROID' END AS platform,
                  dt AS event_datetime, CAST(dt AS DATE) AS event_date,
                  strftime(dt, '%H:%M:%S.%f') AS event_time,
                  CAST(date_trunc('week', dt) AS DATE) AS event_week, CAST(isodow(dt) AS INTEGER) AS event_dow
           FROM ev_named""",
        "ev_named",
    ),
    "write_target_by_date": with_ctes("SELECT event_date, count(*) AS records FROM ev GROUP BY 1", "ev"),
    "cast_params": with_ctes(f"SELECT * REPLACE (TRY_CAST(food_id AS BIGINT) AS food_id) FROM clean", "clean"),
    "user_mapping": with_ctes(
        """SELECT DISTINCT user_id, user_pseudo_id,
                  CASE WHEN user_id IS NULL THEN 'anonymous_user' ELSE 'identified_user' END AS user_type
           FROM clean""",
        "clean",
    ),
    "device_classes": with_ctes(
        """SELECT user_pseudo_id, 'anonymous_only' AS device_class FROM guests
           UNION ALL
           SELECT user_pseudo_id, 'both' FROM members
           WHERE user_pseudo_id IN (SELECT user_pseudo_id FROM clean WHERE user_id IS NULL)
           UNION ALL
           SELECT user_pseudo_id, 'identified_only' FROM members
           WHERE user_pseudo_id NOT IN (SELECT user_pseudo_id FROM clean WHERE user_id IS NULL)""",
        "guests",
    ),
    "analysis_target": with_ctes(f"SELECT {_ALL} FROM ev", "ev"),
    "uncovered_devices": with_ctes(
        """SELECT DISTINCT user_id, user_pseudo_id FROM clean
           WHERE user_pseudo_id NOT IN (SELECT user_pseudo_id FROM members
                                        UNION SELECT user_pseudo_id FROM guests)""",
        "guests",
    ),
    "uncovered_devices_some": with_ctes(
        """SELECT DISTINCT user_id, user_pseudo_id FROM clean
           WHERE user_pseudo_id NOT IN (SELECT user_pseudo_id FROM members)""",
        "members",
    ),
    "anonymous_behaviour": with_ctes(
        """SELECT DISTINCT firebase_screen, event_name FROM clean
           WHERE user_pseudo_id IN (SELECT user_pseudo_id FROM guests)""",
        "guests",
    ),
    "preview": with_ctes(
        f"""SELECT {_ALL} FROM ev ORDER BY event_datetime, user_pseudo_id, event_name, user_id NULLS FIRST LIMIT 10""",
        "ev",
    ),
    "record_count": with_ctes("SELECT count(*) AS records FROM ev", "ev"),
    "period_span": with_ctes(
        """SELECT min(event_date) AS start_date, max(event_date) AS end_date,
                  CAST(max(event_date) - min(event_date) AS INTEGER) AS day_diff FROM ev""",
        "ev",
    ),
    "event_list": with_ctes("SELECT DISTINCT event_name AS event_list FROM ev", "ev"),
}
