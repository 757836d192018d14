"""From the nested raw log to the flat log of member devices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, USER, clock_time, iso_dow, local_datetime, week_start
from loomlog.sources.tables import cut_lineage

DEFAULT_TZ = "Asia/Seoul"
_ATTRIBUTES = ("event_datetime", USER, "user_id", "event_name")
_TIME_COLUMNS = ("event_datetime", "event_date", "event_time", "event_week", "event_dow")


def param_key_table(raw: DataFrame) -> DataFrame:
    """Distinct parameter keys. Reads only the key field of the nested column."""
    return (
        raw.select(F.explode("event_params.key").alias("param_key"))
        .where(F.col("param_key").isNotNull())
        .distinct()
    )


def param_keys(raw: DataFrame) -> list[str]:
    """The keys as a sorted list; they become column names, so they are few."""
    return sorted(row["param_key"] for row in param_key_table(raw).collect())


def _time_columns(local: Column) -> list[Column]:
    day = F.to_date(local)
    return [
        day.alias("event_date"),
        clock_time(local).alias("event_time"),
        week_start(day).alias("event_week"),
        iso_dow(day).alias("event_dow"),
    ]


def enrich_time(df: DataFrame, ts_us: str = "event_timestamp", tz: str = DEFAULT_TZ) -> DataFrame:
    """Add local datetime, date, clock time, Monday week and ISO weekday."""
    local = df.withColumn("event_datetime", local_datetime(F.col(ts_us), tz))
    kept = [c for c in df.columns if c not in _TIME_COLUMNS]
    return local.select(*kept, "event_datetime", *_time_columns(F.col("event_datetime")))


def merged_params(raw: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """One row per event with ``params``, the map from parameter key to text, before any key is known.

    Events with equal attributes are one event, and of several values for a key the
    largest stays. An event is one row on its way into the one shuffle; only behind
    it, in sorted runs, are parameters taken apart, brought down to one per key and
    collected again. A map has one entry per key. Events without parameters drop
    out, as in an inner unnest; a parameter without a key leaves its event.
    """
    text = F.transform("event_params", lambda p: F.struct(
        p["key"].alias("key"),
        F.coalesce(p["value"]["string_value"], p["value"]["int_value"].cast("string")).alias("text")))
    events = raw.where(F.size("event_params") > 0).select(
        local_datetime(F.col("event_timestamp"), tz).alias("event_datetime"), USER, "user_id", "event_name", text.alias("list"))
    single = events.repartition(*_ATTRIBUTES).select(*_ATTRIBUTES, F.inline("list"))
    largest = single.groupBy(*_ATTRIBUTES, "key").agg(F.max("text").alias("text"))
    entry = F.when(F.col("key").isNotNull(), F.struct("key", "text"))
    return largest.groupBy(*_ATTRIBUTES).agg(F.map_from_entries(F.collect_list(entry)).alias("params"))


def lay_out(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One text column per key of :func:`merged_params`; keys that are not named are left out."""
    return events.select(
        "event_datetime", *_time_columns(F.col("event_datetime")), USER, "user_id", "event_name",
        *[F.try_element_at("params", F.lit(k)).alias(k) for k in sorted(keys)],
    )


def pivot_params(raw: DataFrame, keys: Sequence[str] | None = None, tz: str = DEFAULT_TZ) -> DataFrame:
    """One text column per parameter key.

    The log is read once: its merged events are written, and without given ``keys``
    those found in their maps become the columns. Given ``keys`` select the columns
    and need no stored table. See :func:`merged_params` for what becomes of repeated
    keys and events.
    """
    events = merged_params(raw, tz)
    if keys is None:
        events = cut_lineage(events)
        keys = [r[0] for r in events.select(F.explode(F.map_keys("params"))).distinct().collect()]  # column names: few
    return lay_out(events, keys)


def cast_params(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Retype parameter columns; text that does not parse becomes NULL."""
    return df.withColumns({name: F.col(f"`{name}`").try_cast(kind) for name, kind in types.items()})


def user_mapping(log: DataFrame) -> DataFrame:
    """Distinct (user_id, device) pairs with the kind of user."""
    kind = F.when(F.col("user_id").isNull(), "anonymous_user").otherwise("identified_user")
    return log.select("user_id", USER).distinct().withColumn("user_type", kind)


def device_classes(log: DataFrame) -> DataFrame:
    """Per device: seen before login, after login, or both."""
    anonymous, identified = F.bool_or(F.col("user_id").isNull()), F.bool_or(F.col("user_id").isNotNull())
    return (
        log.groupBy(USER)
        .agg(anonymous.alias("a"), identified.alias("i"))
        .select(
            USER,
            F.when(F.col("a") & F.col("i"), "both")
            .when(F.col("i"), "identified_only")
            .otherwise("anonymous_only")
            .alias("device_class"),
        )
    )


def anonymous_devices(log: DataFrame) -> DataFrame:
    """Devices without a single identified event."""
    return log.groupBy(USER).agg(F.count("user_id").alias("n")).where("n = 0").select(USER)


def analysis_target(log: DataFrame) -> DataFrame:
    """Drop anonymous-only devices.

    The list of those devices is written first, one column. Its size is known
    when the join is planned: a short list is sent to the log and the log stays
    where it is, a long one is merged with it, and a device with very many rows
    is then split by the adaptive skew join.
    """
    guests = cut_lineage(anonymous_devices(log))
    return log.join(guests, USER, "left_anti")


def uncovered_devices(log: DataFrame, *sets: DataFrame) -> DataFrame:
    """Mapping rows outside the union of the given device sets."""
    pairs = log.select("user_id", USER).distinct()
    union = sets[0].select(USER)
    for other in sets[1:]:
        union = union.union(other.select(USER))
    return pairs.join(union.distinct(), USER, "left_anti").select("user_id", USER)


def behaviour_profile(log: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct screen and event pairs of the given devices."""
    seen = log.select(USER, "firebase_screen", "event_name").distinct()
    return seen.join(users.select(USER), USER, "left_semi").select("firebase_screen", "event_name").distinct()


def schema_report(df: DataFrame) -> DataFrame:
    """One row: the ordered columns as indented JSON."""
    columns = F.array(
        *[
            F.struct(
                F.lit("NULLABLE" if f.nullable else "REQUIRED").alias("mode"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
            )
            for f in df.schema.fields
        ]
    )
    return df.sparkSession.range(1).select(F.to_json(columns, {"pretty": "true"}).alias("schema"))


def preview(log: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows; pass ``order_by`` for a repeatable choice."""
    return (log.orderBy(*order_by) if order_by else log).limit(n)


def record_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("records"))


def period_span(log: DataFrame) -> DataFrame:
    """First date, last date and the days between."""
    return log.agg(F.min(DAY).alias("start_date"), F.max(DAY).alias("end_date")).withColumn(
        "day_diff", F.datediff("end_date", "start_date")
    )


def event_list(log: DataFrame) -> DataFrame:
    return log.select(F.col("event_name").alias("event_list")).distinct()
