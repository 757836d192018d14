"""Event logs made from the given ``events`` and ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, USER, clock_time, epoch_micros, iso_dow, local_datetime, week_start
from loomlog.operators.preparation import analysis_target, pivot_params
from loomlog.operators.orders import holidays
from loomlog.operators.segments import inflow_segments, visit_segments
from loomlog.operators.userdays import SPAN, store_rows
from loomlog.sources.tables import stored, stored_bucketed

TIME_ZONE = "Asia/Seoul"

# Segment cuts and holiday thresholds that suit the given tables.
EVENTS_HOLIDAY = 40
ORDERS_HOLIDAY = 30
ORDERS_CUTS = (90, 240)


# Declared, so that no job has to look into the files for the schema.
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
ORDERS_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(ORDERS_SCHEMA).parquet(f"{sf_dir}/orders.parquet")


def nest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a nested log, one row per event."""
    kind, k = F.col("event_type"), F.col("k")
    screen = (
        F.when(kind == "view", F.when(k % 3 == 1, "restaurant").otherwise("home"))
        .when(kind == "click", F.when(k % 3 == 1, "restaurant").otherwise("home"))
        .when(kind == "signup", F.when(k % 3 == 2, "cart").otherwise("food_detail"))
        .when(kind == "purchase", "cart")
        .otherwise("welcome")
    )
    name = (
        F.when(
            kind == "click",
            F.when(k % 3 == 0, "click_banner").when(k % 3 == 1, "click_food").otherwise("click_search"),
        )
        .when(kind == "signup", F.when(k % 3 == 2, "click_recommend_extra_food").otherwise("click_cart"))
        .when(kind == "purchase", "click_payment")
        .otherwise("screen_view")
    )
    session = F.concat_ws(
        "-",
        "user_pseudo_id",
        F.replace(F.to_date("local").cast("string"), F.lit("-"), F.lit("")),
        F.floor(F.hour("local") / 6).cast("string"),
    )
    member = (F.col("user_id") % 20 != 0) & (kind != "error")
    # Separate steps: each parsed or converted value is computed once per row.
    ev = (
        spark.read.schema(EVENTS_SCHEMA)
        .parquet(f"{sf_dir}/events.parquet")
        .select(
            "ts", "user_id", "event_type",
            epoch_micros(F.col("ts")).alias("event_timestamp"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("user_pseudo_id"),
        )
        .withColumn("local", local_datetime(F.col("event_timestamp"), TIME_ZONE))
        .withColumns({"screen": screen, "event_name": name, "session": session})
    )

    def param(key, text, number):
        value = F.struct(text.cast("string").alias("string_value"), number.cast("bigint").alias("int_value"))
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    base = [
        param("firebase_screen", F.col("screen"), F.lit(None)),
        param("session_id", F.col("session"), F.lit(None)),
    ]
    params = F.when(kind == "click", F.array(*base, param("food_id", F.lit(None), k))).otherwise(F.array(*base))
    return ev.select(
        F.to_date("ts").alias("event_date"),
        "event_timestamp",
        "event_name",
        params.alias("event_params"),
        F.when(member, F.col("user_id")).alias("user_id"),
        "user_pseudo_id",
        F.when(F.col("user_id") % 2 == 0, "IOS").otherwise("ANDROID").alias("platform"),
    )


def nest_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table as a nested log: every line is a delivery of its order's event, so lines merge."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def param(key, text, number):
        value = F.struct(text.cast("string").alias("string_value"), number.cast("bigint").alias("int_value"))
        return F.struct(key.alias("key"), value.alias("value"))

    return lines.select(
        (F.col("l_orderkey") % 1000 * 86_400_000_000).alias("event_timestamp"),
        F.concat(F.lit("line_"), "l_linestatus").alias("event_name"),
        F.array(
            param(F.concat(F.lit("flag_"), "l_returnflag"), F.col("l_linenumber"), F.lit(None)),
            param(F.lit("quantity"), F.lit(None), F.col("l_quantity")),
            param(F.lit("supplier"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit(None)),
        ).alias("event_params"),
        F.col("l_orderkey").alias("user_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("user_pseudo_id"),
    )


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested raw log, stored by date as an app would deliver it."""
    return stored(spark, "raw", sf_dir, lambda: nest_events(spark, sf_dir), partition="event_date")


def events_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat log with one text column per parameter, stored by date."""
    return stored(
        spark, "cleaned", sf_dir,
        lambda: pivot_params(events_raw(spark, sf_dir), None, TIME_ZONE),
        partition="event_date", settings=(TIME_ZONE,),
    )


def events_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned log of member devices, stored by date."""
    return stored(
        spark, "target", sf_dir,
        lambda: analysis_target(events_cleaned(spark, sf_dir)),
        partition="event_date", settings=(TIME_ZONE,),
    )


def flat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat log in which every order is one event of its customer."""
    orders = orders_table(spark, sf_dir)
    rank = F.substring("o_orderpriority", 1, 1)
    screen = (
        F.when(rank == "1", "cart").when(rank == "2", "food_detail").when(rank == "3", "restaurant")
        .when(rank == "4", "home").otherwise("search_result")
    )
    name = (
        F.when(rank == "1", "click_payment").when(rank == "2", "click_cart").when(rank == "3", "click_food")
        .otherwise("screen_view")
    )
    day = F.to_date("o_orderdate")
    return orders.select(
        F.col("o_orderdate").alias("event_datetime"),
        day.alias("event_date"),
        clock_time(F.col("o_orderdate")).alias("event_time"),
        week_start(day).alias("event_week"),
        iso_dow(day).alias("event_dow"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_pseudo_id"),
        F.col("o_custkey").alias("user_id"),
        name.alias("event_name"),
        screen.alias("firebase_screen"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`flat_orders`, stored in files by range of date; event names are plain values there."""
    return stored(spark, "orders_log", sf_dir, lambda: flat_orders(spark, sf_dir), order=(DAY, "event_name"))


def events_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-day store of the member devices, by month."""
    build = lambda: store_rows(events_target(spark, sf_dir))
    return spark.table(stored_bucketed(spark, "events_days", sf_dir, build, USER, [USER, DAY], SPAN, (TIME_ZONE,)))


def orders_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-day store of the customers, by year."""
    build = lambda: store_rows(orders_log(spark, sf_dir), "year")
    return spark.table(stored_bucketed(spark, "orders_days", sf_dir, build, USER, [USER, DAY], SPAN))


def orders_visit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit segment of every customer, stored and bucketed like the store: one row per user."""
    build = lambda: visit_segments(orders_days(spark, sf_dir), *ORDERS_CUTS)
    return spark.table(stored_bucketed(spark, "visit_seg", sf_dir, build, USER, [USER], settings=ORDERS_CUTS))


def orders_inflow_day(spark: SparkSession, sf_dir: str, base: str = "all") -> DataFrame:
    return inflow_segments(orders_days(spark, sf_dir), holidays(orders_log(spark, sf_dir), ORDERS_HOLIDAY), "day", base)


def orders_inflow_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week, with the holidays counted by device."""
    days = orders_days(spark, sf_dir)
    return inflow_segments(days, holidays(days, ORDERS_HOLIDAY, USER), "week")


def stored_inflow(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Inflow map ``day``, ``revisit_day`` or ``week``, stored and bucketed: one row per user."""
    build = {
        "day": lambda: orders_inflow_day(spark, sf_dir),
        "revisit_day": lambda: orders_inflow_day(spark, sf_dir, "revisit"),
        "week": lambda: orders_inflow_week(spark, sf_dir),
    }[kind]
    return spark.table(stored_bucketed(spark, f"inflow_{kind}", sf_dir, build, USER, [USER], settings=(ORDERS_HOLIDAY,)))
