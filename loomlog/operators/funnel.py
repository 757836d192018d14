"""Open order funnel and per-user order counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.columns import USER, fraction

# The events of the funnel by step (1 visit, 2 explore, 3 cart, 4 pay).
FUNNEL = {
    1: ["home: screen_view"],
    2: [
        "home: click_food_category",
        "home: click_recommend_food",
        "home: click_restaurant_nearby",
        "home: click_search",
        "home: click_banner",
        "food_category: click_restaurant",
        "search: request_search",
        "search_result: click_restaurant",
        "restaurant: click_food",
    ],
    3: ["food_detail: click_cart", "cart: click_recommend_extra_food"],
    4: ["cart: click_payment"],
}
PAY_STEP = 4


def screen_event(log: DataFrame) -> DataFrame:
    """Add ``screen: event``; NULL when either part is NULL."""
    return log.withColumn("screen_event", F.concat("firebase_screen", F.lit(": "), "event_name"))


def _by_screen(keys: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for key in keys:
        screen, event = key.split(": ")
        out.setdefault(screen, []).append(event)
    return out


def _matches(keys: list[str]) -> Column:
    """Membership on the two stored columns, which the file scan can filter on."""
    hit = F.lit(False)
    for screen, events in _by_screen(keys).items():
        hit = hit | ((F.col("firebase_screen") == screen) & F.col("event_name").isin(*events))
    return hit


def _step(spec: dict[int, list[str]], as_bit: bool = False) -> Column:
    """Step number of an event (or the bit that stands for it), 0 for none."""
    step = F.lit(0)
    for number, keys in spec.items():
        step = F.when(_matches(keys), 1 << number if as_bit else number).otherwise(step)
    return step


def funnel_events(log: DataFrame, spec: dict[int, list[str]] = FUNNEL) -> DataFrame:
    return log.where(_matches([key for keys in spec.values() for key in keys]))


def funnel_steps(log: DataFrame, spec: dict[int, list[str]] = FUNNEL) -> DataFrame:
    """Funnel events with their key and step; 0 would mean no step."""
    return screen_event(funnel_events(log, spec)).withColumn("funnel_step", _step(spec))


def open_funnel(
    log: DataFrame, seg: DataFrame, digits: int | None = 3, spec: dict[int, list[str]] = FUNNEL
) -> DataFrame:
    """Users per segment and step, against users with any funnel event.

    Steps are not ordered in time. Each user's steps shrink to one small bit
    set before the segment join, so the shuffle carries one row per user and
    the counting needs no distinct.
    """
    steps = sorted(spec)
    bits = funnel_events(log, spec).groupBy(USER).agg(
        F.bit_or(_step(spec, as_bit=True)).alias("bits")
    )
    counts = (
        bits.join(seg, USER)
        .groupBy("user_segment")
        .agg(
            F.count("*").alias("tot_users"),
            *[F.count_if(F.col("bits").bitwiseAND(1 << k) > 0).alias(f"s{k}") for k in steps],
        )
    )
    pairs = ", ".join(f"{k}, s{k}" for k in steps)
    return (
        counts.select(
            "user_segment", "tot_users", F.expr(f"stack({len(steps)}, {pairs}) AS (funnel_step, funnel_users)")
        )
        .where("funnel_users > 0")
        .select(
            "user_segment", "funnel_step", "funnel_users", "tot_users",
            fraction(F.col("funnel_users"), F.col("tot_users"), digits).alias("conversion_rate"),
        )
    )


def order_counts(
    log: DataFrame, seg: DataFrame, base: str = "funnel", spec: dict[int, list[str]] = FUNNEL
) -> DataFrame:
    """Orders per user, zeros kept.

    ``base="funnel"`` covers users with any funnel event, ``base="all"`` every
    user of the log.
    """
    if base not in ("funnel", "all"):
        raise ValueError(f"base must be 'funnel' or 'all', got {base!r}")
    source = funnel_events(log, spec) if base == "funnel" else log
    paid = F.coalesce(_matches(spec[PAY_STEP]), F.lit(False))
    per_user = source.groupBy(USER).agg(F.count_if(paid).alias("order_cnt"))
    return per_user.join(seg, USER).select("user_segment", USER, "order_cnt")
