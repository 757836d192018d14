"""User segments: by visit interval and by the day or week of the first visit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.columns import DAY, USER, broadcast_days, percent, week_start
from loomlog.operators.userdays import user_days

# Segment labels.
VISIT_LABELS = ("one_day", "short", "mid", "long")
REVISIT_LABELS = ("short", "mid", "long")
INFLOW_LABELS = ("holiday", "normal_day")


def revisit_split(log: DataFrame) -> DataFrame:
    """Users seen on one day only against all others."""
    days = user_days(log).groupBy(USER).agg(F.count("*").alias("n"))
    return days.select(USER, F.when(F.col("n") == 1, "one_day").otherwise("revisit").alias("user_segment"))


def visit_segments(log: DataFrame, short: int = 14, mid: int = 30) -> DataFrame:
    """one_day, short, mid or long: the most frequent class of a user's gaps.

    If classes share first place, the class of the latest gap decides, even
    when it is not one of them. The window and the grouping both work by user,
    so they share one shuffle of the user-day base.
    """
    gap = F.datediff(DAY, F.lag(DAY).over(Window.partitionBy(USER).orderBy(DAY)))
    gaps = user_days(log).withColumn("gap", gap)
    cls = F.when(F.col("gap") <= short, "short").when(F.col("gap") <= mid, "mid").otherwise("long")
    per_user = (
        gaps.groupBy(USER)
        .agg(
            F.count("gap").alias("gaps"),
            F.count_if(F.col("gap") <= short).alias("short"),
            F.count_if((F.col("gap") > short) & (F.col("gap") <= mid)).alias("mid"),
            F.count_if(F.col("gap") > mid).alias("long"),
            # rows arrive sorted by user from the window, so this streams
            F.max(F.struct(DAY, "gap"))["gap"].alias("gap"),
        )
        .withColumn("top", F.greatest("short", "mid", "long"))
    )
    at_top = [(F.col(name) == F.col("top")).cast("int") for name in REVISIT_LABELS]
    mode = (
        F.when(F.col("short") == F.col("top"), "short").when(F.col("mid") == F.col("top"), "mid").otherwise("long")
    )
    label = (
        F.when(F.col("gaps") == 0, "one_day").when(at_top[0] + at_top[1] + at_top[2] == 1, mode).otherwise(cls)
    )
    return per_user.select(USER, label.alias("user_segment"))


def with_revisit(seg: DataFrame) -> DataFrame:
    """Collapse short, mid and long to revisit."""
    label = F.when(F.col("user_segment") == "one_day", "one_day").otherwise("revisit")
    return seg.select(USER, label.alias("user_segment"))


def only(seg: DataFrame, labels: Sequence[str]) -> DataFrame:
    return seg.where(F.col("user_segment").isin(*labels))


def segment_sizes(seg: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row: users per named group of segment labels (one map row per user)."""
    return seg.agg(
        *[F.count_if(F.col("user_segment").isin(*labels)).alias(name) for name, labels in groups.items()]
    )


def _chain(label: str, parents: Mapping[str, str]) -> list[tuple[str, str]]:
    """(node, parent) from a label up to the root, which is written as an empty string."""
    chain, node = [], label
    while node != "":
        if len(chain) > len(parents):
            raise ValueError(f"the parents of {label!r} lead back to it")
        above = parents.get(node, "")
        chain.append((node, above))
        node = above
    return chain


def segment_shares(seg: DataFrame, parents: Mapping[str, str] | None = None) -> DataFrame:
    """Users per node of a share tree, with the percentage of the parent's total.

    ``parents`` names the parent of a label or of another parent, to any depth; a
    label without one hangs below the root, written as an empty string. Users
    are counted by label once; each count then goes to its label and all that
    stands above it, and one grouping by node adds up the whole tree. Nodes
    without users have no row; a circle of parents raises.
    """
    parents = dict(parents or {})
    counts = seg.groupBy(F.col("user_segment").alias("leaf")).agg(F.count("*").alias("n"))
    chain = F.array(F.struct(F.col("leaf").alias("label"), F.lit("").alias("parent")))
    for leaf in parents:
        steps = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(p).alias("parent")) for n, p in _chain(leaf, parents)])
        chain = F.when(F.col("leaf") == leaf, steps).otherwise(chain)
    nodes = counts.select("n", F.inline(chain)).groupBy("label", "parent").agg(F.sum("n").alias("users"))
    whole = F.sum("users").over(Window.partitionBy("parent"))  # one row per node
    return nodes.select("label", "parent", "users", percent(F.col("users"), whole).alias("percent_of_parent"))


def inflow_segments(log: DataFrame, hol: DataFrame, by: str = "day", base: str = "all") -> DataFrame:
    """holiday if the user's first day (or its week) is a holiday, else normal_day.

    ``base="revisit"`` keeps users seen on more than one day. Holidays are a
    table by date, so joining them never shuffles the users.
    """
    users = user_days(log).groupBy(USER).agg(F.min(DAY).alias("first_date"), F.count("*").alias("n"))
    if base == "revisit":
        users = users.where("n > 1")
    elif base != "all":
        raise ValueError(f"base must be 'all' or 'revisit', got {base!r}")
    if by == "day":
        key = F.col("first_date")
        marks = hol.select(F.col("holiday_date").alias("k")).distinct()
    elif by == "week":
        key = week_start(F.col("first_date"))
        marks = hol.select(F.col("holiday_week").alias("k")).distinct()
    else:
        raise ValueError(f"by must be 'day' or 'week', got {by!r}")
    marked = users.withColumn("k", key).join(broadcast_days(marks.withColumn("hit", F.lit(True))), "k", "left")
    label = F.when(F.col("hit"), "holiday").otherwise("normal_day")
    return marked.select(USER, label.alias("user_segment"))
