"""The four stored tables of the analysis, each built from the one before.

Every step ends in a written table, so later jobs start from files and an
executor lost in a later step costs nothing of an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.operators.orders import holidays, order_segments
from loomlog.operators.preparation import DEFAULT_TZ, analysis_target, pivot_params
from loomlog.operators.segments import visit_segments
from loomlog.sources.tables import read_table, write_table


def build_cleaned(raw: DataFrame, target: str, tz: str = DEFAULT_TZ) -> None:
    """Flat log partitioned by local date."""
    write_table(pivot_params(raw, tz=tz), target)


def build_target(spark: SparkSession, cleaned: str, target: str) -> None:
    """Log of member devices partitioned by local date."""
    write_table(analysis_target(read_table(spark, cleaned)), target)


def build_visit_segments(spark: SparkSession, log: str, target: str, short: int = 14, mid: int = 30) -> None:
    """Visit segment per user."""
    write_table(visit_segments(read_table(spark, log), short, mid), target, partition=None)


def build_order_segments(spark: SparkSession, log: str, target: str, threshold: float = 30) -> None:
    """Visit and order day counts per user."""
    events = read_table(spark, log)
    write_table(order_segments(events, holidays(events, threshold)), target, partition=None)
