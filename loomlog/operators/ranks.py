"""Average ranks from one stored value index, without sorting raw rows in one place.

Rows are first counted by value, which also merges any value shared by a large
part of the rows, and that histogram is written once. Ranks follow from running
totals over it: inside ranges of values, plus the totals of the ranges before.
Where the groups are named, the index keeps a running total of each, so the ranks
within any selection of them, a pair for instance, need nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.sources.tables import cut_lineage

PIECE_ROWS = 1_000_000  # distinct values that one task brings into order


def value_histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per value and keys; NULL values take no rank."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def _placed(hist: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The histogram as plain data, each row with the number of the range of values it is in.

    Its own size decides how many ranges there are; one holds a histogram of up to
    ``PIECE_ROWS`` rows. Ranges are cut by a range partitioning and written, so that
    all that is derived from them agrees; equal values share a range.
    """
    plain = cut_lineage(hist)
    pieces = -(-plain.count() // PIECE_ROWS)
    if pieces <= 1:
        return plain.withColumn("piece", F.lit(0))
    ranged = plain.repartitionByRange(pieces, *by, value).withColumn("piece", F.spark_partition_id())
    return cut_lineage(ranged)


def _running(placed: DataFrame, value: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``below_<c>`` for each column: its sum over all smaller values, and ``total_<c>``: over all."""
    by = list(by)
    before = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = placed.groupBy(*by, "piece").agg(*[F.sum(c).alias(f"sum_{c}") for c in columns])
    offsets = sums.select(
        *by, "piece",
        *[F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in columns],
        *[F.sum(f"sum_{c}").over(whole).alias(f"total_{c}") for c in columns],
    )
    smaller = Window.partitionBy(*by, "piece").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy(*by, "piece", value)
    # equal values share a range, so both windows work on the same layout
    local = placed.withColumns({f"at_{c}": F.sum(c).over(level) for c in columns} | {
        f"upto_{c}": F.sum(c).over(smaller) for c in columns})
    below = {f"below_{c}": F.col(f"upto_{c}") - F.col(f"at_{c}") + F.col(f"before_{c}") for c in columns}
    joined = local.join(offsets, [*by, "piece"]).withColumns(below)
    return joined.drop("piece", *[f"{p}_{c}" for c in columns for p in ("upto", "before")])


def rank_histogram(hist: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add to each histogram row: ``total`` rows, ``ties`` sharing the value,
    and the average ranks ``rank_asc`` and ``rank_desc``.

    ``by`` holds keys that are ranked separately. Other columns of ``hist``
    (a group) share the ranking. What ``hist`` is made from is read once.
    """
    ranked = _running(_placed(hist, value, by), value, by, ["n"])
    return ranked.withColumns({
        "total": F.col("total_n"),
        "ties": F.col("at_n"),
        "rank_asc": F.col("below_n") + (F.col("at_n") + 1) / 2,
        "rank_desc": F.col("total_n") - F.col("below_n") - (F.col("at_n") - 1) / 2,
    }).drop("total_n", "at_n", "below_n")


def avg_ranks(
    df: DataFrame, value: str, desc: bool = True, by: Sequence[str] = (), name: str = "avg_rank"
) -> DataFrame:
    """Add each row's average rank (ties share the mean of their places).

    Ranks come back to the rows by an equality join on the value; a value held
    by a large part of the rows is split by the adaptive skew join.
    """
    by = list(by)
    ranks = rank_histogram(value_histogram(df, value, by), value, by)
    ranks = ranks.select(*by, value, F.col("rank_desc" if desc else "rank_asc").alias(name))
    return df.join(ranks, [*by, value], "left").select(*df.columns, name)


def mean_ranks(
    df: DataFrame, group: str, value: str, desc: bool = True
) -> DataFrame:
    """Mean of the shared average ranks within each group."""
    rank = F.col("rank_desc" if desc else "rank_asc")
    ranks = rank_histogram(value_histogram(df, value, [group]), value)
    return ranks.groupBy(group).agg(
        F.sum("n").alias("n"), (F.sum(rank * F.col("n")) / F.sum("n")).alias("mean_rank")
    )


def rank_sums(hist: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: size, size of all groups, ascending rank sum, share of sum(t^3 - t).

    ``hist`` comes from :func:`value_histogram` with ``group`` as key.
    A tie class of t rows adds (t^2 - 1) for each of its rows; doubles, because
    t^3 leaves the 64-bit range at 2 million.
    """
    ranks = rank_histogram(hist, value)
    t = F.col("ties").cast("double")
    return ranks.groupBy(group).agg(
        F.sum("n").alias("n"),
        F.max("total").alias("total"),
        F.sum(F.col("rank_asc") * F.col("n")).alias("rank_sum"),
        F.sum((t * t - 1) * F.col("n")).alias("tie_sum"),
    )


def group_index(df: DataFrame, value: str, group: str, groups: Sequence[str]) -> DataFrame:
    """One row per value: for the i-th of ``groups``, ``n<i>`` rows at the value and ``below_n<i>`` under it.

    Rows of other groups and NULL values are left out. The counts of all groups
    come from one grouping, so ``df`` is read once, whatever is asked afterwards.
    """
    sample = df.where(F.col(value).isNotNull() & F.col(group).isin(*groups))
    names = [f"n{i}" for i in range(len(groups))]
    wide = sample.groupBy(value).agg(*[F.count_if(F.col(group) == g).alias(c) for g, c in zip(groups, names)])
    return _running(_placed(wide, value, ()), value, (), names)


def _sums_within(selected: Sequence[int], labels: Sequence[Column]) -> list[Column]:
    """One struct per selected group: its rank sum and sizes when only these groups are ranked together."""
    t = sum((F.col(f"n{i}") for i in selected[1:]), F.col(f"n{selected[0]}"))
    rank = sum((F.col(f"below_n{i}") for i in selected[1:]), F.col(f"below_n{selected[0]}")) + (t + 1) / 2
    ties = t.cast("double")
    total = F.sum(t)
    return [F.struct(
        *labels, F.lit(i).alias("place"), F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("n"), F.coalesce(total, F.lit(0)).alias("total"),
        F.sum(rank * F.col(f"n{i}")).alias("rank_sum"),
        F.sum((ties * ties - 1) * F.col(f"n{i}")).alias("tie_sum"),
    ) for i in selected]


def _one_row(index: DataFrame, structs: list[Column], group: str, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """All sums in one aggregation, a row per struct; groups without rows have none."""
    rows = index.agg(F.array(*structs).alias("s")).select(F.inline("s")).where("n > 0")
    name = F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("place") + 1).alias(group)
    return rows.select(*keys, name, "n", "total", "rank_sum", "tie_sum")


def named_rank_sums(df: DataFrame, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """:func:`rank_sums` of the named groups, ranked together."""
    index = group_index(df, value, group, groups)
    return _one_row(index, _sums_within(range(len(groups)), []), group, groups, [])


def pair_rank_sums(df: DataFrame, group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """:func:`rank_sums` for every pair of the named groups, with ``group_a`` and ``group_b``.

    All pairs read the same index; ranks within a pair are sums of its two columns.
    """
    index = group_index(df, value, group, groups)
    structs = []
    for a, b in combinations(range(len(groups)), 2):
        structs += _sums_within([a, b], [F.lit(groups[a]).alias("group_a"), F.lit(groups[b]).alias("group_b")])
    return _one_row(index, structs, group, groups, ["group_a", "group_b"])
