"""Running totals over groups of any size, and random keys, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.sources.tables import cut_lineage


def uniform(seed: int | str, *columns) -> Column:
    """Number in [0, 1) that depends only on the seed and the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a distinct number on every row, written so that the numbers stay."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def identified(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with ``_same``, so that ``key`` and ``_same`` together tell every row apart.

    Rows whose key is their own carry -1 and are read where they lie; only rows
    with a null or repeated key are numbered and written. The list of those keys
    is written first, so that the joins are planned by its real size.
    """
    again = df.groupBy(key).agg(F.count("*").alias("_n")).filter(f"_n > 1 or `{key}` is null")
    again = cut_lineage(again.select(F.col(key).alias("_again")))
    same = F.col(key).eqNullSafe(F.col("_again"))
    some = numbered(df.join(again, same, "left_semi"), "_same")
    return df.join(again, same, "left_anti").withColumn("_same", F.lit(-1).cast("long")).unionByName(some)


def same_row(key: str = "doc_id") -> Column:
    """Join condition of :func:`identified` rows with a table of (_id, _of)."""
    return F.col(key).eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_of"))


def without(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`identified` rows that are not in ``gone`` (``key``, _same). ``gone`` is
    written first: a short list goes to the rows, a long one is merged with them."""
    listed = cut_lineage(gone.select(F.col(key).alias("_id"), F.col("_same").alias("_of")).distinct())
    return rows.join(listed, same_row(key), "left_anti")


def running_totals(
    df: DataFrame, group: list[str], order: list[Column], value: str, out: str, row: str = "_row"
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows that come earlier in the group.

    ``df`` is plain data with distinct numbers in ``row`` (see :func:`numbered`);
    they settle ties. Rows are range partitioned by group, order and number, so a
    group of any size, and any number of equal keys, spreads over many tasks. A
    task sums its own piece; sums of pieces give the offsets. Empty input gives
    an empty result; null values count as zero.
    """
    piece = "_piece"
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in group], *order, F.col(row)).withColumn(piece, F.spark_partition_id())
    )
    keys = [piece, *group]
    amount = F.coalesce(F.col(value), F.lit(0))
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(F.col(piece).alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_offset")
    )
    inside = Window.partitionBy(*keys).orderBy(*order, row).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    on = F.col(piece) == F.col("_p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        local.join(offsets, on)
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_p", "_offset", "_local", piece, *[f"_g{i}" for i in range(len(group))])
    )
