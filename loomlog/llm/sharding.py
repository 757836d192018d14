"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.running import running_totals, uniform
from loomlog.sources.tables import cut_lineage


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, marked: Column, draws: Column, chance: Column) -> Column:
    """Number of marked ones among ``draws`` of ``population``, by inversion of ``chance``.

    Weights follow from their neighbours' ratio over 12 deviations (and 12 more
    steps) around the mode; what lies beyond is below double precision.
    """
    low = F.greatest(F.lit(0), draws + marked - population)
    high = F.least(marked, draws)
    mode = F.floor((draws + 1.0) * (marked + 1.0) / (population + 2.0))
    share = marked / F.greatest(population, F.lit(1))
    deviation = F.sqrt(draws * share * (F.lit(1.0) - share) * (population - draws) / F.greatest(population - 1, F.lit(1)))
    reach = F.ceil(deviation * 12) + 12
    start = F.struct(
        population.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("d"),
        F.greatest(low, mode - reach).cast("long").alias("a"), F.least(high, mode + reach).cast("long").alias("b"),
        chance.alias("u"),
    )

    def draw(s: Column) -> Column:
        def next_weight(weight: Column, x: Column) -> Column:
            up = (s["k"] - x) * (s["d"] - x)
            down = (x + 1) * (s["n"] - s["k"] - s["d"] + x + 1)
            return weight * up / down

        def add(acc: Column, x: Column) -> Column:
            return F.struct(next_weight(acc["w"], x).alias("w"), (acc["sum"] + acc["w"]).alias("sum"))

        def walk(acc: Column, x: Column) -> Column:
            return F.struct(
                next_weight(acc["w"], x).alias("w"), (acc["left"] - acc["w"]).alias("left"),
                F.when((acc["left"] > 0) | (acc["at"] < s["a"]), x).otherwise(acc["at"]).alias("at"),
            )

        steps = F.sequence(s["a"], s["b"])
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        total = F.aggregate(steps, zero, add, lambda acc: acc["sum"])
        begin = F.struct(F.lit(1.0).alias("w"), (total * s["u"]).alias("left"), (s["a"] - 1).alias("at"))
        return F.when(s["a"] == s["b"], s["a"]).otherwise(F.aggregate(steps, begin, walk, lambda acc: acc["at"]))

    return _let(start, draw)


def communication_matrix(counts: Column, capacity: Column, seed: Column) -> Column:
    """Rows from each partition to each shard: array (partitions) of arrays (shards).

    Partition by partition, shard by shard, a count is drawn from the room that
    is left; rows add up to ``counts`` and columns to ``capacity``, which have
    the same total.
    """
    row_type, matrix_type = "array<bigint>", "array<array<bigint>>"

    def one_partition(room: Column, count: Column, index: Column) -> Column:
        start = F.struct(
            count.alias("need"), F.aggregate(room, F.lit(0).cast("long"), lambda a, b: a + b).alias("pop"),
            F.array().cast(row_type).alias("row"),
        )

        def one_shard(acc: Column, pair: Column) -> Column:
            chance = uniform(2, seed, index, pair["shard"])
            drawn = hypergeometric(acc["pop"], pair["room"], acc["need"], chance)
            return _let(drawn, lambda k: F.struct(
                (acc["need"] - k).alias("need"), (acc["pop"] - pair["room"]).alias("pop"),
                F.array_append(acc["row"], k).alias("row"),
            ))

        pairs = F.transform(room, lambda r, i: F.struct(r.alias("room"), i.alias("shard")))
        return F.aggregate(pairs, start, one_shard, lambda acc: acc["row"])

    def add(acc: Column, item: Column) -> Column:
        drawn = one_partition(acc["room"], item["count"], item["index"])
        return _let(drawn, lambda row: F.struct(
            F.zip_with(acc["room"], row, lambda a, b: a - b).alias("room"),
            F.array_append(acc["matrix"], row).alias("matrix"),
        ))

    items = F.transform(counts, lambda c, i: F.struct(c.alias("count"), i.alias("index")))
    start = F.struct(capacity.alias("room"), F.array().cast(matrix_type).alias("matrix"))
    return F.aggregate(items, start, add, lambda acc: acc["matrix"])


def _matrix_rows(counts: DataFrame, shards: int, seed: int, fan: int) -> DataFrame:
    """(block, sent): rows each block sends to each shard, drawn for ``fan`` blocks
    at a time under their group, and for the groups among each other."""
    total = counts.groupBy().agg(F.sum("rows").alias("all"))
    grouped = counts.withColumn("grp", F.floor(F.col("place") / fan)).groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("place", "_block", "rows"))).alias("members"), F.sum("rows").alias("rows")
    )
    top = grouped.groupBy().agg(F.sort_array(F.collect_list(F.struct("grp", "rows"))).alias("groups")).crossJoin(total)
    room = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: (F.floor(F.col("all") / shards) + F.when(s < F.col("all") % shards, 1).otherwise(0)).cast("long"),
    )
    drawn = communication_matrix(F.col("groups.rows"), room, F.lit(seed))
    rooms = top.select(F.explode(F.arrays_zip(F.col("groups.grp").alias("grp"), drawn.alias("room"))).alias("x"))
    inner = grouped.join(rooms.select("x.grp", "x.room"), "grp")
    drawn = communication_matrix(F.col("members.rows"), F.col("room"), F.xxhash64(F.lit(seed), F.col("grp")))
    pairs = F.arrays_zip(F.col("members._block").alias("block"), drawn.alias("sent"))
    return inner.select(F.explode(pairs).alias("x")).select("x.block", "x.sent")


def shuffle_into_shards(
    df: DataFrame, shards: int = 16, seed: int = 2, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Adds ``shard`` (0 to shards-1, sizes at most one apart) and ``slot`` (gapless from 0).

    The partitions of the input permute their rows by random keys and are written
    so; a matrix of exact hypergeometric counts says how many rows of each
    partition go to each shard, and the next positions of the permutation go
    there. After the exchange a second random order, counted over pieces, gives
    the slots, so no shard has to fit a task. Every row counts, repeated ones
    too; nulls do not matter; the empty table gives no rows. Columns of the input that
    are called like the two results are replaced; names that start with an
    underscore are reserved.
    """
    local = df.withColumn("_first", F.rand(seed)).sortWithinPartitions("_first")
    place = F.monotonically_increasing_id()  # partition number, then position in it
    staged = cut_lineage(local.withColumn("_row", place).drop("_first"))
    rows = staged.withColumn("_block", F.shiftright("_row", 33)).withColumn(
        "_at", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = rows.groupBy("_block").agg(F.count("*").alias("rows"))
    counts = cut_lineage(counts.withColumn("place", F.row_number().over(Window.orderBy("_block")) - 1))
    fan = max(2, math.isqrt(counts.count()) + 1)
    matrix = cut_lineage(_matrix_rows(counts, shards, seed, fan))
    sent = matrix.select(F.col("block").alias("_b"), "sent")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda n: F.aggregate(
        F.slice(F.col("sent"), F.lit(1), n), F.lit(0).cast("long"), lambda a, b: a + b))
    there = rows.join(sent.select("_b", ends.alias("_ends")), F.col("_block") == F.col("_b")).withColumn(
        shard, F.size(F.filter("_ends", lambda e: e <= F.col("_at")))
    )
    there = there.withColumn("_second", F.xxhash64(F.lit(seed + 1), "_row")).withColumn("_one", F.lit(1).cast("long"))
    there = there.drop("_b", "_ends", "_block", "_at")
    return running_totals(there, [shard], [F.col("_second")], "_one", slot).drop("_second", "_one", "_row")
