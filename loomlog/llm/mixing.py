"""Mixing sources to target weights by random order and running word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.running import numbered, running_totals
from loomlog.sources.tables import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Target of each source: (source, source_size) -> plus target.

    Sources in code point order, null last, take the weights in turn and divide
    ``share`` times all words; none gets more than ``most`` times its own size,
    and what is over goes to the others by weight. That is one common level per
    unit of weight: with sources by rising size per weight, the level is the one
    left when the sources before are full, at the first source it does not fill.
    One row per source, so the windows without a key are small.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(turn)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(most))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumns({
        "left": F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "among": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "step": F.row_number().over(rising),
    }).withColumn("level", F.col("left") / F.col("among"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("step", "level"))
    first = F.min(free).over(every)
    target = F.when(first.isNull() | (F.col("step") < first["step"]), F.col("cap")).otherwise(
        first["level"] * F.col("weight")
    )
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 4,
) -> DataFrame:
    """Adds source_size, target and taken (words the mix takes of each row).

    Rows get a random key from the hash of ``key`` and the seed and are sorted by
    it inside their source; the source takes whole epochs while its target
    allows, then documents in order until the words reach the rounded-down
    target, the last one in part. Equal keys are settled by row. Null sizes count
    as 0, a null source is a source; sources without words have target 0. The
    empty table gives no rows. ``docs`` may hold any other columns; source_size,
    target and taken among them are replaced by the results, and names starting
    with an underscore are reserved. None of the three may be the key, source or size.
    """
    results = ["source_size", "target", "taken"]
    if set(results) & {key, source, size}:
        raise ValueError(f"{results} are names of results")
    docs = docs.drop(*results)
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = numbered(docs.withColumn("_key", order))
    sizes = rows.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.col(size), F.lit(0))).alias("source_size")
    )
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    placed = running_totals(rows, [source], [F.col("_key"), F.col(size)], size, "_before")
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = placed.join(targets, F.col(source).eqNullSafe(F.col("_source")))
    words = F.coalesce(F.col(size), F.lit(0))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("_before")
    taken = epochs * words + F.greatest(F.lit(0), F.least(words, rest))
    return joined.withColumn("taken", taken.cast("long")).drop("_source", "_before", "_key", "_row")
