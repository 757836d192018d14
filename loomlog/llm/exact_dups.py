"""Exact copies: groups by a 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.running import numbered
from loomlog.sources.tables import cut_lineage

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Text with every run of ASCII white space as one space; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts share the 128-bit hash form a group. The bytes
    of a group are equal when its least and its greatest text are, which partial
    aggregation finds before anything moves; where they differ, the text itself
    splits the group. Of equal texts the smallest key stays; null keys stay only
    if there is no other, and of rows with that key exactly one. The empty table
    gives no rows; other columns are ignored.
    """
    clean = docs.select(F.col(key).alias("id"), normalised(text).alias("norm"))
    hashed = clean.select("id", "norm", F.md5("norm").alias("hash"), F.sha2("norm", 256).alias("sha"))
    counts = cut_lineage(hashed.select("id", "hash", "sha"))
    # written and merged: a join of plain tables is dealt out anew at every size, so a hot group is split
    repeated = cut_lineage(counts.groupBy("hash").agg(F.count("*").alias("rows")).filter("rows > 1").select("hash"))
    repeated = repeated.hint("merge")
    single = counts.join(repeated, "hash", "left_anti").select(
        "id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha"
    )
    members = numbered(hashed.join(repeated, "hash", "left_semi"))
    clash = members.groupBy("hash").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clash = cut_lineage(clash.filter("low <> high").select("hash"))
    plain = members.join(clash, "hash", "left_anti").select("id", "hash", "sha", "_row", F.lit("").alias("variant"))
    split = members.join(clash, "hash", "left_semi").select("id", "hash", "sha", "_row", F.col("norm").alias("variant"))
    rows = plain.unionByName(split)
    best = rows.groupBy("hash", "variant").agg(
        F.count("*").alias("size"), F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("_row"))).alias("first")
    )
    grouped = rows.join(best, ["hash", "variant"]).select(
        "id", F.col("first.id").alias("keep"), "size", (F.col("_row") == F.col("first._row")).alias("kept"), "sha"
    )
    return single.unionByName(grouped).select(
        F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept",
        F.col("sha").alias("text_sha256"),
    )
