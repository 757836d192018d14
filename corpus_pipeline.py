"""From raw documents to packed token files: quality, near copies, benchmark leaks, mix, tokens.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns
of ``docs``. Rows are told apart by id, those with a null or repeated id by a
number of their own, so these, repeated rows and further columns pass through;
column names that start with an underscore are reserved. Decisions are made on
narrow tables and meet the texts once, at the end of a stage; only :func:`run`
stores texts, those that each stage keeps. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.decontamination import contaminations
from loomlog.llm.importance import resample
from loomlog.llm.mixing import mix, word_count
from loomlog.llm.near_dups import near_groups
from loomlog.llm.queries import token_documents
from loomlog.llm.running import identified, same_row, without
from loomlog.sources.tables import fresh_path, read_table, write_table

PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws, as many as the labels make
    one expect to be of quality; texts without words go."""
    rows = identified(docs)
    drawn = resample(rows, read_table(spark, f"{sf_dir}/labels.parquet"), carried=["doc_id", "_same"])
    return without(rows, drawn.filter(~F.col("_kept"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, null last; of
    repeated rows the first. Texts without words are copies of nothing."""
    rows = identified(docs)
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_same").alias("_id"), "text")
    copies = near_groups(named, key="_id").filter(~F.col("kept")).select("_id.doc_id", "_id._same")
    return without(rows, copies).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a benchmark item."""
    rows = identified(docs)
    named = rows.select(F.struct("doc_id", "_same").alias("_id"), "text")
    found = contaminations(named, read_table(spark, f"{sf_dir}/benchmark.parquet"), key="_id")
    return without(rows, found.select("_id.doc_id", "_id._same")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their targets in words.

    A document at its source's limit is cut after the last word the mix takes, and
    its n_chars, where there is that column, follows."""
    rows = identified(docs)
    sizes = rows.select(F.col("_same").alias("of"), "doc_id", "source", word_count("text").alias("size"))
    taken = mix(sizes).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("of").alias("_of"), F.col("taken").alias("_taken"), F.col("size").alias("_size"))
    whole, rest = F.floor(F.col("_taken") / F.col("_size")), F.col("_taken") % F.col("_size")
    times = (whole + F.when(rest > 0, 1).otherwise(0)).cast("int")
    out = rows.join(taken, same_row()).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    cut = F.col("_copy") > whole
    pieces = F.slice(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), F.lit(1), rest.cast("int"))
    out = out.withColumn("text", F.when(cut, F.array_join(pieces, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in ascending id order, described per document."""
    return token_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-copy removal", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", source_mix),
    ("packed token files", packed_tokens),
]

#: Quality, buckets of hashes and token files have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        made, path = stage(spark, docs, sf_dir), fresh_path(spark, "stage")
        write_table(made, path, None)
        docs = read_table(spark, path, made.schema)
    return docs
